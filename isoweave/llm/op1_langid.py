"""Language identification by compression: the language whose dictionary packs a text smallest.

Training keeps, for every language, a bounded sample of its texts (pieces of ``PIECE`` characters from anywhere in the whole texts, drawn
by hash, up to ``DICTIONARY`` bytes of their words) as a zstandard raw-content dictionary.  A text is reduced to its
lower-case letters and compressed whole against each dictionary, at the same level at every length.  The smallest wins; the
margin to the second is the evidence.  A margin that is narrow, or a text without a letter, is a rejection.

Fitting reads the lengths of all rows and collects pieces of about twice the dictionaries' size.  The dictionaries together
take ``MODEL`` bytes at most: where there are very many languages, each gets a smaller one, and none is left out.
Prediction is a map over Arrow batches without a shuffle.

Defined results: a letter is a character of a Unicode letter category; a null text, or one without a letter, is ``und`` with
score 0 and is rejected; without a learned language every text is ``und``; equal sizes go to the language with more
training text, then by name, and are narrow; a null language teaches nothing; other columns pass through, whatever their
names, except the four that are added, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isoweave.runtime import column, map_arrow, table

#: bytes of a language's dictionary, of all dictionaries, and characters of a piece of training text
DICTIONARY, MODEL, PIECE = 192 << 10, 64 << 20, 512
#: one compression level for every text: of those tried as accurate as any but one, which takes twice the time
LEVEL = 6
#: narrower relative margins are rejected
MARGIN = 0.001
UNKNOWN = "und"
#: what is no letter: signs, digits, and the other numbers that Python counts as word characters
SIGNS = re.compile(r"[\W\d_]+")
NOT_LETTER = re.compile("[\\W\\d_" + "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]+")


#: tokens whose letters a task remembers
TOKENS = 1 << 17


class _Letters(dict):
    """The letters of a token between spaces, looked up once."""

    def __missing__(self, token: str) -> str:
        if len(self) >= TOKENS:
            self.clear()
        found = token
        if not token.isalpha():  # the short pattern suffices but for rare numbers
            found = SIGNS.sub(" ", token).strip()
            if not found.replace(" ", "").isalpha():
                found = NOT_LETTER.sub(" ", found).strip()
        self[token] = found
        return found


_KNOWN = _Letters()


def letters(text: str | None) -> str:
    """Lower-case words without digits and signs, one space around each; empty without a letter."""
    words = " ".join(filter(None, map(_KNOWN.__getitem__, (text or "").lower().split())))
    return f" {words} " if words else ""


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary) in the order in which ties are settled. ``rows`` are the rows to learn from."""
    rows = rows.select(column(lang).alias("lang"), column(text).alias("text")).where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum(F.length("text"))).collect()}  # a number for each language
    order = sorted(counts, key=lambda x: (-counts[x], x))
    if not order:
        return []
    size = min(DICTIONARY, MODEL // len(order))
    shares = rows.sparkSession.createDataFrame([(x, min(1 << 30, int(2 * size / max(1, counts[x]) * (1 << 30)))) for x in order], "lang string, share long")
    draw = lambda i: F.pmod(F.xxhash64(F.col("hash"), i), F.lit(1 << 30))
    pieces = F.sequence(F.lit(0), F.floor(F.length("text") / PIECE).cast("int"))
    taken = rows.join(F.broadcast(shares), "lang").withColumn("hash", F.xxhash64("text", F.lit(1)))  # a row for each language
    taken = taken.select("lang", "hash", "text", F.explode(F.filter(pieces, lambda i: draw(i) < F.col("share"))).alias("at"))
    taken = taken.select("lang", draw(F.col("at")).alias("draw"), F.substring("text", F.col("at") * PIECE + 1, F.lit(PIECE)).alias("piece")).distinct()
    held: dict[str, list] = {x: [] for x in order}
    for x, at, piece in taken.collect():
        held[x].append((at, piece))
    out = []
    for x in order:
        # the text nearest to the end is cheapest to refer to, so the order is the same in every run
        body = "".join(letters(p)[1:] for _, p in sorted(held[x])).encode()[-size:]
        if body:
            out.append((x, body))
    return out


class Classifier:
    def __init__(self, model: list[tuple[str, bytes]]):
        self.names, self.packers = [x for x, _ in model], []
        for _, body in model:
            words = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin)."""
        body = letters(text).encode()
        if not body or not self.names:
            return UNKNOWN, 0.0, 0.0
        sizes = [len(p.compress(body)) for p in self.packers]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((n for i, n in enumerate(sizes) if i != best), default=len(body) + 16)  # a single language is held against no packing
        margin = max(0.0, (rest - sizes[best]) / rest)
        return self.names[best], 0.5 + 0.5 * min(1.0, margin / 0.1), margin


def predict(df: DataFrame, model: list[tuple[str, bytes]], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``df`` with lang_pred, score, margin and rejected."""
    added = StructType.fromDDL("lang_pred string, score double, margin double, rejected boolean")
    fields = [f for f in df.schema.fields if f.name not in added.names]
    columns, names = [f.name for f in fields], [f.name for f in fields] + added.names
    held = df.sparkSession.sparkContext.broadcast(model)  # at most MODEL bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(held.value)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = [classify(t) for t in part.column(at).to_pylist()]
                found, scores, margins = zip(*got)
                rejected = [n == UNKNOWN or m < margin for n, _, m in got]
                kept = [part.column(part.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found), pa.array(scores), pa.array(margins), pa.array(rejected)], names)

    return map_arrow(df.select(*map(column, columns)), run, StructType([*fields, *added.fields]))


def remainder(key: str, parts: int) -> Column:
    """crc32 of an id's text modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % parts


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang) with a prediction learned from the rows that are not held out."""
    return predict(docs, fit(docs.where(remainder("doc_id", 5) != 0)))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(remainder("doc_id", 5) != 0))
    rows = docs.select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


QUERIES = {"op1_language": op1_language}
ORACLES: dict[str, str] = {}
