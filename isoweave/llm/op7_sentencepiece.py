"""SentencePiece encoding and decoding with byte offsets into the original text.

A text is normalised here by longest-prefix lookups in the model's compiled character map (a double-array trie over UTF-8
bytes); every normalised byte remembers the original byte that it came from.  Ids come from the library; each piece's
length in normalised bytes and that alignment project it to a span of original bytes.  Normalised text that the pieces do
not cover exactly is an error, so the alignment is checked on every row.

The job is a map over Arrow batches with no shuffle.  Ids and spans are packed (little-endian unsigned 32 bits) and
leave in small batches, so a task's memory is bounded by its longest text.

Defined results: ids that the normalised text does not account for have the whole text as their span; a null or empty text has only the begin and end ids and no span; equal texts give equal results; a null id
passes through; extra columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from isoweave.runtime import column, map_arrow, table

SPACE = "▁".encode()
#: bytes of text that are encoded at once
CHUNK = 1 << 19


def _fields(blob: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protocol-buffer message, as far as the model files use it."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = blob[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, blob[at:at + n]
            at += n


class CharacterMap:
    """The compiled character map: prefix -> replacement, longest prefix first."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.texts = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes consumed and their replacement."""
        units, best = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best = i + 1 - at, self.texts[value:self.texts.index(b"\0", value)]
        return best


class Model:
    """A model file: its pieces' lengths, its normaliser and the library's processor."""

    def __init__(self, path: str):
        blob = open(path, "rb").read()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=blob)
        pieces, spec = [], {}
        for number, value in _fields(blob):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 3:
                spec = dict(_fields(value))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        kinds = [p.get(3, 1) for p in pieces]
        self.user = sorted((p[1] for p, k in zip(pieces, kinds) if k == 4), key=len, reverse=True)
        # control pieces cover nothing, byte pieces one byte, the unknown piece whatever is left
        self.widths = np.array([0 if k == 3 else 1 if k == 6 else -1 if k == 2 else len(p[1]) for p, k in zip(pieces, kinds)], np.int64)
        self.plain = not self.map.units and not self.squeeze and not self.user and self.escape

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and for the end the original byte it came from."""
        space = SPACE if self.escape else b" "
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            raw = np.frombuffer(text, np.uint8)
            source = np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
            if self.prefix:
                source = np.concatenate([np.zeros(3, np.int64), source])
            return (SPACE if self.prefix else b"") + text.replace(b" ", SPACE), np.append(source, len(raw))
        out, source, at = bytearray(), [], 0

        def emit(body: bytes, where: int) -> None:
            out.extend(body)
            source.extend([where] * len(body))

        steps = []
        while at < len(text):
            n, body = self._prefix(text, at)
            steps.append((at, n, body))
            at += n
        if self.squeeze:
            while steps and not steps[0][2].strip(b" ") and steps[0][2]:
                steps.pop(0)
        if not steps:
            return b"", np.array([len(text)], np.int64)
        if self.prefix:
            emit(space, steps[0][0])
        blank = self.squeeze
        for at, _, body in steps:
            if blank:
                body = body.lstrip(b" ") if self.squeeze else body
            if body:
                emit(body.replace(b" ", space), at)
                blank = self.squeeze and body.endswith(b" ")
        end = len(text)
        while self.squeeze and out.endswith(space):
            end = source[-1]
            del out[-len(space):], source[-len(space):]
        return bytes(out), np.array([*source, end], np.int64)

    def _prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        for u in self.user:
            if text.startswith(u, at):
                return len(u), u
        found = self.map.longest(text, at)
        if found:
            return found
        lead = text[at]
        n = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
        return n, text[at:at + n]

    def spans(self, text: bytes, ids: np.ndarray) -> np.ndarray:
        """(begin, end) in original bytes of every id; control ids have an empty span where they stand."""
        body, source = self.normalised(text)
        widths = self.widths[ids]
        if (widths < 0).any():
            pieces = self.processor.encode(text.decode(), out_type=str)
            inner = (ids != self.processor.bos_id()) & (ids != self.processor.eos_id())
            lengths = np.array([len(p.encode()) for p in pieces], np.int64)
            widths[inner] = np.where(widths[inner] < 0, lengths, widths[inner])
        ends = np.cumsum(widths)
        if ends.size and ends[-1] != len(body):
            # the pieces are not those of the normalised text: no alignment can be told, so every piece has the whole text
            return np.tile([0, len(text)], (len(ids), 1))
        return np.stack([source[ends - widths], np.where(widths > 0, _after(source, ends), source[ends])], 1)


def _after(source: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A piece ends where the next original byte begins; bytes of one replacement share their source."""
    last = source[np.maximum(ends - 1, 0)]
    return np.maximum(source[ends], np.where(source[ends] > last, source[ends], last))


@lru_cache(maxsize=4)
def model_of(path: str) -> Model:
    return Model(path)


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", begin: bool = True, end: bool = True) -> DataFrame:
    """(key, n_tokens, ids, spans, decoded): ids and (begin, end) spans packed as little-endian unsigned 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            sizes = np.cumsum([len(t or "") for t in batch.column(1).to_pylist()]) // CHUNK
            for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(sizes)) + 1):
                if len(part):
                    yield _encoded(batch.slice(part[0], len(part)), model, begin, end, key)

    made = StructType.fromDDL("n_tokens long, ids binary, spans binary, decoded string")
    return map_arrow(df.select(column(key), column(text)), run, StructType([df.schema[key], *made.fields]))


def _encoded(batch: pa.RecordBatch, model: Model, begin: bool, end: bool, key: str) -> pa.RecordBatch:
    texts = [t or "" for t in batch.column(1).to_pylist()]
    rows = model.processor.encode(texts, add_bos=begin, add_eos=end, num_threads=1)
    packed = [np.array(ids, "<u4") for ids in rows]
    spans = [model.spans(t.encode(), ids.astype(np.int64)).astype("<u4").tobytes() for t, ids in zip(texts, packed)]
    columns = [batch.column(0), pa.array(map(len, rows), pa.int64()), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(spans, pa.binary()), pa.array(model.processor.decode(rows), pa.string())]
    return pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids", "spans", "decoded"])


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, decoded) from packed ids; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = model_of(path).processor
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [np.frombuffer(b or b"", "<u4").tolist() for b in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(processor.decode(rows), pa.string())], [key, "decoded"])

    return map_arrow(df.select(column(key), column(ids)), run, StructType([df.schema[key], StructField("decoded", StringType())]))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"), path or default_model())
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), F.crc32("spans").alias("spans_crc32")
    )


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLES: dict[str, str] = {}
