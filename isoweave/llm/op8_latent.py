"""Benchmark decontamination by latent semantic retrieval.

1. Every text is read once into the numbers of its words among the benchmark's terms (-1 for others), which are cut; all later
   passes read these.  Inverse document frequencies come from all documents.
2. A distributed randomised SVD of TF-IDF passages of ``WINDOW`` words (of all documents and the benchmark, equally weighted)
   gives a latent space: tasks return Aᵀ(AX) for a thin X, added up in a tree, and the driver takes the eigenvectors of
   the Nyström form of AᵀA from this one pass, a terms x rank matrix.
3. Windows of every document, ``STRIDE`` words apart, are projected and compared with every benchmark passage; windows at a cosine of
   ``COSINE`` or more are candidates.  A window around which too few answer words of any item stand would fail step 4 whatever its
   cosine, so it is not projected; this loses nothing.
4. A candidate counts if the longest common subsequence with the item around the window has ``LCS`` of the item's words and
   the item's answer (the quarter of its words with most information) is there to ``ANSWER``: reordered function words alone never pass.
5. Items under ``SHORTEST`` words have no passage to speak of: they count where all their words stand side by side; those under
   three words only where they are the whole document.

The benchmark is the stated query set.  It is taken in blocks of about ``BLOCK`` bytes, so what is broadcast is bounded
however large it grows.  All passes are maps over Arrow batches; only term counts and thin matrices are shuffled.

Defined results: null and wordless texts and items match nothing; equal texts match equally; repeated ids keep a row
each; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from isoweave.runtime import column, cut_in_loop, table

WINDOW, STRIDE, RANK, EXTRA = 32, 16, 64, 16
COSINE, LCS, ANSWER, SHORTEST = 0.4, 0.6, 0.6, 8
#: bytes of benchmark text in a block, words and passages multiplied at once, thin matrices that are added or returned together
BLOCK, WORDS, TASKS = 1 << 20, 1 << 15, 16
#: words of documents that are compared at once, bytes of numbered words for a task
CHUNK, SHARE = 1 << 17, 64 << 20
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def starts_of(n: int) -> list[int]:
    """First words of the passages of an item; the last one ends with the item."""
    return sorted({*range(0, max(1, n - WINDOW + 1), STRIDE), max(0, n - WINDOW)})


class Benchmark:
    """One block of items: terms, words, answers and passages."""

    def __init__(self, rows: list[tuple]):
        every = [(i, w) for i, t in rows if (w := words_of(t))]
        self.items = [(i, w) for i, w in every if len(w) >= SHORTEST]
        self.terms = {t: k for k, t in enumerate(sorted({t for _, w in every for t in w}))}
        self.short: dict[tuple, list] = {}
        for i, w in every:
            if len(w) < SHORTEST:
                self.short.setdefault(tuple(self.terms[t] for t in w), []).append(i)
        self.heads: dict[int, list] = {}
        for w in self.short:
            if len(w) >= 3:
                self.heads.setdefault(self._head(*w[:3]), []).append(w)
        self.passages = [(k, s) for k, (_, w) in enumerate(self.items) for s in starts_of(len(w))]
        self.masks = []
        for _, w in self.items:
            mask: dict[int, int] = {}
            for at, t in enumerate(w):
                mask[self.terms[t]] = mask.get(self.terms[t], 0) | 1 << at
            self.masks.append(mask)

    def _head(self, a, b, c):
        """Three terms as one number."""
        n = len(self.terms) + 1
        return ((a + 1) * n + b + 1) * n + c + 1

    def verbatim(self, ids: np.ndarray) -> list:
        """Short items that a document holds word for word."""
        found = [*self.short.get(tuple(ids.tolist()), [])] if 0 < len(ids) < 3 else []
        if self.heads and len(ids) >= 3:
            wide = ids.astype(np.int64)
            heads = self._head(wide[:-2], wide[1:-1], wide[2:])
            met = {w for at in np.isin(heads, list(self.heads)).nonzero()[0].tolist() for w in self.heads[int(heads[at])] if tuple(ids[at:at + len(w)].tolist()) == w}
            found += [i for w in sorted(met) for i in self.short[w]]
        return found

    def weigh(self, found: dict[int, int], documents: int) -> None:
        df = np.array([found.get(k, 0) for k in range(len(self.terms))], np.float64)
        self.idf = np.log((documents + 1) / (df + 1)) + 0.05
        self.answers = []
        for _, w in self.items:
            order = sorted({self.terms[t] for t in w}, key=lambda k: (-self.idf[k], k))
            self.answers.append(frozenset(order[:max(3, len(order) // 4)]))
        self.telling = np.isin(np.arange(len(self.terms) + 1), list(frozenset().union(*self.answers)))  # the last entry is the unknown word
        self.need = min(math.ceil(ANSWER * len(a)) for a in self.answers)
        self.reach = max(len(w) for _, w in self.items)

    def vectors(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Term and passage of every word of the benchmark's passages."""
        parts = [np.array([self.terms[t] for t in self.items[k][1][s:s + WINDOW]]) for k, s in self.passages]
        return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), len(parts)

    def project(self, basis: np.ndarray) -> None:
        """``basis`` (terms x rank): the latent space; also the passages' unit vectors and norms in it."""
        self.basis = (self.idf[:, None] * basis).astype(np.float32)
        term, row, n = self.vectors()
        out = np.zeros((n, basis.shape[1]), np.float32)
        np.add.at(out, row, self.basis[term])
        self.norms = np.maximum(np.linalg.norm(out, axis=1), 1e-6).astype(np.float32)
        self.unit = (out / self.norms[:, None]).T.copy()


def _ids(text: str | None, terms: dict[str, int]) -> np.ndarray:
    return np.fromiter(map(terms.get, words_of(text), repeat(-1)), np.int32)


def _passages(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Term and window of every known word of a document's windows."""
    n = max(1, -(-(len(ids) - WINDOW) // STRIDE) + 1)
    at = (ids >= 0).nonzero()[0]
    last = np.minimum(at // STRIDE, n - 1)
    rows = [(ids[at], last)]
    for back in range(1, -(-WINDOW // STRIDE)):
        inside = (last - back >= 0) & (at - (last - back) * STRIDE < WINDOW)
        rows.append((ids[at][inside], (last - back)[inside]))
    return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), n


def _thin(term: np.ndarray, row: np.ndarray, idf: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
    """Add AᵀAX of unit-length TF-IDF passages to ``out``."""
    if not len(row):
        return
    pairs, tf = np.unique(row * len(idf) + term, return_counts=True)
    row, term = pairs // len(idf), pairs % len(idf)
    first = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0]))
    value = tf * idf[term]
    size = np.diff(np.append(first, len(row)))
    value = (value / np.sqrt(np.repeat(np.add.reduceat(value ** 2, first), size))).astype(np.float32)
    y = np.repeat(np.add.reduceat(value[:, None] * x[term], first, axis=0), size, axis=0)
    y *= value[:, None]
    order = np.argsort(term, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(term[order]) > 0]))
    out[term[order][begin]] += np.add.reduceat(y[order], begin, axis=0)


def _product(numbered: DataFrame, bench: Benchmark, x: np.ndarray) -> np.ndarray:
    """AᵀAX over all documents and the benchmark; the benchmark weighs as much as the documents."""
    held = numbered.sparkSession.sparkContext.broadcast((bench.idf, x))  # a block of terms x rank
    schema = "n long, part binary"

    def row(n: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["n", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, x = held.value
        total, n = np.zeros(x.shape), 0
        term, passage, size = [], [], 0
        for batch in batches:
            for body in batch.column(0).to_pylist():
                ids = np.frombuffer(body, np.int32)
                at = (ids >= 0).nonzero()[0]
                term.append(ids[at])
                passage.append(at // WINDOW + n)
                n, size = n + max(1, -(-len(ids) // WINDOW)), size + len(at)
                if size >= WORDS:
                    _thin(np.concatenate(term), np.concatenate(passage), idf, x, total)
                    term, passage, size = [], [], 0
        if term:
            _thin(np.concatenate(term), np.concatenate(passage), idf, x, total)
        yield row(n, total)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(part, np.float32).astype(np.float64)
                n, total = n + k, part if total is None else total + part
        if total is not None:
            yield row(n, total)

    own, n, total = np.zeros(x.shape), 0, 0.0
    _thin(*bench.vectors()[:2], bench.idf, x, own)
    sums = cut_in_loop(numbered.select("ids").mapInArrow(run, schema))
    while (count := sums.count()) > TASKS:  # a tree of partial sums
        sums = cut_in_loop(sums.repartition(-(-count // TASKS)).mapInArrow(summed, schema))
    for r in sums.collect():  # TASKS thin matrices at most
        n += r.n
        total = total + np.frombuffer(r.part, np.float32).reshape(own.shape)
    held.destroy()
    return total + own * (max(1, n) / len(bench.passages))


def fit(numbered: DataFrame, bench: Benchmark) -> None:
    """Document frequencies from all documents, then the latent space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, size = Counter(), 0, 0
        for batch in batches:
            for body in batch.column(0).to_pylist():
                seen.update(set(np.frombuffer(body, np.int32).tolist()))
                n, size = n + 1, size + len(body)
        seen.pop(-1, None)
        yield pa.RecordBatch.from_arrays([pa.array([*seen, -1, -2], pa.int32()), pa.array([*seen.values(), n, size], pa.int64())], ["term", "n"])

    counts = {r[0]: r[1] for r in numbered.select("ids").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n")).collect()}  # a block of terms
    documents, size = counts.pop(-1, 0), counts.pop(-2, 0)
    bench.weigh(counts, documents)
    width = min(RANK + EXTRA, len(bench.terms))
    x = np.linalg.qr(np.random.default_rng(8).standard_normal((len(bench.terms), width)))[0].astype(np.float32)
    # a thin matrix for each task, so there are no more tasks than cores or shares of the words
    tasks = max(numbered.sparkSession.sparkContext.defaultParallelism, size // SHARE)
    z = _product(numbered.coalesce(tasks), bench, x).astype(np.float64)
    # Nyström: AᵀA is close to Z (XᵀZ)⁻¹ Zᵀ, whose eigenvectors are the left singular vectors of Z C with C Cᵀ = (XᵀZ)⁻¹
    values, turn = np.linalg.eigh((x.T @ z + z.T @ x) / 2)
    good = values > 1e-6 * max(values.max(), 1e-12)
    bench.project(np.linalg.svd(z @ (turn[:, good] / np.sqrt(values[good])), full_matrices=False)[0][:, :RANK])


def lcs(mask: dict[int, int], n: int, region: np.ndarray) -> int:
    """Length of the longest common subsequence of an item (as bit masks of its terms) and a region of term ids."""
    full = (1 << n) - 1
    v = full
    for t in region.tolist():
        m = mask.get(t)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


def _open(ids: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, int]:
    """Passages of a document without those around which no item's answer can be: they would fail the checks whatever their cosine."""
    hits = np.concatenate([[0], np.cumsum(bench.telling[ids])])
    if hits[-1] < bench.need:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    term, row, n = _passages(ids)
    at = np.arange(n) * STRIDE
    low, high = np.clip(at - bench.reach, 0, len(ids)), np.clip(at + WINDOW + bench.reach, 0, len(ids))
    keep = (hits[high] - hits[low] >= bench.need)[row]
    return term[keep], row[keep], n


def _candidates(parts: list[tuple], bench: Benchmark) -> Iterator[tuple[int, int, int, float]]:
    """(document, window, item, cosine) of a chunk's documents, their windows against every passage of the benchmark."""
    offsets = np.cumsum([0] + [p[2] for p in parts])
    term = np.concatenate([p[0] for p in parts])
    row = np.concatenate([p[1] + o for p, o in zip(parts, offsets)])
    if not len(term):
        return
    order = np.argsort(row, kind="stable")
    term, row = term[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0]))
    sums, at = np.add.reduceat(bench.basis[term], first, axis=0), row[first]
    norms = np.linalg.norm(sums, axis=1)
    of = np.array([k for k, _ in bench.passages])
    for lo in range(0, len(sums), 4096):
        dot = sums[lo:lo + 4096] @ bench.unit
        # a window with little of the space in it stays far from everything, whatever its direction
        dot /= np.maximum(norms[lo:lo + 4096, None], 0.5 * bench.norms[None, :])
        w, p = np.nonzero(dot >= COSINE)
        doc = np.searchsorted(offsets, at[lo + w], side="right") - 1
        yield from zip(doc.tolist(), (at[lo + w] - offsets[doc]).tolist(), of[p].tolist(), dot[w, p].tolist())


def _matches(ids: list[np.ndarray], bench: Benchmark) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, lcs, answer, cosine): the best of each pair that passes the checks."""
    pairs: dict[tuple[int, int], dict[int, float]] = {}
    for doc, window, item, cosine in _candidates([_open(x, bench) for x in ids], bench):
        near = pairs.setdefault((doc, item), {})
        near[window] = max(cosine, near.get(window, 0.0))
    held: dict[int, set] = {}
    for (doc, item), windows in sorted(pairs.items()):
        answers, n = bench.answers[item], len(bench.items[item][1])
        if doc not in held:
            held[doc] = set(ids[doc].tolist())
        if len(answers & held[doc]) < ANSWER * len(answers):
            continue
        best = (0.0,)
        for window, cosine in sorted(windows.items()):
            region = ids[doc][max(0, window * STRIDE - n):window * STRIDE + WINDOW + n]
            region = region[region >= 0]
            answer = len(answers.intersection(region.tolist())) / len(answers)
            if answer >= ANSWER:
                common = lcs(bench.masks[item], n, region) / n
                if common >= LCS and common > best[0]:
                    best = (common, answer, cosine)
        if best[0]:
            yield (doc, item, *best)


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK))
    for b in range(n):
        yield sorted(map(tuple, items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()), key=str)


def _found(rows: list[np.ndarray], bench: Benchmark) -> Iterator[tuple[int, object, float, float, float]]:
    """(row, item id, lcs, answer, cosine)."""
    if bench.items:
        yield from ((doc, bench.items[item][0], *rest) for doc, item, *rest in _matches(rows, bench))
    if bench.short:
        yield from ((doc, item, 1.0, 1.0, 1.0) for doc, ids in enumerate(rows) for item in bench.verbatim(ids))


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, item, lcs, answer, cosine): every pair of a document and a benchmark item that it holds."""
    items = items.select(column(item).alias("item_id"), F.col("text")).where("text is not null")
    docs = docs.select(column(key).alias("_key"), column(text).alias("_text"))
    owner, kind = docs.schema["_key"], items.schema["item_id"]
    scores = ["lcs", "answer", "cosine"]
    schema = StructType([owner, kind, *[StructField(c, DoubleType()) for c in scores]])
    out = docs.sparkSession.createDataFrame([], schema)
    for rows in _blocks(items):
        bench = Benchmark(rows)
        if not bench.terms:
            continue
        terms = docs.sparkSession.sparkContext.broadcast(bench.terms)  # about BLOCK bytes

        def number(batches: Iterator[pa.RecordBatch], terms=terms) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [_ids(t, terms.value).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["_key", "ids"])

        numbered = cut_in_loop(docs.mapInArrow(number, StructType([owner, StructField("ids", BinaryType())])))
        terms.destroy()
        if bench.items:
            fit(numbered, bench)
        held = docs.sparkSession.sparkContext.broadcast(bench)  # about BLOCK bytes of text and a thin matrix of its terms

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bench, arrow = held.value, to_arrow_type(kind.dataType)
            for batch in batches:
                ids = [np.frombuffer(b, np.int32) for b in batch.column(1).to_pylist()]
                sizes = np.cumsum([len(x) for x in ids]) // CHUNK
                for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(sizes)) + 1):
                    if len(part):
                        got = list(_found([ids[i] for i in part], bench))
                        columns = [batch.column(0).take(pa.array([int(part[g[0]]) for g in got], pa.int64())), pa.array([g[1] for g in got], arrow)]
                        yield pa.RecordBatch.from_arrays(columns + [pa.array([float(g[k]) for g in got], pa.float64()) for k in (2, 3, 4)], schema.names)

        out = out.union(numbered.mapInArrow(run, schema))
    return out.withColumnRenamed("_key", key)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that hold an item; other rows with the same id, or none, stay."""
    id, words = column(key), column(text)
    named = docs.select(F.struct(id.alias("id"), F.xxhash64(words).alias("hash")).alias("_row"), words.alias("_words"))
    bad = contaminated(named, items, "_words", "_row").select(F.col("_row.id").alias("_bad"), F.col("_row.hash").alias("_hash")).distinct()
    return docs.join(bad, id.eqNullSafe(bad["_bad"]) & (F.xxhash64(words) == bad["_hash"]), "left_anti")


def op8_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_latent_retrieval": op8_latent_retrieval}
ORACLES: dict[str, str] = {}
