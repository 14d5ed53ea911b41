"""SimHash near-dedup with a bit-sliced comparison.

1. Fingerprints: every whole text is cut into words and word shingles; each shingle is hashed and a fingerprint bit is
   set where over half of the hashes have it.  Runs as an Arrow job without a shuffle.
2. Equal fingerprints are one vertex with the smallest id among their rows, so groups of copies never meet in pairs.
3. Candidates: with the 64 bits in ``radius + 2`` blocks, fingerprints at most ``radius`` bits apart agree on at least two
   blocks.  Each vertex goes once to the bucket of every pair of blocks.  A bucket above ``LEAF`` rows is dealt again by
   every pair of blocks of the remaining bits' halves: the same argument holds inside the bucket, so no link is lost.
4. Inside a bucket bit planes are stored vertically, 64 fingerprints to a machine word.  For a row the planes where its bits
   differ are summed by carry-save counters of two bits and an overflow; a block of words is abandoned when all its
   counters are over the radius.  Only a spanning forest of each bucket's links leaves the task.
5. Connected components of the links give every row the smallest id that it reaches.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; fewer words than a shingle
make one shingle; rows with equal ids keep one row each; a null id takes part but is never the smallest unless the whole
component has none; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from isoweave.operators.iterate import connected_components
from isoweave.operators.joins import lookup
from isoweave.runtime import column, cut, map_arrow, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWERED = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SHINGLE, SEED, RADIUS = 3, 42, 2
#: rows of a bucket that are compared as they are; hashes that are counted at once
LEAF, CHUNK = 4096, 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text; 0 where there is no word."""
    words = WORD.findall((text or "").translate(LOWERED))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at:min(at + CHUNK, n) + shingle - 1]
        joined = map(" ".join, zip(*[part[i:] for i in range(shingle)])) if len(part) >= shingle else [" ".join(part)]
        hashes = np.fromiter((digest(s, seed) for s in joined), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp) of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [key, "fp"])

    return map_arrow(df.select(column(key), column(text)), run, StructType([df.schema[key], StructField("fp", LongType())]))


def near(fps: np.ndarray, radius: int = RADIUS, words: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the later rows at most ``radius`` bits away, by vertical bit planes and carry-save counters.

    ``words`` machine words of 64 rows make a block.  Counters hold 0 to 3 and stick at "over", so radius is at most 3.
    """
    n = len(fps)
    pad = np.zeros(-n % 64, np.uint64)
    bits = np.unpackbits(np.concatenate([fps, pad]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)  # 64 x words
    for i in range(n - 1):
        own, hits = int(fps[i]), []
        for at in range(i // 64, planes.shape[1], words):
            block = planes[:, at:at + words]
            ones = np.zeros(block.shape[1], np.uint64)
            twos, over = ones.copy(), ones.copy()
            for b in range(64):
                differs = ~block[b] if own >> b & 1 else block[b]
                carry = ones & differs
                ones ^= differs
                over |= twos & carry
                twos ^= carry
                if b % 8 == 7 and (_beyond(ones, twos, over, radius) == ALL).all():
                    break
            else:
                within = np.unpackbits((~_beyond(ones, twos, over, radius)).view(np.uint8), bitorder="little").nonzero()[0] + at * 64
                hits.append(within[(within > i) & (within < n)])
        if hits and sum(map(len, hits)):
            yield i, np.concatenate(hits)


ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _beyond(ones: np.ndarray, twos: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Rows whose counter is over the radius already."""
    return {0: ones | twos | over, 1: twos | over, 2: ones & twos | over, 3: over}[radius]


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of the bucket that join its connected parts, one fewer than the rows they join."""
    if len(fps) == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
    root, out = list(range(len(fps))), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, later in near(fps, radius):
        for j in later.tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _masks(bits: list[int], blocks: int) -> list[int]:
    """For every pair of the blocks that these bits make, the mask of its bits."""
    cuts = [len(bits) * i // blocks for i in range(blocks + 1)]
    parts = [bits[a:b] for a, b in zip(cuts, cuts[1:])]
    return [sum(1 << x for x in p + q) for p, q in combinations(parts, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(vertices: DataFrame, radius: int) -> DataFrame:
    """(k1, k2, fp): the vertices in their buckets, only buckets of two or more."""
    outer = _masks(list(range(64)), radius + 2)
    first = F.array(*[F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(outer)])
    wide = vertices.select("fp", F.explode(first).alias("k1")).select("fp", "k1.way", "k1.part")
    sizes = wide.groupBy("way", "part").agg(F.count("*").alias("n")).where("n > 1")
    wide = cut(wide.join(sizes, ["way", "part"]))
    small = wide.where(F.col("n") <= LEAF).select("way", "part", F.lit(-1).alias("way2"), F.lit(0).cast("long").alias("part2"), "fp")
    again = []
    for i, m in enumerate(outer):
        inner = _masks([b for b in range(64) if not m >> b & 1], radius + 2)
        again.append(F.when(F.col("way") == i, F.array(*[F.struct(F.lit(j).alias("way2"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("part2")) for j, x in enumerate(inner)])))
    hot = wide.where(F.col("n") > LEAF).select("way", "part", "fp", F.explode(F.coalesce(*again)).alias("k2")).select("way", "part", "k2.way2", "k2.part2", "fp")
    return small.union(hot)


def links(vertices: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst): links between different fingerprints that connect all that lie within the radius of each other.

    ``vertices`` has distinct ``fp``.
    """
    keys = ["way", "part", "way2", "part2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            k = rows[keys].to_numpy()
            starts = np.concatenate([[0], (k[1:] != k[:-1]).any(1).nonzero()[0] + 1])
            held = rows.iloc[starts[-1]:]
            yield _pairs(rows["fp"].to_numpy(), starts, radius)
        if held is not None:
            yield _pairs(held["fp"].to_numpy(), np.array([0]), radius, last=True)

    dealt = _dealt(vertices, radius)
    return dealt.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "fp").mapInPandas(run, "src long, dst long").distinct()


def _pairs(fps: np.ndarray, starts: np.ndarray, radius: int, last: bool = False) -> pd.DataFrame:
    """Links of the buckets that begin at ``starts``; without ``last`` the last bucket is still open and is left out."""
    ends = [*starts[1:], len(fps)] if last else starts[1:]
    found = [(fps[a + i], fps[a + j]) for a, b in zip(starts, ends) if b - a > 1 for i, j in forest(fps[a:b].view(np.uint64), radius)]
    return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, component_id) of every row of ``df``."""
    docs = cut(fingerprints(df, text, key, shingle))
    vertices = cut(docs.groupBy("fp").agg(F.min(column(key)).alias("least"), F.count("*").alias("n")))
    members = connected_components(links(vertices, radius))
    members = vertices.join(members, vertices["fp"] == members["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    # a group of copies may hold a third of the rows
    return lookup(docs, members.join(least, "component").select("fp", "component_id"), "fp", vertices.select("fp", "n")).select(column(key), "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
