"""Near copies at a stated similarity: SimHash with op9's bit-sliced comparison, links by the exact Jaccard similarity of word shingles.

1. A text is the set of its five-word shingles (hashes, so repeats count once).  Equal sets are one vertex.
2. Fingerprints: a vertex has a SimHash of ``WIDTH`` bits, by op9's rule: a bit is set where over half of the shingles' hashes have it.
3. op9's links: vertices whose first 64 bits differ in at most two are found by op9's blocks and bit planes.  Each is a candidate.
4. Two bits of 64 are far closer than the line, and so many bits differ there that no few blocks agree.  Further vertices meet
   in buckets, by keys made of a few minhashes.  ``FIRST`` gives minhashes a key and keys; ``missed`` is the chance that a pair
   at the line shares no key.
5. Every candidate, whether from op9's links or from a bucket, goes through the bit-sliced comparison of whole fingerprints: bit
   planes stored vertically, 64 candidates to a machine word, summed by carry-save adders.  Those within ``radius_of`` go on.
6. A link is a pair whose sets have an exact Jaccard similarity of at least the line.  Components of the links are the groups.

What is compared in a bucket, so that none is dropped or cut:

* every member with the bucket's least vertex: first, for each vertex, with the one that it meets most often, beside op9's links;
  then with the others of which it is still apart, in joins on the two vertices;
* then only buckets that hold several components are open.  Where at most ``LEAF`` pairs a member are in different components,
  these pairs are compared: members outside the largest component with all others;
* members of the other open buckets are dealt into blocks of about ``BLOCK``; every two blocks of a bucket meet in one task, which
  counts the shingles that pairs within the radius share and lets only a forest of the links between different components out.
  A task holds two blocks whatever the bucket's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import zip_longest
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isoweave.llm import op9_simhash
from isoweave.llm.op9_simhash import ALL, LOWERED, WORD
from isoweave.operators.iterate import connected_components
from isoweave.operators.joins import lookup
from isoweave.runtime import column, cut_in_loop

SHINGLE, SIMILARITY = 5, 0.8
#: bits of a fingerprint, a multiple of 64; chance that a pair at the line is beyond the radius
WIDTH, BEYOND = 256, 1e-7
#: rows of a block whose bits are compared with all planes at once; rows of a batch that are unpacked into Python at once
ROWS, SLICE = 256, 256
#: minhashes of a key and number of keys
FIRST = (5, 24)
#: pairs a member up to which an open bucket compares all that are in different components; members of a block, shingles counted at once
LEAF, BLOCK, CHUNK = 16, 512, 4096
#: pairs that are broadcast to the sets; more are shuffled.  Pairs of one vertex, or members of one bucket, that meet in a task
FEW, PART = 1 << 18, 1024


def missed(similarity: float, way: tuple[int, int]) -> float:
    """Chance that a pair at this similarity shares no key."""
    return (1 - similarity ** way[0]) ** way[1]


def shingles_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the words' shingles; fewer words than a shingle make one, no word makes none."""
    words = WORD.findall((text or "").translate(LOWERED))
    if not words:
        return np.zeros(0, np.uint64)
    n, found, digest = max(1, len(words) - shingle + 1), set(), xxhash.xxh3_64_intdigest
    for at in range(0, n, 1 << 14):
        part = words[at:min(at + (1 << 14), n) + shingle - 1]
        found.update(map(digest, map(" ".join, zip(*[part[i:] for i in range(shingle)])) if len(part) >= shingle else [" ".join(part)]))
    return np.sort(np.fromiter(found, np.uint64, len(found)))


@cache
def _turns(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def keys_of(shingles: np.ndarray, way: tuple[int, int], seed: int) -> list[int]:
    """The keys of a set: hashes of ``way[0]`` minhashes each."""
    a, b = _turns(way[0] * way[1], seed)
    least = np.full(len(a), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (a[:, None] * shingles[None, at:at + 4096] + b[:, None]).min(1))
    return [xxhash.xxh3_64_intdigest(m.tobytes(), t) - (1 << 63) for t, m in enumerate(least.reshape(way[1], way[0]))]


def simhash(shingles: np.ndarray) -> bytes:
    """The set's fingerprint: for each bit whether over half of the shingles' hashes have it; bit i is bit i % 8 of byte i // 8."""
    turns, mixed = _turns(WIDTH // 64, 2)[0], np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(WIDTH, np.int64)
    for at in range(0, len(shingles), 4096):
        hashes = shingles[at:at + 4096, None] * turns
        hashes = (hashes ^ hashes >> np.uint64(32)) * mixed
        hashes ^= hashes >> np.uint64(29)
        counts += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(shingles), bitorder="little").tobytes()


@cache
def radius_of(similarity: float) -> int:
    """Differing bits that a pair at the line exceeds with a chance of ``BEYOND`` at most.

    A bit differs with the angle between the sets over pi; in small sets, where sums are often even, at most 1.26 times as often.
    """
    p = min(0.5, 1.26 * acos(2 * similarity / (1 + similarity)) / pi)
    beyond, at = 0.0, WIDTH
    while at > 0 and beyond + comb(WIDTH, at) * p ** at * (1 - p) ** (WIDTH - at) <= BEYOND:
        beyond += comb(WIDTH, at) * p ** at * (1 - p) ** (WIDTH - at)
        at -= 1
    return at


def _prints_of(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)


def _planes(prints: np.ndarray) -> np.ndarray:
    """One row of machine words for each bit, 64 fingerprints to a word; the last fingerprint fills the last word."""
    full = np.concatenate([prints, np.repeat(prints[-1:], -len(prints) % 64, axis=0)])
    bits = np.unpackbits(full, axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of two vertical numbers, lowest digit first."""
    out, carry = [], np.uint64(0)
    for x, y in zip_longest(a, b, fillvalue=np.uint64(0)):
        half = x ^ y
        out.append(half ^ carry)
        carry = x & y | half & carry
    return [*out, carry]


def _counted(plane: Callable[[int], np.ndarray], low: int, high: int) -> list[np.ndarray]:
    """How many of these planes are set, as vertical numbers."""
    middle = (low + high) // 2
    return [plane(low)] if high - low == 1 else _added(_counted(plane, low, middle), _counted(plane, middle, high))


def _beyond(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Where a vertical number is over the radius."""
    over, equal = np.uint64(0), ALL
    for k in range(max(len(count), radius.bit_length()) - 1, -1, -1):
        digit = count[k] if k < len(count) else np.uint64(0)
        if radius >> k & 1:
            equal = equal & digit
        else:
            over, equal = over | equal & digit, equal & ~digit
    return over


def _within(plane: Callable[[int], np.ndarray], radius: int) -> np.ndarray:
    """Bits of the candidates that at most ``radius`` planes are set for; given up where all are over it after 64 planes or more."""
    count: list[np.ndarray] = []
    for at in range(0, WIDTH, 64):
        count = _added(count, _counted(plane, at, at + 64))
        over = _beyond(count, radius)
        if (over == ALL).all():
            break
    return np.unpackbits((~over).view(np.uint8), axis=-1, bitorder="little").view(bool)


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (fingerprints as bytes) differ in at most ``radius`` bits."""
    if not len(a):
        return np.zeros(0, bool)
    planes = _planes(a ^ b)
    return _within(lambda k: planes[k], radius)[:len(a)]


def all_within(prints: np.ndarray, radius: int) -> np.ndarray:
    """For every two rows whether they differ in at most ``radius`` bits."""
    n = len(prints)
    if not n:
        return np.zeros((0, 0), bool)
    planes, own = _planes(prints), np.unpackbits(prints, axis=1, bitorder="little").astype(np.uint64) * ALL
    return np.concatenate([_within(lambda k: planes[k] ^ own[at:at + ROWS, k, None], radius)[:, :n] for at in range(0, n, ROWS)])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a worker keeps few unpacked rows in memory."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _packed(shingles: np.ndarray) -> bytes:
    """The set with 32 bits a shingle, as it is compared."""
    return np.unique((shingles >> np.uint64(32)).astype(np.uint32)).tobytes()


def _set_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint32)


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): the pairs within the radius that reach the similarity; ``pairs`` (src, dst) are distinct and cut."""
    radius = radius_of(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            prints = [_prints_of(batch.column(i).to_pylist()) for i in (2, 3)]
            batch = batch.filter(pa.array(pairs_within(*prints, radius)))
            src, dst, _, _, a, b = batch.columns
            near = [jaccard(_set_of(x), _set_of(y)) >= similarity for x, y in zip(a.to_pylist(), b.to_pylist())]
            yield pa.RecordBatch.from_arrays([src.filter(pa.array(near, pa.bool_())), dst.filter(pa.array(near, pa.bool_()))], ["src", "dst"])

    few = pairs.count() <= FEW
    near = F.broadcast if few else lambda df: df  # 16 bytes a pair
    two = sets.join(near(pairs.withColumnRenamed("dst", "vertex")), "vertex").select("src", F.col("vertex").alias("dst"), F.col("print").alias("q"), F.col("shingles").alias("b"))
    one = sets.join(near(pairs.select(F.col("src").alias("vertex")).distinct()), "vertex", "left_semi").select(F.col("vertex").alias("src"), F.col("print").alias("p"), F.col("shingles").alias("a"))
    short, long = F.least(F.octet_length("a"), F.octet_length("b")), F.greatest(F.octet_length("a"), F.octet_length("b"))
    # the least vertex of a large group is the source of all its pairs, so these meet in parts of about PART
    sizes = pairs.groupBy("src").agg(F.count("*").alias("n"))
    large = cut_in_loop(sizes.where(F.col("n") > PART))
    if not large.isEmpty():
        parts = F.ceil(F.coalesce("n", F.lit(1)) / PART).cast("int")
        named = lookup(two.select("src", "dst"), large, "src", sizes).select("src", "dst", F.pmod(F.xxhash64("dst"), parts).cast("int").alias("part"))
        two = two.join(named, ["src", "dst"])
        one = one.join(large, "src", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    both = two.join(one, [c for c in ("src", "part") if c in two.columns]).where(short >= F.lit(similarity) * long)
    return cut_in_loop(both.select("src", "dst", "p", "q", "a", "b").mapInArrow(run, "src long, dst long"))


def _named(df: DataFrame, members: DataFrame, vertex: str, name: str) -> DataFrame:
    """``df`` with the component of a vertex; one without a link is its own."""
    met = df.join(members.select(F.col("node").alias(vertex), F.col("component").alias("_c")), vertex, "left")
    return met.withColumn(name, F.coalesce("_c", vertex)).drop("_c")


def _apart(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    named = _named(_named(pairs, members, "src", "_a"), members, "dst", "_b")
    return cut_in_loop(named.where("_a != _b").select("src", "dst"))


def forest(prints: np.ndarray, sets: list[np.ndarray], components: np.ndarray, similarity: float, radius: int) -> list[tuple[int, int]]:
    """Links between different components that join all that lie within the radius and the similarity, few more than the rows."""
    candidates = all_within(prints, radius)
    candidates &= components[:, None] != components[None, :]
    rows = candidates.any(1).nonzero()[0]
    if not len(rows):
        return []
    found = _forest(candidates[np.ix_(rows, rows)], [sets[r] for r in rows.tolist()], components[rows], similarity)
    return [(int(rows[a]), int(rows[b])) for a, b in found]


def _forest(candidates: np.ndarray, sets: list[np.ndarray], components: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    n, sizes = len(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    names, column_, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint32)]), return_inverse=True, return_counts=True)
    shared = times[column_] > 1
    order = np.argsort(column_[shared], kind="stable")
    owner, column_ = owner[shared][order], column_[shared][order]
    both = np.zeros((n, n), np.float32)
    for at in range(0, len(names), CHUNK):
        low, high = np.searchsorted(column_, [at, at + CHUNK])
        if low < high:
            used, place = np.unique(column_[low:high], return_inverse=True)
            part = np.zeros((n, len(used)), np.float32)
            part[owner[low:high], place] = 1
            both += part @ part.T
    # shared >= similarity * union, a row at a time; a tie counts, and is told from a miss by far more than the last digit
    least = similarity * sizes
    near = np.stack([both[i] * (1 + similarity + 1e-6) >= least[i] + least for i in range(n)])
    del both
    near &= candidates
    _, label = np.unique(components, return_inverse=True)
    out: list[tuple[int, int]] = []
    while True:
        apart = near & (label[:, None] != label[None, :])
        rows = apart.any(1).nonzero()[0]
        if not len(rows):
            return out
        for r, p in zip(rows.tolist(), apart[rows].argmax(1).tolist()):
            if label[r] != label[p]:
                label[label == label[r]] = label[p]
                out.append((r, p))


def _blocks(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): links in buckets of many components, by pairs of blocks. ``members`` has bucket, vertex, component and n."""
    radius, blocks = radius_of(similarity), F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("vertex"), F.col("_blocks")).cast("int")
    dealt = members.withColumn("_blocks", blocks).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("bucket", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "vertex", "component")

    def run(table: pa.Table) -> pa.Table:
        vertices = np.array(table.column("vertex").to_pylist(), np.int64)
        sets = [_set_of(x) for x in table.column("shingles").to_pylist()]
        found = forest(_prints_of(table.column("print").to_pylist()), sets, table.column("component").to_numpy(), similarity, radius)
        ends = [(min(vertices[a], vertices[b]), max(vertices[a], vertices[b])) for a, b in found]
        return pa.table({"src": pa.array([a for a, _ in ends], pa.int64()), "dst": pa.array([b for _, b in ends], pa.int64())})

    met = dealt.join(sets.select("vertex", "print", "shingles"), "vertex")
    return cut_in_loop(met.groupBy("bucket", "i", "j").applyInArrow(run, "src long, dst long").distinct())


def _closest(vertices: DataFrame) -> DataFrame:
    """(src, dst): candidates by op9's operator, which connect all whose first 64 bits differ in at most two; ``vertices`` (vertex, fp)."""
    least = cut_in_loop(vertices.groupBy("fp").agg(F.min("vertex").alias("least"), F.count("*").alias("n")))
    same = lookup(vertices.select("fp", "vertex"), least.select("fp", "least"), "fp", least.select("fp", "n")).where("least < vertex").select("least", "vertex")
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")) for c in ("src", "dst")]
    other = op9_simhash.links(least.select("fp")).join(ends[0], "src").join(ends[1], "dst").select("_src", "_dst")
    return same.union(other).toDF("a", "b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def _links_of(keyed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): links that connect what lies within the similarity; ``keyed`` (vertex, fp, keys), ``sets`` (vertex, print, shingles)."""
    dealt = keyed.select("vertex", F.explode("keys").alias("bucket"))
    stars = cut_in_loop(dealt.groupBy("bucket").agg(F.min("vertex").alias("src"), F.count("*").alias("n")).where("n > 1"))
    counts = stars.select("bucket", "n")
    met = lookup(dealt, stars.select("bucket", "src"), "bucket", counts).where("src < vertex")
    pairs = cut_in_loop(met.groupBy("src", F.col("vertex").alias("dst")).agg(F.count("*").alias("shared")))
    best = pairs.groupBy("dst").agg(F.max(F.struct("shared", "src"))["src"].alias("src")).select("src", "dst")
    links = _links(cut_in_loop(_closest(keyed.select("vertex", "fp")).union(best).distinct()), sets, similarity)
    members = connected_components(links)
    rest = _apart(pairs.select("src", "dst"), members)
    if not rest.isEmpty():
        links = links.union(_links(rest, sets, similarity))
        members = connected_components(links)
    named = _named(dealt.join(stars.select("bucket"), "bucket", "left_semi"), members, "vertex", "component")
    parts = named.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    shape = parts.groupBy("bucket").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.max(F.struct("k", "component"))["component"].alias("most"))
    opened = cut_in_loop(shape.where("squares < n * n").withColumn("direct", (F.col("n") * F.col("n") - F.col("squares")) / 2 <= LEAF * F.col("n")))
    if opened.isEmpty():
        return links
    inside = cut_in_loop(lookup(named, opened, "bucket", opened.select("bucket", "n")).where("direct is not null"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    outer = inside.where("direct and component != most").select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("vertex").alias("src"), F.col("component").alias("_a"))
    every = inside.where("direct").select("bucket", F.pmod(F.xxhash64("vertex"), parts).cast("int").alias("part"), F.col("vertex").alias("dst"), F.col("component").alias("_b"), "most")
    cross = outer.join(every, ["bucket", "part"])
    cross = cross.where((F.col("_a") != F.col("_b")) & ((F.col("_b") == F.col("most")) | (F.col("src") < F.col("dst"))))
    known = pairs.select("src", "dst")
    cross = cross.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().join(known, ["src", "dst"], "left_anti")
    links = links.union(_links(cut_in_loop(cross), sets, similarity))
    return links.union(_blocks(inside.where("not direct").select("bucket", "vertex", "component", "n"), sets, similarity))


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(key, text_hash, component) of every row of ``docs``; rows of a component are linked near copies of one another."""
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text"))
    schema = StructType([*rows.schema.fields[:2], *StructType.fromDDL("vertex long, fp long, keys array<long>, print binary, shingles binary").fields])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [shingles_of(t, shingle) for t in batch.column(2).to_pylist()]
            vertex = pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in found], pa.int64())
            prints = [simhash(s) for s in found]
            fps = pa.array([int.from_bytes(p[:8], "little", signed=True) for p in prints], pa.int64())
            keys = pa.array([keys_of(s, FIRST, 1) for s in found], pa.list_(pa.int64()))
            sets = pa.array([_packed(s) for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vertex, fps, keys, pa.array(prints, pa.binary()), sets], schema.names)

    rows = cut_in_loop(rows.mapInArrow(sign, schema))
    sets = cut_in_loop(rows.select("vertex", "fp", "keys", "print", "shingles").dropDuplicates(["vertex"]))
    links = _links_of(sets.select("vertex", "fp", "keys"), sets.select("vertex", "print", "shingles"), similarity)
    members = connected_components(links).withColumnRenamed("node", "vertex")
    out = lookup(rows.select("_id", "text_hash", "vertex"), members, "vertex")
    return out.select(F.col("_id").alias(key), "text_hash", F.coalesce("component", "vertex").alias("component"))


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id, or text hash where ids are null.

    Rows equal in id and text stand for one document and one of them stays.
    """
    id, words = column(key), column(text)
    found = cut_in_loop(near_copies(docs.select(id.alias("_id"), words.alias("_text")), "_text", "_id", similarity))
    order = F.struct(F.col("_id").isNull().alias("unknown"), F.col("_id").alias("id"), F.col("text_hash").alias("hash"))
    best = found.groupBy("component").agg(F.min(order).alias("best"))
    kept = cut_in_loop(best.select(F.col("best.id").alias("_id"), F.col("best.hash").alias("_hash")))
    out = docs.join(kept, id.eqNullSafe(kept["_id"]) & (F.xxhash64(words) == kept["_hash"]), "left_semi")
    again = found.groupBy("_id", F.col("text_hash").alias("_hash")).agg(F.count("*").alias("n")).where("n > 1").select("_id", "_hash")
    again = cut_in_loop(again)
    if again.isEmpty():
        return out
    same = id.eqNullSafe(again["_id"]) & (F.xxhash64(words) == again["_hash"])
    return out.join(again, same, "left_anti").union(out.join(again, same, "left_semi").dropDuplicates([key, text]))
