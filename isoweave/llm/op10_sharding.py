"""Sharding by sampled splitters, in DataFrame functions only.

1. Rows get a key (hash of the text, hash of the id, hash of the whole row, place in the input), so equal texts lie side by side
   and a hot group of copies, even of whole rows, can still be cut inside.  Only these numbers, the size and the checksum go
   on, never the text.
2. A size-weighted sample of keys is drawn: a row of s bytes is taken with probability min(1, s * samples / total).  The
   expected number of sampled keys is at most ``2 * samples`` whatever the table's size.
3. Quantiles of the sample are splitters of ``ranges`` fine ranges; every row is counted into its range exactly.
   Ranges that came out overfull get splitters of their own, drawn the same way inside them.
4. Shards are runs of fine ranges, cut where the exact running bytes are nearest to equal parts.
5. The slot is the row's rank inside its fine range plus the exact counts of the shard's earlier ranges: no window ever
   spans more than a fine range.

Law ``bytes``: shard sizes are near equal (a boundary is off by at most half a fine range).

Defined results: a null text has size 1 and checksum 0; a null id is one more id; copies of a whole row are told apart by their place in the
input alone; an empty table gives an empty result; ``shard_rows`` returns no other columns, ``write_shards`` keeps all but
``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isoweave.runtime import column, cut, table

#: fine ranges and sampled keys for each shard; both bound what the driver sees
RANGES_A_SHARD, SAMPLES_A_RANGE = 64, 16
KEY = ("_h1", "_h2", "_h3", "_h4")


def _uniform(*cols: Column) -> Column:
    """A repeatable number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(*cols, F.lit(20)), F.lit(1 << 30)) / float(1 << 30)


def _literal(rows: list[tuple]) -> Column:
    """An array of structs 0, 1, ... that the optimiser folds into one literal."""
    return F.arrays_zip(*[F.split(F.lit(",".join(map(str, c))), ",").cast("array<bigint>") for c in zip(*rows, strict=True)])


def _sample(rows: DataFrame, rate: float) -> list[tuple[tuple, float]]:
    """Keys with the bytes that each stands for, in key order."""
    taken = rows.where(_uniform(*KEY) < F.col("_weight") * F.lit(rate)).select(*KEY, "_weight").collect()
    return sorted((tuple(r[:-1]), max(float(r[-1]), 1 / rate)) for r in taken)


def _quantiles(sample: list[tuple[tuple, float]], parts: int) -> list[tuple]:
    """At most parts - 1 keys that cut the sample's bytes into equal parts."""
    total, done, out = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        done += w
        if done >= total * (len(out) + 1) / parts and len(out) < parts - 1:
            out.append(key)
    return sorted(set(out))


def _ranged(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """``_range``: the splitters below the key, found among coarse ones, then inside that part: about 2 sqrt(n) looks."""
    if not splitters:
        return rows.withColumn("_range", F.lit(0))
    key, step = F.struct(*[F.col(k).alias(str(i)) for i, k in enumerate(KEY)]), max(1, int(len(splitters) ** 0.5))
    below = lambda keys: F.size(F.filter(keys, lambda s: s < key))
    every, last = _literal(splitters), _literal([splitters[min(i + step, len(splitters)) - 1] for i in range(0, len(splitters), step)])
    out = rows.withColumn("_coarse", below(last) * step)
    return out.withColumn("_range", F.col("_coarse") + below(F.slice(every, F.col("_coarse") + 1, F.lit(step)))).withColumn("_range", F.least("_range", F.lit(len(splitters)))).drop("_coarse")


def splitters_of(rows: DataFrame, ranges: int, samples: int) -> tuple[list[tuple], dict[int, tuple[int, int]]]:
    """Splitters, and the exact (weight, rows) of each fine range. ``rows`` has the key and ``_weight``."""
    total = rows.agg(F.sum("_weight")).first()[0] or 0
    if not total:
        return [], {}
    found = _quantiles(_sample(rows, samples / total), ranges)
    target = total / ranges
    while True:
        counts = {r[0]: (r[1], r[2]) for r in _ranged(rows, found).groupBy("_range").agg(F.sum("_weight"), F.count("*")).collect()}
        full = sorted(k for k, (w, n) in counts.items() if w > 2 * target and n > 1)
        if not full:
            return found, counts
        inside = _ranged(rows, found).where(F.col("_range").isin(full))
        heavy, more = sum(counts[k][0] for k in full), []
        by_range: dict[int, list] = {}
        for key, w in _sample(inside, min(samples, SAMPLES_A_RANGE * heavy / target) * 4 / heavy):
            by_range.setdefault(bisect_left(found, key), []).append((key, w))
        for k, drawn in by_range.items():
            more += _quantiles(drawn, max(2, round(counts[k][0] / target)))
        if not set(more) - set(found):
            return found, counts
        found = sorted(set(found) | set(more))


def cuts(counts: dict[int, tuple[int, int]], shards: int) -> dict[int, tuple[int, int]]:
    """Fine range to (shard, first slot): each boundary goes to the range end nearest to its equal part."""
    order, ends, done = sorted(counts), [], 0
    for k in order:
        done += counts[k][0]
        ends.append(done)
    last = []
    for s in range(1, shards):
        want = done * s / shards
        i = bisect_left(ends, want)
        if i > 0 and (i == len(ends) or want - ends[i - 1] <= ends[i] - want):
            i -= 1
        last.append(i)
    out, slot = {}, [0] * shards
    for i, k in enumerate(order):
        s = bisect_left(last, i)
        out[k] = (s, slot[s])
        slot[s] += counts[k][1]
    return out


def shard_rows(df: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", carry: bool = False) -> DataFrame:
    """Id, size, checksum, shard and slot of every row of ``df``; with ``carry`` the whole row as a struct ``_row`` in place of the id."""
    body = F.encode(F.coalesce(column(text), F.lit("")), "UTF-8")
    whole = F.struct(*map(column, df.columns))
    kept = whole.alias("_row") if carry else column(key).alias("_row")
    rows = df.select(
        kept,
        (F.length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(column(text)).alias("_h1"),
        F.xxhash64(column(key)).alias("_h2"),
        F.xxhash64(*map(column, df.columns)).alias("_h3"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_h4"),
    ).withColumn("_weight", F.col("size"))
    rows = cut(rows)
    found, counts = splitters_of(rows, shards * RANGES_A_SHARD, shards * RANGES_A_SHARD * SAMPLES_A_RANGE)
    places = cuts(counts, shards)
    if not places:
        return rows.select(F.col("_row").alias("_row" if carry else key), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # one entry for each fine range: at most shards * RANGES_A_SHARD and what the refinements add
    entries = [places.get(k, (0, 0)) for k in range(len(found) + 1)]
    at = F.get(_literal(entries), F.col("_range"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*KEY))
    out = _ranged(rows, found).withColumn("_rank", rank).withColumn("_at", at)
    return out.select(F.col("_row").alias("_row" if carry else key), "size", "text_crc32", F.col("_at.0").cast("int").alias("shard"), (F.col("_at.1") + F.col("_rank") - 1).alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 16, text: str = "text", key: str = "doc_id") -> None:
    """Range-partition whole records by (shard, slot) and write one folder for each shard."""
    plan = shard_rows(df, shards, text, key, carry=True)
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c not in ("shard", "slot")]
    parts = max(shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = plan.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").select(*kept, "shard", "slot")
    placed.write.partitionBy("shard").parquet(path)


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_rows(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op10_sampled_splitters": op10_sampled_splitters}
ORACLES: dict[str, str] = {}
