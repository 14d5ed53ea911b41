"""Iterative graph jobs: pointer doubling, connected components and relaxations, as loops of distributed joins.

Each round's table is cut with a reliable checkpoint; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from isoweave.runtime import cut, cut_in_loop


def terminal(pointers: DataFrame, id: str = "id", next: str = "next") -> DataFrame:
    """(id, root): where each pointer chain ends. A row that points to itself, to null or outside the table is an end.

    Every round doubles the distance, so a chain of length n takes log2(n) rounds.  On a loop there is no end; rows that still
    move after 64 doublings are an error.
    """
    state = cut_in_loop(pointers.select(F.col(id).alias("id"), F.coalesce(next, id).alias("root")))
    rows = state.count()
    state = _tasks(state, rows)
    for _ in range(64):
        jump = state.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = state.join(jump, "root", "left").select("id", F.coalesce("further", "root").alias("to"), (F.coalesce("further", "root") != F.col("root")).alias("moved"))
        moved = cut_in_loop(_tasks(moved, rows))
        state = moved.select("id", F.col("to").alias("root"))
        if moved.where("moved").isEmpty():
            return state
    raise ValueError("pointers form a loop")


def loops(pointers: DataFrame, id: str = "id", next: str = "next") -> DataFrame:
    """(id, loop, on_loop): the rows whose chain never ends, and the least member of the loop that it runs into.

    A row that points to itself, to null or outside the table is an end.  Steps double each round, and with them the least row that a
    chain has met; after log2(rows) rounds what has not ended is on a loop.
    """
    given = pointers.select(F.col(id).alias("id"), F.col(next).alias("to"))
    state = cut_in_loop(given.where("to is not null and to != id").withColumn("least", F.col("id")))
    rows = state.count()
    for _ in range(max(1, rows.bit_length())):
        jump = state.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("least").alias("_least"))
        # a chain that meets an end is gone
        state = cut_in_loop(_tasks(state.join(jump, "to").select("id", F.col("further").alias("to"), F.least("least", "_least").alias("least")), rows))
    on = state.select(F.col("to").alias("id")).distinct().join(state.select("id", F.col("least").alias("loop")), "id")
    on = cut_in_loop(on)
    named = state.join(on.select(F.col("id").alias("to"), "loop"), "to").select("id", "loop")
    return named.join(on.select("id", F.lit(True).alias("_on")), "id", "left").select("id", "loop", F.col("_on").isNotNull().alias("on_loop"))


#: rows of a round's table for a task; edges that are finished in one task, a fixed bound
SHARE, TAIL = 1 << 17, 1 << 13


def _tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in few enough tasks for a table of this many rows; later rounds of a loop have ever fewer."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // SHARE))


def _finished(edges: DataFrame) -> DataFrame:
    """(a, to): every vertex of at most ``TAIL`` edges and the least vertex that it reaches, by union and find in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict = {}

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                a, b = top(a), top(b)
                root[max(a, b)] = min(a, b)
        if root:
            yield pd.DataFrame({"a": list(root), "to": [top(x) for x in list(root)]})

    kind = edges.schema["a"].dataType
    return edges.select("a", "b").coalesce(1).mapInPandas(run, StructType([StructField("a", kind), StructField("to", kind)]))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", tail: int = TAIL) -> DataFrame:
    """(node, component) of every vertex that has an edge to another one; ``component`` is the component's least vertex.

    Each round every vertex points to the least vertex, by a hash that changes every round, among itself and its neighbours, and
    edges are rewritten to the pointed-to vertices; a round removes a constant share of the vertices in expectation,
    whatever the shape.  The last ``tail`` edges are finished at once in Python; with 0 all rounds are joins.  The pointers of
    all rounds are then composed, last round first.  Null ends and loops are no edges.
    """
    left = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a != b")
    left = cut_in_loop(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pointers, turn = [], 0
    while (rows := left.count()) > tail:
        left = _tasks(left, rows)
        both = left.union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("hash"), F.col(c).alias("vertex"))  # noqa: E731, B023
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best")).select("a", F.least(F.col("best"), rank("a"))["vertex"].alias("to"))
        pointer = cut_in_loop(_tasks(best, 2 * rows))
        pointers.append(pointer)
        moved = left.join(pointer, "a").select(F.col("to").alias("x"), "b")
        moved = moved.join(pointer.withColumnRenamed("a", "b"), "b").select("x", F.col("to").alias("y"))
        moved = moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = cut_in_loop(_tasks(moved, rows))
        turn += 1
    root = cut_in_loop(_finished(left)) if tail else left.select("a", F.col("b").alias("to"))
    for i, pointer in enumerate(reversed(pointers)):
        further = root.select(F.col("a").alias("to"), F.col("to").alias("end"))
        root = pointer if not tail and i == 0 else cut_in_loop(_tasks(pointer.join(further, "to", "left").select("a", F.coalesce("end", "to").alias("to")), pointer.count()))
    # the last rounds' ends are least by a hash or among what was left, so the least vertex of each component is taken now
    least = root.groupBy("to").agg(F.min("a").alias("component"))
    return root.join(least, "to").select(F.col("a").alias("node"), "component")


def nearest_source(edges: DataFrame, sources: DataFrame, limit: float | None = None, max_rounds: int = 1 << 20) -> DataFrame:
    """(vertex, source, prev, dist): the nearest source of every reachable vertex and the edge towards it.

    ``edges`` (src, dst, weight) are used in the direction given; ``sources`` has ``vertex``.  Ties go to the smaller source,
    then to the smaller previous vertex.  Only vertices improved in the last round send offers in the next.
    """
    kind = edges.schema["weight"].dataType
    start = sources.select("vertex", F.col("vertex").alias("source"), F.lit(None).cast(edges.schema["src"].dataType).alias("prev"), F.lit(0).cast(kind).alias("dist"))
    state = front = cut_in_loop(start.distinct())
    key = F.struct("dist", "source", "prev")
    for _ in range(max_rounds):
        offers = front.join(edges, front["vertex"] == edges["src"]).select(F.col("dst").alias("vertex"), "source", F.col("src").alias("prev"), (F.col("dist") + F.col("weight")).alias("dist"))
        if limit is not None:
            offers = offers.where(F.col("dist") <= limit)
        best = offers.groupBy("vertex").agg(F.min(key).alias("new"))
        old = state.withColumn("old", F.struct("dist", "source"))
        better = best.join(old.select("vertex", "old"), "vertex", "left").where(F.col("old").isNull() | (F.struct("new.dist", "new.source") < F.col("old")))
        front = cut_in_loop(better.select("vertex", "new.source", "new.prev", "new.dist"))
        if front.isEmpty():
            return state
        state = cut_in_loop(state.join(front.select("vertex"), "vertex", "left_anti").union(front.select(*state.columns)))
    raise ValueError("more rounds than allowed")


def shortest_path(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(pos, vertex, dist) of the shortest path from a set to a set, source first; no row where there is none.

    Pointers to earlier vertices double each round, and with them the part of the path that is known, counted from the target.
    """
    found = nearest_source(edges, sources)
    reached = found.join(targets.select("vertex"), "vertex", "left_semi")
    path = cut_in_loop(reached.orderBy("dist", "vertex").limit(1).select("vertex", F.lit(0).cast("long").alias("back")))
    jump, step = cut_in_loop(found.where("prev is not null").select("vertex", "prev")), 1
    while not (more := cut_in_loop(path.join(jump, "vertex").select(F.col("prev").alias("vertex"), (F.col("back") + step).alias("back")))).isEmpty():
        path = path.union(more)
        jump = cut_in_loop(jump.join(jump.select(F.col("vertex").alias("prev"), F.col("prev").alias("further")), "prev").select("vertex", F.col("further").alias("prev")))
        step *= 2
    length = path.agg(F.max("back").alias("last"))
    return path.join(found.select("vertex", "dist"), "vertex").crossJoin(F.broadcast(length)).select((F.col("last") - F.col("back")).alias("pos"), "vertex", "dist")  # one row


def dense_ids(df: DataFrame, key: str, name: str = "dense_id") -> DataFrame:
    """(key, dense_id): 0..k-1 in key order by a range partitioning and partition offsets; no single-partition window."""
    keys = df.select(key).distinct()
    ranged = cut_in_loop(keys.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).withColumn("part", F.spark_partition_id()))
    sizes = {r[0]: r[1] for r in ranged.groupBy("part").count().collect()}  # one number for each partition
    offsets, done = {}, 0
    for p in sorted(sizes):
        offsets[p] = done
        done += sizes[p]
    entries = ",".join(str(offsets.get(p, 0)) for p in range(max(sizes, default=0) + 1))
    first = F.get(F.split(F.lit(entries), ",").cast("array<bigint>"), F.col("part"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return ranged.select(key, (first + rank - 1).alias(name))


def repeated(df: DataFrame, step, rounds: int) -> DataFrame:
    """``step`` applied a number of times, lineage cut every third."""
    for i in range(rounds):
        df = step(df)
        if i % 3 == 2:
            df = cut_in_loop(df)
    return df

