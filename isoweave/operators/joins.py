"""Joins for keys that may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.runtime import cut

#: most frequent keys whose matches are broadcast; each other key holds at most this part of the rows
HOT = 1024


def lookup(left: DataFrame, right: DataFrame, on: str, counts: DataFrame | None = None) -> DataFrame:
    """The left join of ``left`` with ``right``, whose ``on`` is unique; null keys find nothing.

    The matches of the ``HOT`` most frequent keys, that many rows at most, are broadcast.  The other rows are shuffled, and none
    of their keys holds more than one part in ``HOT``.  ``left`` is read several times, so it should be cheap or cut.
    ``counts`` (on, n) has the rows of each key where they are known already.
    """
    more = [c for c in right.columns if c != on]
    if counts is None:
        counts = left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("n"))
    frequent = counts.where("n > 1").orderBy(F.desc("n")).limit(HOT).select(on)
    hot = cut(right.join(F.broadcast(frequent), on, "left_semi")).select(on, *[F.col(c).alias(f"_hot_{c}") for c in more], F.lit(True).alias("_hot"))
    met = left.join(F.broadcast(hot), on, "left")
    done = met.where(F.col("_hot") | F.col(on).isNull()).select(*left.columns, *[F.col(f"_hot_{c}").alias(c) for c in more])
    rest = met.where(F.col("_hot").isNull() & F.col(on).isNotNull()).select(*left.columns)
    return done.union(rest.join(right, on, "left").select(*left.columns, *more))
