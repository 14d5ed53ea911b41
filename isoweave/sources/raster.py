"""Sources and sinks of fields: raw float volumes, arrays, tables rasterised into a grid, and Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.functions.grid import GridMeta, index, with_coordinates
from isoweave.runtime import table


def rasterise(df: DataFrame, meta: GridMeta, x: Column, y: Column, value: Column, z: Column | None = None, dense: bool = True) -> DataFrame:
    """(vid, x, y, z, value): ``value`` is an aggregate over the rows of each cell; ``dense`` fills missing cells with 0."""
    z = F.lit(0) if z is None else z
    at = df.select("*", x.cast("long").alias("_x"), y.cast("long").alias("_y"), z.cast("long").alias("_z"))
    at = at.where(F.col("_x").between(0, meta.nx - 1) & F.col("_y").between(0, meta.ny - 1) & F.col("_z").between(0, meta.nz - 1))
    sums = at.groupBy(index(meta.shape, F.col("_x"), F.col("_y"), F.col("_z")).alias("vid")).agg(value.alias("value"))
    if dense:
        grid = df.sparkSession.range(meta.size).withColumnRenamed("id", "vid")
        sums = grid.join(sums, "vid", "left").fillna(0, ["value"])
    return with_coordinates(sums, meta).select("vid", "x", "y", "z", "value")


def read_raw(spark: SparkSession, path: str, meta: GridMeta) -> DataFrame:
    """A raw little-endian float32 volume; the file is split by grid rows, never read whole. NaN and infinity are dropped."""
    import numpy as np
    import pyarrow as pa

    def unpack(batches):
        for batch in batches:
            values = [np.frombuffer(b, "<f4").astype(float) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], ["row", "values"])

    records = spark.sparkContext.binaryRecords(path, 4 * meta.nx).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))
    rows = spark.createDataFrame(records, "row long, data binary").where(F.col("row") < meta.ny * meta.nz).mapInArrow(unpack, "row long, values array<double>")
    df = from_rows(rows, meta)
    return df.where(~F.isnan("value") & (F.abs("value") != float("inf"))).select("vid", "x", "y", "z", (F.col("value") + 0.0).alias("value"))


def from_rows(df: DataFrame, meta: GridMeta, row: str = "row", values: str = "values") -> DataFrame:
    """A field from row arrays: one row of the table for each grid row."""
    out = df.select((F.col(row) % meta.ny).alias("y"), F.floor(F.col(row) / meta.ny).alias("z"), F.posexplode(values).alias("x", "value"))
    return out.select(index(meta.shape, F.col("x"), F.col("y"), F.col("z")).alias("vid"), F.col("x").cast("long"), F.col("y").cast("long"), F.col("z").cast("long"), "value")


def masked(field: DataFrame, mask: DataFrame) -> DataFrame:
    """The samples of a sparse field: those whose vertex is in ``mask`` (vid)."""
    return field.join(mask.select("vid"), "vid", "left_semi")


def write_table(df: DataFrame, path: str, tile: Column | None = None) -> None:
    """Parquet, in folders by tile where one is given, so that readers prune."""
    (df.write if tile is None else df.withColumn("tile", tile).repartition("tile").write.partitionBy("tile")).mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_skeleton(nodes: DataFrame, arcs: DataFrame, geometry: DataFrame, path: str) -> None:
    """Living nodes, arcs and their geometry as three tables."""
    for name, df in (("nodes", nodes), ("arcs", arcs), ("geometry", geometry)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_skeleton(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "arcs", "geometry"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


# Fixtures from the driver's tables; values are whole cents, so sums do not depend on the order.

LQ = GridMeta(46, 50)
LQD = GridMeta(24, 10, 11)
EV = GridMeta(120, 30)


def _days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_shipdate"), F.datediff("l_shipdate", F.lit("1992-01-01"))


def lineitem_field(spark: SparkSession, sf_dir: str, dense: bool = True) -> DataFrame:
    """Revenue in cents by eight-week ship period and quantity."""
    df, days = _days(spark, sf_dir)
    value = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return rasterise(df, LQ, F.floor(days / 56) - 19, F.col("l_quantity") - 1, value, dense=dense)


def lineitem_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by sixteen-week ship period, quantity band and discount."""
    df, days = _days(spark, sf_dir)
    return rasterise(df, LQD, F.floor(days / 112) - 9, F.floor((F.col("l_quantity") - 1) / 5), F.count("*"), z=F.round(F.col("l_discount") * 100))


def event_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value in cents by six-hour period and user group."""
    hours = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600)
    df = table(spark, sf_dir, "events").select("ts", "user_id", "value").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return rasterise(df, EV, F.floor(hours / 6), F.col("user_id") % 30, F.sum("cents"))


def user_field(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, GridMeta]:
    """Value in cents by user and six-hour period; the grid grows with the users."""
    events = table(spark, sf_dir, "events").select("ts", "user_id", "value").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    users = (events.agg(F.max("user_id")).first()[0] or 0) + 1  # one number
    hours = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600)
    meta = GridMeta(users, 120)
    return rasterise(events, meta, F.col("user_id"), F.floor(hours / 6), F.sum("cents")), meta
