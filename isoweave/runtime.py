"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of this name, whatever dots, spaces or quotes the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema: StructType) -> DataFrame:
    """``df.mapInArrow`` for columns of any names, which that method looks up by unquoted name."""
    given, made = df.columns, schema.names
    plain = StructType([StructField(f"_{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterator) -> Iterator:
        for batch in run(b.rename_columns(given) for b in batches):
            yield batch.rename_columns(plain.names)

    return df.toDF(*[f"_{i}" for i in range(len(given))]).mapInArrow(renamed, plain).toDF(*made)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only in local mode, where there is one machine, a temporary folder of our own takes the place of a missing setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root is None:
        root = context.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def cut_in_loop(df: DataFrame) -> DataFrame:
    """``cut`` without the plan's estimated size.

    A checkpoint keeps that size and every join multiplies it, so in a loop of joins its digits triple each round until planning
    no longer ends; without an estimate the sizes seen at run time decide.
    """
    done, spark = cut(df)._jdf, df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)
