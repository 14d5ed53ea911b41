"""A corpus pipeline: toxic documents, documents without a clear language, near copies and benchmark leaks go; the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on every document that its predecessor kept.  All but the last return the
columns of their input, whatever these are.  ``run`` writes each stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.llm import near_copies, op1_langid, op5_toxicity, op7_sentencepiece, op8_latent
from isoweave.runtime import checkpoint_root, column, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go."""
    model = op5_toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows = op5_toxicity.predict(docs.select(F.struct(*map(column, docs.columns)).alias("row"), F.col("text").alias("_text")), model, text="_text")
    return rows.where("predicted = 0").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose margin between languages is narrow, go."""
    model = op1_langid.fit(docs.where(op1_langid.remainder("doc_id", 5) != 0))
    rows = op1_langid.predict(docs.select(F.struct(*map(column, docs.columns)).alias("row"), F.col("text").alias("_text")), model, text="_text")
    return rows.where("not rejected").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies (SimHash, compared bit-sliced; then five-word shingles at 0.8) stays: the smallest id."""
    return near_copies.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return op8_latent.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document that is left."""
    found = op7_sentencepiece.encode(docs, op7_sentencepiece.default_model())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: the classifiers and the latent space have no SQL form; tests/llm/test_pipeline.py holds the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = table(spark, sf_dir, "documents"), f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
