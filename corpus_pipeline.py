"""A training-data pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, minhash, packing, pii, toxicity
from tidemark.llm.common import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, by a model of the labelled ones that are not held out. A null or empty text is
    scored as an empty one and stays if that is below; rows that repeat an id, or have none, are scored each.
    Where all labels are of one class their share decides; no documents give no rows. All columns stay."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked at 0.8 over shingles of five words. Documents without words
    and rows without an id are linked with nothing and stay; rows that share an id are one document and stay together.
    All columns stay."""
    found = minhash.near_duplicates(docs, size=5, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks. Null and empty texts stay; each row is decided by its
    own text, whether it repeats another row or has no id. An empty benchmark lets all pass. All columns stay."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced; n_chars follows the new text. A null text stays
    null, with n_chars null; repeated rows are each done alike. All columns stay."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, placed in sequences. A null or empty text is one end id; repeated rows and those
    without an id are packed each; no documents give no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", remove_pii),
    ("packing", pack),
]

#: No stage but the third's join can be said in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
