"""A corpus from documents to packed sequences: quality rules, one of each group of near copies, no benchmark passages, no secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import decontamination, jaccard, packing, quality, secrets, shared
from textquarry.llm.tokens import vocabulary


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and frequent lines from the others' texts; n_chars counts what is there then.

    A null text is empty and goes; a null source is a source of its own; of documents with one line that with the least doc_id
    keeps it; repeated rows share a verdict and stay as often as they are there. An empty table gives an empty one.
    """
    return _counted(quality.keep_good(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays.

    Rows that repeat a doc_id are documents of their own, a null doc_id comes last; of rows that repeat doc_id and text the
    least as JSON stays. Null texts, and texts without words, are one group. An empty table gives an empty one.
    """
    return jaccard.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    A null or empty text holds none, and a null or empty item is in none; repeated rows go or stay together; a null doc_id is as
    any. Either table may be empty.
    """
    return decontamination.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars counts what is there then.

    A null text stays null, with its n_chars; spans that touch or overlap are one; all rows stay, repeated ones too.
    """
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences and offsets.

    A null text is the end id alone; rows that repeat a doc_id are documents of their own; a null doc_id stays null; pieces of
    one length may change places. An empty table gives no rows.
    """
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("secret scans", secret_scan), ("best-fit packing", pack)]

#: Near copies, edit distances and packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again; what a stage leaves there besides is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for n, (_, stage) in enumerate(STAGES):
        docs = shared.written(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{n}")
        if last is not None:
            shared.discard(last)
        last = docs
    return docs
