"""A training corpus from raw documents: five stages, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result to the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import Workspace, scratch, small_batches
from tributary.llm.linedup import line_repeats, without_lines
from tributary.llm.mix import mix_documents, repeat_documents
from tributary.llm.neardup import one_of_each_group
from tributary.llm.packing import pack_documents
from tributary.llm.quality import without_rejected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document (or line) has go, and documents that have nothing left; n_chars follows."""
    out = without_lines(docs, line_repeats(docs), drop_empty=True)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else out[c] for c in out.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the smallest id stays."""
    return one_of_each_group(docs, k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: each document stays as often as the mix takes it, whole."""
    return repeat_documents(docs, mix_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens; written here, where the batches' size can be set."""
    with small_batches(spark):
        return Workspace(spark, "packing").keep(pack_documents(docs))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near), ("mixing", mixing), ("packing", packing)]

#: SQL has neither the tokenizer nor the fitted classifier; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch():  # what a stage has kept for itself goes once its result is written
            docs = ws.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
