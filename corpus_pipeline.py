"""A cleaning pipeline over `documents`: each stage calls one operator on what the stage before it kept.

Defined results, as in the operators' docstrings: null texts count as empty and may be rejected or left out like others; rows without an id, or with
the same id and other texts, are documents of their own in all stages; of rows alike in id and text the join keeps one. Ties are broken
by id, then by a key of the row. Tables may be empty: without labels nothing is rejected, without benchmark items
nothing is a leak, and without documents the result has no rows. Columns of any name stay as they are, but for `text`, `n_chars` and,
in the last stage, `epoch`. Very long texts are worked on in one task each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from terrane.sources.scratch import table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text's score is under the threshold go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, all documents stay."""
    return line_dedup.line_dedup(docs, counts=False)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return ngram_join.keep_one(docs)


def _leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents by epoch, without those of which nothing is taken."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", _quality),
    ("line dedup", _lines),
    ("n-gram Jaccard join", _near),
    ("benchmark decontamination", _leaks),
    ("mixing to target weights", _mix),
]

#: Not every stage can be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents in sf_dir; lineage is cut between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs)
    return docs
