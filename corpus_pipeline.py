"""The training-data pipeline: documents through five of the operators.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deliverix.llm import classifier, decontamination, jaccard_join, mixing, token_output
from deliverix.llm.queries import ship_package
from deliverix.llm.shared import fold_of, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels outside the held-out fold."""
    ship_package(spark)
    held = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return classifier.keep_good(docs, classifier.fit(docs, table(spark, sf_dir, "labels").where(~held)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship_package(spark)
    return jaccard_join.keep_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    ship_package(spark)
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records in files, and each record's place, length and checksum read back from them."""
    ship_package(spark)
    return token_output.query(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: The classifier cannot be stated in SQL; tests/llm/test_pipeline.py holds the stages and run() against plain Python (the classifier against its scores).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name))
    return docs
