"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deliverix.llm import (
    centroid_clusters,
    classifier,
    decontamination,
    fill_in_middle,
    html_extract,
    jaccard_join,
    line_dedup,
    lm_scoring,
    mixing,
    quality_rules,
    secret_scan,
    substring_dedup,
    token_output,
)
from deliverix.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]

_SHIPPED: set[str] = set()
#: Rows that Spark hands to Python at once: texts of some KB make batches of some MB, which both sides hold whole.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application, and keep the session's Arrow batches small.

    A smaller setting of the session stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    into = tempfile.mkdtemp(prefix="deliverix-zip-")
    sc.addPyFile(shutil.make_archive(f"{into}/deliverix-{sc.applicationId}", "zip", os.path.dirname(package), os.path.basename(package)))


def _on(query: Callable[..., DataFrame], *tables: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(*[table(spark, sf_dir, t) for t in tables])
    return run


QUERIES: dict[str, Query] = {
    "op1_line_dedup": _on(line_dedup.query, "documents"),
    "op2_token_output": _on(token_output.query, "documents"),
    "op3_substring_dedup": _on(substring_dedup.query, "documents"),
    "op4_jaccard_join": _on(jaccard_join.query, "documents"),
    "op5_mixing": _on(mixing.query, "documents"),
    "op6_quality_rules": _on(quality_rules.query, "documents"),
    "op7_decontamination": _on(decontamination.query, "documents", "benchmark"),
    "op8_quality_classifier": _on(classifier.query, "documents", "labels"),
    "op9_html_extraction": _on(html_extract.query, "pages"),
    "op10_lm_scoring": _on(lm_scoring.query, "documents"),
    "op11_fill_in_middle": _on(fill_in_middle.query, "documents"),
    "op12_secret_scan": _on(secret_scan.query, "documents"),
    "op13_centroid_clusters": _on(centroid_clusters.query, "embeddings"),
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op5_mixing": mixing.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op7_decontamination": decontamination.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
    "op12_secret_scan": secret_scan.SQL,
    "op13_centroid_clusters": centroid_clusters.SQL,
}
