"""Spark session set-up."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                driver_memory: str = "8g", app_name: str = "deliverix") -> SparkSession:
    """Local/test session: UTC, AQE with skew-join handling, ANSI on, no UI."""
    master = master or os.environ.get("DELIVERIX_MASTER", "local[*]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # joins turn into broadcasts by the measured bytes of a side, never by an estimate of rows
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32m")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for intermediate data (``spark.checkpoint.dir``).

    Executors of a cluster can only exchange files through a folder that all
    of them see, so an unset ``spark.checkpoint.dir`` is an error there.  Only
    a ``local*`` master (driver and executors are one process) gets a
    temporary folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(
                f"spark.checkpoint.dir is not set and the master is {sc.master}: "
                "name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="deliverix-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current
