"""Session defaults for local tests and the bench; on a cluster the submitted settings win."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", app: str = "rainshade", shuffle_partitions: int | None = None,
                  checkpoint_dir: str | None = None) -> SparkSession:
    """Build a local session with the settings the operators assume: UTC, AQE, skew joins, no UI.

    checkpoint_dir becomes spark.checkpoint.dir, the shared folder for tables that are written and read again; on one machine a
    folder of that machine is shared, and one is made where neither the caller nor Spark's defaults name any.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        # the setting is read when a context starts
        spark.stop()
        spark = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
