"""Session factory with the settings the operators are designed for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session: UTC, ANSI, adaptive execution.

    ``shuffle_partitions`` is only a starting point, AQE coalesces small partitions and splits skewed joins: many on a
    cluster, few on one machine.  On a cluster leave ``master`` unset, spark-submit provides it.
    """
    existing = SparkSession.getActiveSession()
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    wanted = shuffle_partitions or os.environ.get("TIDEMARK_SHUFFLE_PARTITIONS")
    if wanted or existing is None:  # a session that is reused keeps its own
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted or (8 if spark.sparkContext.master.startswith("local") else 4000)))
    return spark
