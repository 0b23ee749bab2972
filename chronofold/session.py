"""Session settings that every query assumes: ANSI, UTC, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", name: str = "chronofold", **more: str) -> SparkSession:
    """A session for one machine; on a cluster, use the cluster's own session with SETTINGS."""
    builder = SparkSession.builder.master(master).appName(name).config(map=SETTINGS)
    if master.startswith("local"):
        builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    spark = builder.config(map=more).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
