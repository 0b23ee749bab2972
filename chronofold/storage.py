"""Folders that driver and executors share, and rows numbered without a single-task sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = own.get() if own.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="chronofold-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Path class) of a path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[Column], name: str, first: int = 0) -> tuple[DataFrame, int]:
    """df with name counting up from first in the order of keys, and the number of rows.

    One range shuffle, written once; a row's number is its place in its range plus the sizes of the ranges before, so
    only one row per range meets anywhere.
    """
    spark = df.sparkSession
    path = new_path(spark, "numbered")
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    laid = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_at", T.LongType())])).parquet(path).withColumn("_range", F.shiftright("_at", 33))
    sizes = laid.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    # one row per range partition
    out = laid.join(F.broadcast(before), "_range").withColumn(name, F.lit(first) + F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_range", "_at", "_before"), total
