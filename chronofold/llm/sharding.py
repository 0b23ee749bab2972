"""Sharding along a Hilbert curve.

Several metadata columns are quantised at their own quantiles, each row gets its place on the Hilbert curve
through that grid, and the curve is cut into runs of equal row counts. Rows that are near in every dimension
share a shard, so the min/max statistics of a shard's files prune on any of the dimensions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, ranked, running, saved

BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid points (n, dims), each coordinate below 2**bits (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def as_number(df: DataFrame, column: str) -> Column:
    """A double in the column's own order, for numbers and times."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType | T.BooleanType):
        return F.col(column).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.col(column).cast("timestamp").cast("double")
    raise TypeError(f"{column} is neither a number nor a time")


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType | T.BinaryType)


def text_cuts(df: DataFrame, column: str, cells: int) -> list:
    """At most cells - 2 whole values that cut the column's rows into even parts, ascending.

    Distinct values are counted, put in order by ranges and weighed by their rows; a value with many rows is a cell
    of its own.
    """
    counts = saved(df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n")), "values")
    values, rows = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not values:
        return []
    placed = running(counts, [F.col("v")], {"before": F.col("n")}, values)
    cell = F.floor(F.col("before") * (cells - 1) / rows)
    least = placed.groupBy(cell.alias("cell")).agg(F.min("v").alias("v")).filter("cell > 0")
    return sorted((r["v"] for r in least.collect()), key=lambda v: v.encode() if isinstance(v, str) else bytes(v))  # fewer than cells


def with_hilbert(df: DataFrame, dims: list[str], bits: int = BITS, out: str = "hilbert") -> DataFrame:
    """df with its place on the curve. Quantiles cover all rows and whole values; nulls take cell 0 of their dimension."""
    cells = 2**bits
    steps = [i / (cells - 1) for i in range(1, cells - 1)]
    numbers = {d: as_number(df, d) for d in dims if not is_text(df, d)}
    cuts = df.select(F.lit(0), *[F.percentile_approx(n, steps, 1000).alias(f"q{i}") for i, n in enumerate(numbers.values())]).first() if numbers else [None]
    bounds = {d: np.unique(np.array(c if c is not None else [], dtype=float)) for d, c in zip(numbers, cuts[1:], strict=True)}
    columns = []
    for d in dims:
        if d in numbers:
            columns.append(numbers[d])
        else:
            above = [(F.col(d) >= F.lit(v)).cast("int") for v in text_cuts(df, d, cells)]
            columns.append(F.coalesce(sum(above, F.lit(1)), F.lit(0)).cast("double"))
    limits = [bounds.get(d) for d in dims]

    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        grid = []
        for c, b in zip(columns, limits, strict=True):
            x = c.to_numpy(dtype=float, na_value=np.nan)
            grid.append(x if b is None else np.where(np.isnan(x), 0, np.searchsorted(b, x, side="right") + 1))
        return pd.Series(hilbert_index(np.minimum(np.stack(grid, axis=1), cells - 1), bits))

    return df.withColumn(out, place(*columns))


def hilbert_shards(df: DataFrame, dims: list[str], shards: int, ties: list[str], bits: int = BITS) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (0, 1, ... inside its shard), in curve order.

    Law: the counts of any two shards differ by one at most. Ties on the curve go by the columns in ties, nulls
    first; rows equal in all of them are interchangeable. An empty table stays empty. With fewer rows than
    shards some shards stay empty. The columns hilbert, shard and slot replace any input columns so named.
    """
    placed = with_hilbert(df.drop("hilbert", "shard", "slot"), dims, bits)
    rank, size, count = free(placed, "_rank", "_size", "_count")
    laid, total = ranked(placed, [F.col("hilbert").asc(), *[F.col(c).asc_nulls_first() for c in ties]], rank)
    laid = laid.withColumn(size, F.lit(max(total, 1)).cast("long")).withColumn(count, F.lit(shards).cast("long"))
    laid = laid.withColumn("shard", F.expr(f"cast(`{rank}` * `{count}` div `{size}` as int)"))
    return laid.withColumn("slot", F.expr(f"`{rank}` - (shard * `{size}` + `{count}` - 1) div `{count}`")).drop(rank, size, count)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order; each file's statistics cover a run of the curve."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def op1_hilbert_shards(spark, sf_dir: str, shards: int = 24) -> DataFrame:
    """All documents in 24 shards by language, source and size. Null texts count 8 bytes and have the crc of ''."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = docs.select("doc_id", "lang", "source", text_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
    out = hilbert_shards(narrow, ["lang", "source", "size"], shards, ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
