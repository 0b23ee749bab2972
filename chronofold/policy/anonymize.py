"""Anonymisation: generalising, partial masks, pseudonyms, k-anonymity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preserve_prefix(c: Column, n: int, sign: str = "*") -> Column:
    return F.concat(F.left(c, F.lit(n)), F.repeat(F.lit(sign), F.greatest(F.length(c) - n, F.lit(0))))


def preserve_suffix(c: Column, n: int, sign: str = "*") -> Column:
    return F.concat(F.repeat(F.lit(sign), F.greatest(F.length(c) - n, F.lit(0))), F.right(c, F.lit(n)))


def per_char(c: Column, sign: str = "*") -> Column:
    return F.repeat(F.lit(sign), F.length(c))


def partial_mask(c: Column, front: int, back: int) -> Column:
    n = F.length(c)
    return F.when(n <= front + back, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(c, F.lit(front)), F.repeat(F.lit("*"), n - front - back), F.right(c, F.lit(back))))


def pseudonym(c: Column) -> Column:
    """PSEUDO- and 16 hexadecimal digits of SHA-256."""
    return F.concat(F.lit("PSEUDO-"), F.substring(F.sha2(c.cast("string"), 256), 1, 16))


def truncate_date(d: Column, to: str) -> Column:
    if to == "quarter":
        return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))
    return F.date_format(d, {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[to])


def generalize_age(age: Column, bucket: int = 5) -> Column:
    low = (F.floor(age / bucket) * bucket).cast("long")
    return F.when(age >= 90, F.lit("90+")).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + bucket - 1).cast("string")))


def generalize_zip(z: Column, keep: int = 3) -> Column:
    return preserve_prefix(z, keep)


def generalize_number(x: Column, bucket: int) -> Column:
    low = (F.floor(x / bucket) * bucket).cast("long")
    return F.concat(low.cast("string"), F.lit("-"), (low + bucket - 1).cast("string"))


def k_anonymity(df: DataFrame, quasi: list[str], target: int) -> DataFrame:
    """(k, classes, satisfied): the smallest equivalence class, and how many there are."""
    sizes = df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.min("n"), F.lit(0)).alias("k"), F.count(F.lit(1)).alias("classes")).withColumn("satisfied", F.col("k") >= target)
