"""What the operators of this package share: shared storage, global ranks, checked broadcasts, byte-level words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space; every other character belongs to a word.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: A-Z to a-z and nothing else. bytes.split() cuts at exactly the characters of WORD_GAP.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_ASCII, LOWER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes that may be broadcast; beyond either the same join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Rows of narrow tables that one task takes.
TASK_ROWS = 100_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, batches of 1,000 rows instead of Spark's default of 10,000 go to Python; a setting of one's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if before == "10000":
        spark.conf.set(key, "1000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where that setting is absent, as in tests on one machine, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jvm_dir.get() if jvm_dir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="chronofold-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    tasks: at most so many write, for tables known to be small. The folder belongs to the run; whoever owns
    spark.checkpoint.dir removes it afterwards.
    """
    path = shared_path(df.sparkSession, name)
    (df if tasks is None else df.coalesce(tasks)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many narrow rows: in proportion, up to the session's shuffle partitions."""
    return min(partitions(spark), 1 + rows // TASK_ROWS)


def small_enough(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its rows and bytes (measured now) are few enough; else df, and the join shuffles."""
    rows = BROADCAST_ROWS if rows is None else rows
    loose = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    wide = [F.octet_length(F.col(c)) for c in loose] + [F.octet_length(F.to_json(F.struct(c))) for c in nested]
    each = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16 * len(df.columns)))
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(each.cast("long"))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df


def running(df: DataFrame, keys: list[Column], sums: dict[str, Column], rows: int | None = None) -> DataFrame:
    """df with, for each name in sums, the sum of its column over the rows before in the order of keys.

    One range shuffle; sums inside each range, plus the totals of the ranges before it, so no task sees more than
    one range and only one row per range meets anywhere. rows: how many df has, if known, to size the ranges.
    Rows equal in all keys come in any order.
    """
    spark = df.sparkSession
    n = partitions(spark) if rows is None else tasks_for(spark, rows)
    at, part, *parts = free(df, "_at", "_range", *[f"_before_{k}" for k in sums])
    laid = df.select("*", *[c.alias(k) for k, c in sums.items()]).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    laid = saved(laid.withColumn(at, F.monotonically_increasing_id()), "running").withColumn(part, F.shiftright(at, 33))
    totals = laid.groupBy(part).agg(*[F.sum(k).alias(p) for k, p in zip(sums, parts, strict=True)])
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition: bounded by the partition count, whatever the data
    before = F.broadcast(totals.select(part, *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(p) for p in parts]))
    inside = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    out = laid.join(before, part).withColumns({k: F.col(p) + F.coalesce(F.sum(k).over(inside), F.lit(0)) for k, p in zip(sums, parts, strict=True)})
    return out.drop(at, part, *parts)


def ranked(df: DataFrame, keys: list[Column], rank: str, rows: int | None = None) -> tuple[DataFrame, int]:
    """df with its 0-based place in the order of keys, and the number of rows.

    One range shuffle; ranks come from the row numbers inside each range plus the sizes of the ranges before
    it, so no task sees more than one range and only one row per range meets anywhere.
    """
    spark = df.sparkSession
    n = partitions(spark) if rows is None else tasks_for(spark, rows)
    at, part, size, first = free(df, "_at", "_range", "_n", "_before")
    laid = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    laid = saved(laid, "ranked").withColumn(part, F.shiftright(at, 33))
    sizes = laid.groupBy(part).agg(F.count(F.lit(1)).alias(size))
    before = sizes.select(part, (F.sum(size).over(Window.orderBy(part)) - F.col(size)).alias(first))
    total = sizes.agg(F.sum(size)).first()[0] or 0
    local = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    # one row per range partition: bounded by the partition count, whatever the data
    out = laid.join(F.broadcast(before), part).withColumn(rank, F.col(first) + local)
    return out.drop(part, at, first), total


def word_count(text: Column) -> Column:
    """Number of words, JVM-side; 0 for null, empty and blank texts."""
    core = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(text.isNull() | (core == ""), F.lit(0)).otherwise(F.size(F.split(core, WORD_GAP))).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER_ASCII, LOWER_ASCII)


class WordHashes:
    """64-bit hashes of words (bytes), remembered up to a bound so that common words are hashed once."""

    def __init__(self, limit: int = 400_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known, h = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = h(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (multiply and shift, three rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of width consecutive entries; order counts."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mixed(out * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n] + np.uint64(k + 1))
    return out
