"""The ordered log and its views: append, commit-time index, current-state fold, versions, time travel, hash chain.

A change log has stream_id, offset, kind, key, set (map of column to text, null values allowed) and commit_ns. Kinds: insert,
upsert_update, update, delete.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.storage import numbered

#: Kinds of events in a change log.
KINDS = ("insert", "update", "upsert_update", "delete")
FOREVER = (1 << 63) - 1


def append(log: DataFrame, events: DataFrame, expected: int) -> DataFrame:
    """log with events after its head; fails if the head isn't the expected offset. events have the column seq.

    Both are DataFrames of this session; writers that race append through a ChangeLog, whose commits are atomic.
    """
    head = log.agg(F.coalesce(F.max("offset"), F.lit(-1)).alias("h")).first()[0] + 1
    if head != expected:
        raise ValueError(f"expected offset {expected}, head is {head}")
    return log.unionByName(numbered(events, [F.col("seq")], "offset", head)[0].drop("seq"))


def read_from(log: DataFrame, stream: str, offset: int, max_bytes: int | None = None) -> DataFrame:
    """Events of a stream from an offset on, as many as fit in max_bytes of payload."""
    rows = log.filter((F.col("stream_id") == stream) & (F.col("offset") >= offset))
    if max_bytes is None:
        return rows
    size = F.sum(F.octet_length("payload")).over(Window.partitionBy("stream_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_b", size).filter(F.col("_b") <= max_bytes).drop("_b")


def commit_index(commits: DataFrame, stream: list[str], block: int = 1 << 16) -> DataFrame:
    """Strictly increasing commit times: a time not after its predecessor becomes the predecessor's plus 1.

    max(previous + 1, ns) over offsets is the running maximum of ns - i, plus i. Both run inside blocks of offsets, and
    over one row per block, so a long stream is spread over its blocks.
    """
    part = commits.withColumn("_block", F.floor(F.col("offset") / block))
    inside = Window.partitionBy(*stream, "_block").orderBy("offset")
    part = part.withColumn("_i", F.row_number().over(inside).cast("long"))
    blocks = part.groupBy(*stream, "_block").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("commit_ns") - F.col("_i")).alias("_max"))
    earlier = Window.partitionBy(*stream).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    blocks = blocks.withColumn("_high", F.max(F.col("_max") - F.col("_before")).over(earlier)).drop("_n", "_max")
    joined = part.join(blocks, [*stream, "_block"])
    i = F.col("_i") + F.col("_before")
    running = F.max(F.col("commit_ns") - i).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.withColumn("commit_ns", F.greatest(running, F.col("_high")) + i).select(*commits.columns)


def offset_as_of(index: DataFrame, ns: int) -> int:
    """Greatest offset committed at or before ns; fails before the first commit."""
    row = index.filter(F.col("commit_ns") <= ns).agg(F.max("offset")).first()
    if row[0] is None:
        raise ValueError("time is before the retention horizon, or the log is empty")
    return row[0]


def as_of_offset(log: DataFrame, offset: int) -> DataFrame:
    return log.filter(F.col("offset") <= offset)


def current_view(log: DataFrame, key: list[str], columns: list[str], flags: str = "was_set_") -> DataFrame:
    """The latest row of each key from (key, offset, kind, columns, was_set_<column>): one aggregation by key.

    The fold starts at the key's latest insert, upsert or delete, so an earlier life never shines through; each
    column takes its last assignment since, null assignments included; keys whose last base is a delete are gone.
    An event of an unknown kind is an error. Every part is an aggregate that combines before the shuffle, so a key
    with any number of events sends one row a task.
    """
    known = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown event kind "), F.coalesce("kind", F.lit("null")))).cast("string"))
    base = F.when(known.isin("insert", "upsert_update", "delete"), F.col("offset"))
    parts = [F.max(base).alias("_start"), F.max_by(F.col("kind"), base).alias("_base")]
    for i, c in enumerate(columns):
        at = F.when(F.col(flags + c), F.col("offset"))
        parts += [F.max(at).alias(f"_at{i}"), F.max_by(F.col(c), at).alias(f"_v{i}")]
    folded = log.groupBy(*key).agg(*parts).filter(F.col("_start").isNotNull() & (F.col("_base") != "delete"))
    return folded.select(*key, *[F.when(F.col(f"_at{i}") >= F.col("_start"), F.col(f"_v{i}")).alias(c) for i, c in enumerate(columns)])


def versions(log: DataFrame, key: list[str]) -> DataFrame:
    """Every state with its interval of offsets [_from, _to)."""
    order = Window.partitionBy(*key).orderBy("offset")
    return log.withColumn("_from", F.col("offset")).withColumn("_to", F.coalesce(F.lead("offset").over(order), F.lit(FOREVER))).filter(F.col("kind") != "delete")


def visible_at(versioned: DataFrame, offset: int) -> DataFrame:
    return versioned.filter((F.col("_from") <= offset) & (F.lit(offset) < F.col("_to")))


def compact(versioned: DataFrame, min_visible: int) -> DataFrame:
    """Versions that some reader at min_visible or later can still see."""
    return versioned.filter(F.col("_to") > min_visible)


def replay(events: DataFrame, key: list[str], order: str, apply: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A general reducer over each key's events in order, where no built-in aggregate can say it."""
    return events.groupBy(*key).applyInPandas(lambda pdf: apply(pdf.sort_values(order, kind="stable")), schema)


def replay_linear(events: DataFrame, key: list[str], order: str, sets: Column, adds: Column) -> DataFrame:
    """(key, state): each key's events in order, where an event either sets the state (sets isn't null) or adds to it.

    Built-in aggregates say this: the value of the last set plus what was added since; a state starts at 0.
    """
    rows = events.withColumn("_set", sets).withColumn("_add", adds)
    last = F.max(F.when(F.col("_set").isNotNull(), F.col(order))).over(Window.partitionBy(*key))
    since = rows.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col(order) >= F.col("_last")))
    added = F.sum(F.when(F.col("_set").isNull(), F.coalesce("_add", F.lit(0))).otherwise(F.col("_set")))
    return since.groupBy(*key).agg(added.alias("state"))


def record_hash(prev: Column, kind: Column, payload: Column) -> Column:
    return F.sha2(F.concat(prev, kind, payload), 256)


def build_chain(log: DataFrame, stream: list[str]) -> DataFrame:
    """log with prev_hash and hash: sequential inside a stream, parallel across streams."""
    import hashlib

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        prev, prevs, hashes = "0" * 64, [], []
        for kind, payload in zip(pdf["kind"], pdf["payload"], strict=True):
            prevs.append(prev)
            prev = hashlib.sha256(f"{prev}{kind}{payload}".encode()).hexdigest()
            hashes.append(prev)
        return pdf.assign(prev_hash=prevs, hash=hashes)

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in log.schema)}, prev_hash string, hash string"
    return log.groupBy(*stream).applyInPandas(link, schema)


def verified(log: DataFrame, stream: list[str], checkpoint: DataFrame | None = None) -> DataFrame:
    """log without prev_hash and hash, once its chain has been checked; raises if a link is broken.

    checkpoint (stream, offset, hash): links known to be right. Reading starts behind them, and each stream's first
    link must follow from its checkpoint.
    """
    if checkpoint is not None:
        known = checkpoint.select(*stream, F.col("offset").alias("_from"), F.col("hash").alias("_known"))
        log = log.join(F.broadcast(known) if known.limit(10_001).count() <= 10_000 else known, stream, "left").filter(F.col("_from").isNull() | (F.col("offset") > F.col("_from")))
    else:
        log = log.withColumn("_known", F.lit(None).cast("string"))
    bad = broken_links(log, stream, F.coalesce("_known", F.lit("0" * 64))).limit(1).collect()
    if bad:
        raise ValueError(f"the chain is broken at offset {bad[0]['offset']}")
    return log.drop("prev_hash", "hash", "_known", "_from")


def broken_links(log: DataFrame, stream: list[str], start: Column | None = None) -> DataFrame:
    """Rows whose hash isn't that of their content, or whose prev_hash isn't their predecessor's hash. Parallel.

    start: what the first row of a stream follows, 64 zeros unless given.
    """
    before = F.coalesce(F.lag("hash", 1).over(Window.partitionBy(*stream).orderBy("offset")), F.lit("0" * 64) if start is None else start)
    return log.withColumn("_before", before).filter((F.col("prev_hash") != F.col("_before")) | (F.col("hash") != record_hash(F.col("prev_hash"), F.col("kind"), F.col("payload")))).drop("_before")
