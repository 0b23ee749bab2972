"""A view kept live: every micro-batch of events folds into the stored state of the keys that it touches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.operators.eventlog import current_view
from chronofold.storage import file_system


class LiveView:
    """The current view of events (key, offset, kind, columns, was_set_<column>), kept in versions under a folder.

    fold() is for foreachBatch: it writes version batch + 1 from the one before it, so a batch that comes again after a
    failure gives the same version again. Readers take the last finished version.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], columns: T.StructType):
        self.spark, self.path, self.key, self.columns = spark, path.rstrip("/"), key, columns
        self.names = [f.name for f in columns if f.name not in key]

    def versions(self) -> list[int]:
        fs, path = file_system(self.spark, self.path)
        if not fs.exists(path(self.path)):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(path(self.path)) if fs.exists(path(f"{self.path}/{s.getPath().getName()}/_SUCCESS"))]
        return sorted(int(n.removeprefix("v")) for n in done if n.startswith("v"))

    def read(self, before: int | None = None) -> DataFrame:
        """The state after all batches, or after those before a batch."""
        found = [v for v in self.versions() if before is None or v <= before]
        return self.spark.read.schema(self.columns).parquet(f"{self.path}/v{found[-1]}") if found else self.spark.createDataFrame([], self.columns)

    def fold(self, batch: DataFrame, number: int) -> None:
        old = self.read(number)
        touched = batch.select(*self.key).distinct()
        flags = [F.lit(True).alias(f"was_set_{c}") for c in self.names]
        base = old.join(touched, self.key, "left_semi").select(*self.key, F.lit(-1).cast("long").alias("offset"), F.lit("insert").alias("kind"), *self.names, *flags)
        events = batch.select(*self.key, F.col("offset").cast("long").alias("offset"), "kind", *self.names, *[f"was_set_{c}" for c in self.names])
        new = current_view(base.unionByName(events), self.key, self.names).select(*self.columns.names)
        out = old.join(touched, self.key, "left_anti").select(*self.columns.names).unionByName(new)
        out.write.mode("overwrite").parquet(f"{self.path}/v{number + 1}")


@dataclass
class Subscription:
    """Events of a stream in order, as far as credits go.

    source gives the stream's events (with offset and payload) now, or None once the stream is gone. A tick gives at
    most EVENTS events and BYTES bytes of payload, and takes a credit for each event.
    """

    source: Callable[[], DataFrame | None]
    next_offset: int = 0
    credits: int = 0
    closed: bool = False

    EVENTS, BYTES = 64, 1 << 20

    def grant(self, credits: int) -> None:
        self.credits += credits

    def unsubscribe(self) -> None:
        self.closed = True

    def tick(self) -> list:
        """The next events; none without credits, or once closed. A first event larger than BYTES comes alone."""
        log = None if self.closed else self.source()
        self.closed = log is None
        if self.closed or self.credits <= 0:
            return []
        rows = log.filter(F.col("offset") >= self.next_offset).orderBy("offset").limit(min(self.EVENTS, self.credits)).collect()  # 64 at most
        out, size = [], 0
        for row in rows:
            size += len((row["payload"] or "").encode())
            if out and size > self.BYTES:
                break
            out.append(row)
        if out:
            self.next_offset, self.credits = out[-1]["offset"] + 1, self.credits - len(out)
        return out
