"""The durable change log: events of all tables in one order of offsets, committed atomically.

A commit is a file named by the offset that it starts at, made only if it isn't there (the file system must create files
exclusively, as HDFS and local disks do): of two writers that expect the same head, one succeeds. Events lie in Parquet folders that a commit names, so what isn't committed is never read.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.storage import file_system, new_path, numbered


@dataclass
class Commit:
    begin: int
    end: int
    ns: int
    table: str
    data: str


class ChangeLog:
    """append() and read() over a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or new_path(spark, "changelog")
        self.fs, self.path = file_system(spark, self.root)
        self._known: dict[str, Commit] = {}

    def commits(self) -> list[Commit]:
        """All commits in order; the files of those seen before aren't read again."""
        folder = self.path(f"{self.root}/commits")
        if not self.fs.exists(folder):
            return []
        for status in self.fs.listStatus(folder):
            name = status.getPath().getName()
            if name not in self._known and status.getLen() > 0:
                stream = self.fs.open(status.getPath())
                try:
                    self._known[name] = Commit(**json.loads(bytes(stream.readAllBytes()).decode()))
                finally:
                    stream.close()
        return sorted(self._known.values(), key=lambda c: c.begin)

    def head(self) -> int:
        """The offset that the next event gets."""
        return max((c.end for c in self.commits()), default=0)

    def append(self, table: str, events: DataFrame, order: list[str], expected: int | None = None) -> Commit | None:
        """Commit the events of a table in the given order; fails if the head is another than expected, also if it moves meanwhile."""
        head = self.head()
        if expected is not None and head != expected:
            raise ValueError(f"expected offset {expected}, head is {head}")
        rows, n = numbered(events, [F.col(c).asc_nulls_first() for c in order], "offset", head)
        if not n:
            return None
        data = f"{self.root}/data/{table}-{uuid.uuid4().hex}"
        rows.write.parquet(data)
        ns = max([time.time_ns(), *(c.ns + 1 for c in self.commits()[-1:])])
        commit = Commit(head, head + n, ns, table, data)
        folder = self.path(f"{self.root}/commits")
        self.fs.mkdirs(folder)
        try:
            out = self.fs.create(self.path(f"{self.root}/commits/{head:020d}"), False)
        except Exception as taken:
            raise ValueError(f"another writer has committed offset {head}") from taken
        out.write(json.dumps(commit.__dict__).encode())
        out.close()
        return commit

    def recover(self) -> int:
        """Remove commits that a writer claimed but, lost meanwhile, never filled in; gives their number. For no writer's time."""
        folder, n = self.path(f"{self.root}/commits"), 0
        for status in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
            if status.getLen() == 0:
                n += bool(self.fs.delete(status.getPath(), False))
        return n

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """(offset, kind, columns, was_set_<column>) of a table's committed events; columns that a file lacks are null."""
        flags = [T.StructField(f"was_set_{f.name}", T.BooleanType()) for f in schema]
        full = T.StructType([T.StructField("offset", T.LongType()), T.StructField("kind", T.StringType()), *schema.fields, *flags])
        folders = [c.data for c in self.commits() if c.table == table]
        return self.spark.read.schema(full).parquet(*folders) if folders else self.spark.createDataFrame([], full)

    def times(self) -> DataFrame:
        """(offset, commit_ns): the last offset of each commit and its time, strictly increasing."""
        return self.spark.createDataFrame([(c.end - 1, c.ns) for c in self.commits()], "offset long, commit_ns long")
