"""The SQL front end: peels what Spark's parser doesn't know, then hands the rest to spark.sql.

Roles, masks and time travel act on the base relations: for the analysis of a statement, the tables that it names are
bound to what the role sees of them, so joins, common table expressions, set operations and subqueries all inherit it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.eventlog import FOREVER, offset_as_of, visible_at
from chronofold.operators.relational import fixpoint
from chronofold.plans.explain import plan_tree
from chronofold.plans.text import LIT, check_depth, hide, show, split_list, value, words
from chronofold.policy.access import AccessPolicy, has_consent
from chronofold.policy.masking import MaskRegistry
from chronofold.sources.catalog import Catalog

WHEN = rf"(?:AT\s+OFFSET\s+(\d+)|(?:FOR\s+SYSTEM_TIME\s+)?AS\s+OF\s+(?:TIMESTAMP\s+)?{LIT})"
TRAVEL = re.compile(rf"(\b(?:FROM|JOIN)\s+|,\s*)([A-Za-z_]\w*)\s+{WHEN}(?=\s*($|[A-Za-z_]\w*|\W))", re.I)
AT_END = re.compile(rf"\s+{WHEN}\s*$", re.I)
GLASS = re.compile(rf"^\s*WITH\s+BREAK_GLASS\s+REASON\s*=\s*{LIT}\s*", re.I)
#: Words that may follow a table but aren't its alias.
AFTER = set("where join inner left right full cross natural on using group having order limit offset union intersect except window qualify lateral".split())


def nanoseconds(text: str) -> int:
    t = datetime.fromisoformat(text)
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return int(t.timestamp()) * 1_000_000_000 + t.microsecond * 1000


@dataclass
class Prepared:
    """A statement kept with its engine, run with other parameters or at another offset."""

    engine: Engine
    text: str

    def execute(self, params: list[Any] | None = None) -> DataFrame:
        return self.engine.sql(self.text, params)

    def execute_at(self, offset: int, params: list[Any] | None = None) -> DataFrame:
        return self.engine.sql(f"{self.text.rstrip().rstrip(';')} AT OFFSET {int(offset)}", params)


class Engine:
    """sql() over a catalog; versioned tables add _from and _to, and a commit index for wall-clock travel.

    policy: what the role sees of tables, columns and rows; masks: what it sees of values. consents (subject_id,
    purpose, withdrawn_at, expires_at) with a mode guard query_with_consent.
    """

    def __init__(
        self, spark: SparkSession, catalog: Catalog, versioned: dict[str, DataFrame] | None = None, commits: DataFrame | None = None, policy: AccessPolicy | None = None,
        masks: MaskRegistry | None = None, consents: DataFrame | None = None, consent_mode: str = "Disabled",
    ):
        self.spark, self.catalog, self.versioned, self.commits = spark, catalog, versioned or {}, commits
        self.policy, self.masks, self.consents, self.consent_mode = policy, masks, consents, consent_mode
        self.audit: list[str] = []
        for name in self.versioned:
            self.current(name).createOrReplaceTempView(name)

    # what tables hold, now and then
    def tables(self) -> list[str]:
        return [*self.catalog.frames, *[t for t in self.versioned if t not in self.catalog.frames]]

    def current(self, table: str) -> DataFrame:
        if table in self.versioned:
            return self.versioned[table].filter(F.col("_to") == FOREVER).drop("_from", "_to")
        return self.catalog.frames[table]

    def as_of(self, table: str, offset: int) -> DataFrame:
        if table not in self.versioned:
            raise ValueError(f"{table} keeps no versions")
        return visible_at(self.versioned[table], offset).drop("_from", "_to")

    def head(self) -> int | None:
        """The last offset: of the commit index, or without one of the versions."""
        if self.commits is not None:
            return self.commits.agg(F.max("offset")).first()[0]
        ends = [v.agg(F.max("_from"), F.max(F.when(F.col("_to") < FOREVER, F.col("_to")))).first() for v in self.versioned.values()]
        return max((x for row in ends for x in row if x is not None), default=None)

    def commit_times(self) -> DataFrame:
        if self.commits is None:
            raise ValueError("travel to a time needs a commit index")
        return self.commits

    def _at(self, offset: str | None, time: str | None) -> int:
        if offset is None:
            return offset_as_of(self.commit_times(), nanoseconds(time))
        head = self.head()
        if head is None or int(offset) > head:
            raise ValueError(f"offset {offset} is ahead of the log")
        return int(offset)

    # what a role sees
    def secured(self, table: str, df: DataFrame) -> DataFrame:
        """df with masks, then without the rows and columns that the policy hides; row filters see unmasked values."""
        role = self.policy.role if self.policy else None
        if self.policy:
            rows = self.policy.rows(table, df)
            df = self.masks.secure(table, rows, role) if self.masks else rows
            return df.select(*self.policy.columns(table, df))
        return self.masks.secure(table, df, "") if self.masks else df

    @contextmanager
    def _bound(self, hidden: str, offset: int | None) -> Iterator[list[str]]:
        """Within it, every table named in the text is bound to what may be seen of it; gives the tables denied."""
        named = [t for t in self.tables() if t.lower() in words(hidden)]
        changed, denied = [], []
        for t in named:
            df = self.current(t) if offset is None or t not in self.versioned else self.as_of(t, offset)
            try:
                seen = self.secured(t, df)
            except PermissionError:
                self.spark.catalog.dropTempView(t)
                denied.append(t)
                changed.append(t)
                continue
            if seen is not self.catalog.frames.get(t):
                seen.createOrReplaceTempView(t)
                changed.append(t)
        try:
            yield denied
        finally:
            for t in changed:
                self.current(t).createOrReplaceTempView(t)

    # statements
    def sql(self, text: str, params: list[Any] | None = None) -> DataFrame:
        hidden, kept = hide(text)
        if m := GLASS.match(hidden):
            self.audit.append(value(kept[int(m[1])]))
            hidden = hidden[m.end() :]
        check_depth(hidden)
        plain = hidden.strip().rstrip(";").strip()
        if re.fullmatch(r"SHOW\s+TABLES", plain, re.I):
            return self.catalog.tables().select("table_name")
        if m := re.fullmatch(r"SHOW\s+COLUMNS\s+FROM\s+(\w+)", plain, re.I):
            return self.catalog.columns(m[1])
        if m := re.fullmatch(r"SHOW\s+CLASSIFICATIONS\s+FOR\s+(\w+)", plain, re.I):
            return self.catalog.classifications(m[1])
        for name in {m.lower() for m in re.findall(r"\binformation_schema\.(tables|columns)\b", plain, re.I)}:
            getattr(self.catalog, name)().createOrReplaceTempView(f"information_schema_{name}")
        plain = re.sub(r"\binformation_schema\.(?=(?:tables|columns)\b)", "information_schema_", plain, flags=re.I)
        if m := re.match(r"EXPLAIN\s+(?=SELECT|WITH)", plain, re.I):
            return self.spark.createDataFrame([(plan_tree(self._run(plain[m.end() :], kept, params)),)], "plan string")
        return self._run(plain, kept, params)

    def _recursive(self, plain: str, kept: list[str], params: list[Any] | None) -> DataFrame | None:
        """WITH RECURSIVE name (columns) AS (anchor UNION step): a fixpoint without repeats. None for any other text."""
        m = re.match(r"WITH\s+RECURSIVE\s+(\w+)\s*(?:\(([^)]*)\))?\s+AS\s*\(", plain, re.I)
        if not m:
            return None
        depth, end, cut = 1, m.end(), None
        while end < len(plain) and depth:
            depth += (plain[end] == "(") - (plain[end] == ")")
            if depth == 1 and cut is None and (u := re.compile(r"\bUNION\b(?!\s+ALL\b)(?:\s+DISTINCT\b)?", re.I).match(plain, end)):
                cut = u
            end += 1
        if cut is None:
            return None  # UNION ALL: Spark has it
        name, rest = m[1], plain[end:].strip()
        anchor = self._run(plain[m.end() : cut.start()], kept, params)
        anchor = anchor.toDF(*split_list(m[2])) if m[2] else anchor

        def step(new: DataFrame) -> DataFrame:
            new.createOrReplaceTempView(name)
            return self._run(plain[cut.end() : end - 1], kept, params).toDF(*anchor.columns)

        try:
            fixpoint(anchor, step).createOrReplaceTempView(name)
            return self._run(f"WITH {rest[1:]}" if rest.startswith(",") else rest, kept, params)
        finally:
            self.spark.catalog.dropTempView(name)

    def _run(self, plain: str, kept: list[str], params: list[Any] | None) -> DataFrame:
        if (found := self._recursive(plain, kept, params)) is not None:
            return found
        views: list[str] = []

        def travel(m: re.Match) -> str:
            table = next((t for t in self.tables() if t.lower() == m[2].lower()), None)
            if table is None:
                return m[0]
            at = self._at(m[3], value(kept[int(m[4])]) if m[4] else None)
            view = f"{table}__at_{at}"
            self.secured(table, self.as_of(table, at)).createOrReplaceTempView(view)
            views.append(view)
            alias = m[5] if m[5] and re.match(r"\w", m[5]) and m[5].lower() not in AFTER else ""
            return f"{m[1]}{view}" + ("" if alias else f" AS {table}")

        plain = TRAVEL.sub(travel, plain)
        offset = None
        if m := AT_END.search(plain):
            offset, plain = self._at(m[1], value(kept[int(m[2])]) if m[2] else None), plain[: m.start()]
        given = params or []
        if any(int(n) == 0 or int(n) > len(given) for n in re.findall(r"\$(\d+)", plain)):
            raise ValueError("parameter not found")
        query = show(re.sub(r"\$(\d+)", r":p\1", plain), kept)
        with self._bound(plain, offset) as denied:
            try:
                return self.spark.sql(query, args={f"p{i + 1}": v for i, v in enumerate(given)})
            except AnalysisException as wrong:
                lost = [t for t in denied if wrong.getCondition() == "TABLE_OR_VIEW_NOT_FOUND" and f"`{t.lower()}`" in str(wrong).lower()]
                if lost:
                    raise PermissionError(f"{self.policy.role if self.policy else 'this role'} may not read {lost[0]}") from None
                raise
            finally:
                for view in views:
                    self.spark.catalog.dropTempView(view)

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, text)

    def query_with_consent(self, text: str, subject: Any, purpose: str, at: datetime, params: list[Any] | None = None) -> DataFrame:
        """sql(), if the consent mode lets it: Required needs a consent, Optional notes a missing one, Disabled doesn't look."""
        if self.consent_mode != "Disabled" and not has_consent(self.consents, subject, purpose, at):
            if self.consent_mode == "Required":
                raise PermissionError(f"no consent of {subject} for {purpose}")
            self.audit.append(f"no consent of {subject} for {purpose}")
        return self.sql(text, params)
