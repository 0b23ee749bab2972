"""Retention, breach detection, audit queries, subject export and erasure, export scopes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shortest retention in days, and breach thresholds.
MIN_RETENTION = {"PHI": 2190, "Financial": 2555, "PCI": 365}
MASS_EXPORT_RECORDS, DENIED_PER_WINDOW, VOLUME_FACTOR, EXFILTRATION_BYTES, WINDOW_SECONDS = 1000, 10, 5.0, 100 * 1024 * 1024, 60


def min_retention(data_class: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, days in MIN_RETENTION.items():
        out = out.when(data_class == name, F.lit(days))
    return out


def retention_action(age_days: Column, max_days: Column, min_days: Column, hold: Column) -> Column:
    """Past the maximum: a hold stops deletion, an unmet minimum retains, else Delete. Within 30 days of it: a warning."""
    past = F.when(hold, F.lit("HoldActive")).when(age_days < min_days, F.lit("Retain")).otherwise(F.lit("Delete"))
    return F.when(max_days.isNotNull() & (age_days >= max_days), past).when(max_days.isNotNull() & (max_days - age_days <= 30), F.lit("ExpiringWarning")).otherwise(F.lit("Retain"))


def off_hours(ts: Column) -> Column:
    return ~F.hour(ts).between(9, 16)


def count_breaches(events: DataFrame, actor: str, ts: str, limit: int, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(actor, ts, count) of each alarm: limit events in a window that restarts when it lapses and when it fires.

    Each window depends on where the last one ended, so an actor's events are walked in order; actors run apart.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        start, n, fired = None, 0, []
        for t in pdf[ts].sort_values():
            if start is None:
                start = t
            if (t - start).total_seconds() > seconds:
                start, n = t, 0
            n += 1
            if n >= limit:
                fired.append((pdf[actor].iloc[0], t, n))
                start, n = None, 0
        return pd.DataFrame(fired, columns=[actor, ts, "count"])

    kinds = dict(events.dtypes)
    return events.select(actor, ts).groupBy(actor).applyInPandas(walk, f"{actor} {kinds[actor]}, {ts} {kinds[ts]}, count long")


def severity(data_class: Column, escalation: Column | None = None) -> Column:
    """Critical, High, Medium or Low by the class of the data; an escalation of privilege is High at least."""
    high = data_class.isin("PII", "Sensitive")
    high = high if escalation is None else high | escalation
    return F.when(data_class.isin("PHI", "PCI"), F.lit("Critical")).when(high, F.lit("High")).when(data_class.isin("Confidential", "Financial"), F.lit("Medium")).otherwise(F.lit("Low"))


def mass_exports(exports: DataFrame, records: str, limit: int = MASS_EXPORT_RECORDS) -> DataFrame:
    """Exports of more records than the limit, with the limit."""
    return exports.filter(F.col(records) > limit).withColumn("threshold", F.lit(limit))


def exfiltrations(exports: DataFrame, size: str, limit: int = EXFILTRATION_BYTES) -> DataFrame:
    """Exports of more bytes than the limit, with the limit."""
    return exports.filter(F.col(size) > limit).withColumn("threshold", F.lit(limit))


def query_volume(queries: DataFrame, actor: str, ts: str, baseline: int, factor: float = VOLUME_FACTOR, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(actor, ts, count) whenever an actor's queries in a window reach factor times the baseline a minute."""
    return count_breaches(queries, actor, ts, int(baseline * factor), seconds)


def escalations(changes: DataFrame, old: str = "from_role", new: str = "to_role") -> DataFrame:
    """Every change of role: each is an alarm. Empty and null roles are an error."""
    bad = F.coalesce(F.length(old), F.lit(0)) * F.coalesce(F.length(new), F.lit(0)) == 0
    checked = F.when(bad, F.raise_error(F.lit("a role must not be empty")).cast("string")).otherwise(F.lit("PrivilegeEscalation"))
    return changes.withColumn("indicator", checked)


def overdue_notifications(breaches: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Breaches (detected_at, notified_at) later than the deadline without a notification."""
    return breaches.filter(F.col("notified_at").isNull() & (now > F.col("detected_at") + F.make_dt_interval(hours=F.lit(hours))))


def overdue_erasures(requests: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Requests (requested_at, status) past their deadline that are Pending or InProgress."""
    return requests.filter(F.col("status").isin("Pending", "InProgress") & (now > F.col("requested_at") + F.make_dt_interval(days=F.lit(days))))


def audit_query(log: DataFrame, action: str | None = None, actor: str | None = None, subject: str | None = None, tenant: int | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Audit rows by action prefix, actor, subject, tenant and inclusive times, oldest first."""
    for ok, cond in (
        (action, F.col("action").startswith(action or "")), (actor, F.col("actor") == actor), (subject, F.col("subject_id") == subject if subject else F.lit(True)),
        (tenant, F.col("tenant_id") == tenant if tenant else F.lit(True)), (since, F.col("timestamp") >= F.lit(since)), (until, F.col("timestamp") <= F.lit(until)),
    ):
        log = log.filter(cond) if ok is not None else log
    log = log.orderBy("timestamp", "event_id")
    return log if limit is None else log.limit(limit)


def subject_export(tables: dict[str, DataFrame], column: str, subject) -> DataFrame:
    """(table_name, data): every row about the subject, as JSON, from each table that has the subject column."""
    parts = [df.filter(F.col(column) == subject).select(F.lit(n).alias("table_name"), F.to_json(F.struct(*df.columns)).alias("data")) for n, df in sorted(tables.items()) if column in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def erase_subject(df: DataFrame, column: str, subject) -> tuple[DataFrame, DataFrame]:
    """df without the subject's rows, and a receipt (erased, digest). Erasing again erases nothing."""
    mine = F.coalesce(F.col(column) == subject, F.lit(False))
    digest = F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.sha2(F.to_json(F.struct(*df.columns)), 256)))), 256)
    return df.filter(~mine), df.filter(mine).agg(F.count(F.lit(1)).alias("erased"), digest.alias("digest"))


@dataclass
class ExportScope:
    """What may leave: tables, fields but for excluded ones, inclusive ranges of positions and times, rows at most, and how columns change."""

    tables: set[str] = field(default_factory=set)
    fields: set[str] = field(default_factory=set)
    excluded: set[str] = field(default_factory=set)
    positions: tuple[str, int, int] | None = None
    times: tuple[str, str, str] | None = None
    max_rows: int | None = None
    #: What becomes of columns, by 'table.column', '*.column', 'table.*' or '*'; the most exact name wins.
    transforms: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def apply(self, table: str, df: DataFrame, order: list[str]) -> DataFrame:
        if self.tables and table not in self.tables:
            raise PermissionError(f"{table} is out of scope")
        if self.positions:
            df = df.filter(F.col(self.positions[0]).between(self.positions[1], self.positions[2]))
        if self.times:
            df = df.filter(F.col(self.times[0]).between(F.lit(self.times[1]).cast(df.schema[self.times[0]].dataType), F.lit(self.times[2]).cast(df.schema[self.times[0]].dataType)))
        kept = [c for c in df.columns if (not self.fields or c in self.fields) and c not in self.excluded]
        df = df.orderBy(*order).limit(self.max_rows) if self.max_rows is not None else df
        return df.select(*[self.transform(table, c) for c in kept])

    def transform(self, table: str, column: str) -> Column:
        for name in (f"{table}.{column}", f"*.{column}", column, f"{table}.*", "*"):
            if name in self.transforms:
                return self.transforms[name](F.col(column)).alias(column)
        return F.col(column)
