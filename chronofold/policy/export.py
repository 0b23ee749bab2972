"""Exports: subject records as JSON or CSV, and scoped exports of tables with a hash of their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compliance import ExportScope

# Columns of a record, and rows that an export of a table may have.
RECORD = ["stream_id", "stream_name", "offset", "data", "timestamp"]
ROWS, MOST_ROWS = 1000, 10_000


def _quoted(c: Column) -> Column:
    """A field as CSV writes it: in quotes, doubled inside, where it holds a comma, a quote or a line end."""
    return F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def as_json(records: DataFrame) -> DataFrame:
    """(line): each record (stream_id, stream_name, offset, data, timestamp) as a JSON object; data is JSON text."""
    return records.select(F.to_json(F.struct(*RECORD)).alias("line"))


def as_csv(records: DataFrame) -> DataFrame:
    """(line): each record's fields joined by commas, under the header in RECORD."""
    return records.select(F.concat_ws(",", *[_quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in RECORD]).alias("line"))


def write_records(records: DataFrame, path: str, kind: str) -> None:
    """Files of the records, one line each; CSV files begin with the header."""
    if records.isEmpty():
        raise ValueError("nothing to export")
    if kind == "json":
        as_json(records).write.text(path)
    else:
        records.select(RECORD).write.csv(path, header=True, escape='"')


def tool_export(table: str, df: DataFrame, scope: ExportScope, order: list[str], rows: int = ROWS) -> tuple[DataFrame, str]:
    """What the scope lets out of a table, transformed, at most rows (MOST_ROWS at most), and a SHA-256 of its content.

    The hash is over the sorted hashes of the rows, so it doesn't depend on partitions; both count MOST_ROWS rows at most.
    """
    most = min(rows, MOST_ROWS, scope.max_rows if scope.max_rows is not None else MOST_ROWS)
    limited = ExportScope(scope.tables, scope.fields, scope.excluded, scope.positions, scope.times, most, scope.transforms)
    out = limited.apply(table, df, order)
    digest = out.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.sha2(F.to_json(F.struct(*out.columns)), 256)))), 256)).first()[0]
    return out, digest
