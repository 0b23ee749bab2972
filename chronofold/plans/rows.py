"""Typed rows: bounded results as maps or as objects of a dataclass."""

from __future__ import annotations

import dataclasses
from typing import Any, TypeVar, get_type_hints

from pyspark.sql import DataFrame

Kind = TypeVar("Kind")


def rows_as_maps(df: DataFrame, most: int = 10_000) -> list[dict[str, Any]]:
    """The rows by column name; fails beyond so many."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def typed_rows(df: DataFrame, kind: type[Kind], most: int = 10_000) -> list[Kind]:
    """The rows as objects of a dataclass; fails on a missing column or a value of another type."""
    hints = get_type_hints(kind)
    out = []
    for row in rows_as_maps(df, most):
        values = {}
        for f in dataclasses.fields(kind):
            if f.name not in row:
                raise KeyError(f"no column {f.name}")
            if not isinstance(row[f.name], hints[f.name]):
                raise TypeError(f"{f.name} is {type(row[f.name]).__name__}")
            values[f.name] = row[f.name]
        out.append(kind(**values))
    return out
