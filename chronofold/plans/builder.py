"""A small query builder that makes parameterised SQL."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

SIGNS = {"eq": "=", "lt": "<", "gt": ">", "le": "<=", "ge": ">=", "ne": "<>"}


@dataclass
class Query:
    table: str
    columns: tuple[str, ...] = ("*",)
    conditions: list[tuple[str, str, Any]] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    rows: int | None = None

    def select(self, *columns: str) -> Query:
        self.columns = columns
        return self

    def where(self, column: str, sign: str, value: Any) -> Query:
        self.conditions.append((column, SIGNS[sign], value))
        return self

    def order_by(self, column: str, descending: bool = False) -> Query:
        self.order.append(f"{column} DESC" if descending else column)
        return self

    def limit(self, n: int) -> Query:
        self.rows = n
        return self

    def build(self) -> tuple[str, list[Any]]:
        text = f"SELECT {', '.join(self.columns)} FROM {self.table}"
        if self.conditions:
            text += " WHERE " + " AND ".join(f"{c} {s} ${i + 1}" for i, (c, s, _) in enumerate(self.conditions))
        if self.order:
            text += " ORDER BY " + ", ".join(self.order)
        if self.rows is not None:
            text += f" LIMIT {self.rows}"
        return text, [v for *_, v in self.conditions]
