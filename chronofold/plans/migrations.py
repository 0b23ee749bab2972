"""Migrations: numbered SQL files, applied once and in order, their checksums locked."""

from __future__ import annotations

import hashlib
import re

from chronofold.plans.database import Database
from chronofold.plans.text import hide, split_list

TRACKER = "schema_migrations"


def statements(text: str) -> list[str]:
    hidden, kept = hide(text)

    def back(part: str) -> str:
        return re.sub("\x01(\\d+)\x01", lambda m: kept[int(m[1])], part)

    return [back(s) for s in split_list(hidden, ";") if s]


def migrate(db: Database, files: dict[str, str]) -> list[str]:
    """Apply files {'0001_name.sql': text} that weren't yet, by number; gives their names.

    Fails if a file that was applied has changed or is missing, or if one is numbered below an applied one.
    """
    if TRACKER not in db.catalog.defs:
        db.execute(f"CREATE TABLE {TRACKER} (name TEXT PRIMARY KEY, checksum TEXT NOT NULL)")
    done = {r["name"]: r["checksum"] for r in db.current(TRACKER).collect()}  # one row a file
    order = sorted(files, key=lambda n: int(re.match(r"\d+", n)[0]))
    for name, checksum in done.items():
        if name not in files:
            raise ValueError(f"{name} was applied but is missing")
        if hashlib.sha256(files[name].encode()).hexdigest() != checksum:
            raise ValueError(f"{name} has changed since it was applied")
    fresh = [n for n in order if n not in done]
    if done and fresh and order.index(fresh[0]) < max(order.index(n) for n in done):
        raise ValueError(f"{fresh[0]} comes before a file that was applied")
    for name in fresh:
        for statement in statements(files[name]):
            db.execute(statement)
        db.execute(f"INSERT INTO {TRACKER} VALUES ($1, $2)", [name, hashlib.sha256(files[name].encode()).hexdigest()])
    return fresh
