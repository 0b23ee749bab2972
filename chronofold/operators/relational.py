"""Relational operators that need more than one built-in."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.storage import saved, shared_dir


def not_in_list(c: Column, values: Sequence[Any]) -> Column:
    """NOT IN that a null in the list doesn't poison; a null cell is never in it."""
    known = [v for v in values if v is not None]
    return c.isNotNull() & ~c.isin(known) if known else c.isNotNull()


def semi(left: DataFrame, right: DataFrame, on: Column | str | list[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti_not_in(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """NOT IN (subquery) with nulls of the subquery ignored."""
    return left.filter(F.col(key).isNotNull()).join(right.select(F.col(other).alias("_k")).filter("_k is not null"), F.col(key) == F.col("_k"), "left_anti")


def join_using(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", suffix: str = "_right") -> DataFrame:
    """USING that keeps both copies of the keys; the right one takes a suffix."""
    renamed = right.withColumnsRenamed({k: k + suffix for k in keys})
    cond = [left[k] == renamed[k + suffix] for k in keys]
    return left.join(renamed, cond, how)


def fixpoint(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION: rows of anchor and of step over new rows, without repeats, until none is new.

    Each round's rows are written and read back: a checkpoint would keep its plan's constraints, and those of a step
    over it hold them several times over, so they grow exponentially with the rounds. Runs of equally many rounds are
    merged, so few are read at once and a row is rewritten as often as their number can double.
    """
    shared_dir(anchor.sparkSession)  # where checkpoints go
    new = _settled(anchor.distinct())
    runs = [(1, new)]
    for _ in range(rounds):
        every = reduce(DataFrame.unionByName, [df for _, df in runs])
        new = _settled(step(new).select(*every.columns).distinct().exceptAll(every))
        if new.isEmpty():
            return every
        n, last = 1, new
        while runs and runs[-1][0] == n:
            n, last = 2 * n, runs.pop()[1].unionByName(last)
        runs.append((n, last if n == 1 else _settled(last)))
    raise RuntimeError(f"recursion did not end within {rounds} rounds")


def _settled(df: DataFrame) -> DataFrame:
    """df computed once; calendar intervals, which Parquet lacks, by a checkpoint."""
    return df.checkpoint() if 'ype":"interval"' in df.schema.json() else saved(df, "fixpoint")


def last_value_at_row(c: str, partition: list[str], order: list[Column]) -> Column:
    """LAST_VALUE as the current row's own value, whatever its peers."""
    return F.last(c).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def upsert(old: DataFrame, new: DataFrame, key: list[str], update: list[str] | None) -> DataFrame:
    """INSERT ... ON CONFLICT: DO NOTHING if update is None, else those columns take the new row's values."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")
    there, fresh = F.col(f"o.{key[0]}").isNotNull(), F.col(f"n.{key[0]}").isNotNull()
    pick = lambda c: F.when(there & ~(fresh & F.lit(update is not None and c in update)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return joined.select(*[pick(c).alias(c) for c in old.columns])


def insert_checked(old: DataFrame, new: DataFrame, key: list[str], required: Sequence[str] = ()) -> DataFrame:
    """INSERT ... VALUES: fails on a key that exists, or on a null in a required column."""
    for c in [*key, *required]:
        if not new.filter(F.col(c).isNull()).isEmpty():
            raise ValueError(f"null in {c}")
    if not new.join(old, key, "left_semi").isEmpty() or not new.groupBy(*key).count().filter("count > 1").isEmpty():
        raise ValueError("duplicate key")
    return old.unionByName(new)
