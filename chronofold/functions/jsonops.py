"""JSON predicates over JSON texts."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_of(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def get_text(doc: Column, key: str) -> Column:
    """->>: strings without quotes, other values as JSON text."""
    return F.get_json_object(doc, path_of(key))


def get_equals(doc: Column, key: str, value: Any) -> Column:
    """-> key = value by JSON equality; a missing key equals null only."""
    got = F.try_variant_get(F.try_parse_json(doc), path_of(key), "variant")
    if value is None:
        return got.isNull() | F.is_variant_null(got)
    return F.coalesce(F.to_json(got) == F.to_json(F.parse_json(F.lit(json.dumps(value)))), F.lit(False))


def contains(doc: Column, needle: Any) -> Column:
    """@>: objects by recursive subset, arrays if every element of the needle is in some element, scalars if equal.

    The needle is known when the plan is made, so the test unrolls into one conjunction over its leaves.
    """
    return F.coalesce(_holds(F.try_parse_json(doc), needle), F.lit(False))


def _holds(v: Column, needle: Any) -> Column:
    if isinstance(needle, dict):
        parts = [_holds(F.try_variant_get(v, path_of(k), "variant"), x) for k, x in needle.items()]
        return reduce(lambda a, b: a & b, parts, F.schema_of_variant(v).startswith("OBJECT"))
    if isinstance(needle, list):
        items = F.try_variant_get(v, "$", "array<variant>")
        return reduce(lambda a, b: a & b, [_any(items, x) for x in needle], items.isNotNull())
    if needle is None:
        return F.is_variant_null(v)
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(needle))))


def _any(items: Column, x: Any) -> Column:
    return F.exists(items, lambda e: _holds(e, x))
