"""Functions on the payload column and on names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def payload_text(path: str, payload: str = "payload") -> Column:
    """A member of the payload as text, by JSON path without its $ (page, item.id); null if it is absent or null."""
    return F.get_json_object(payload, f"$.{path}")


def payload_number(path: str, payload: str = "payload") -> Column:
    """A member of the payload as a double; null for whatever is no number."""
    return F.expr(f"try_variant_get(try_parse_json({payload}), '$.{path}', 'double')")


def payload_keys(payload: str = "payload") -> Column:
    """The payload's top-level keys, sorted."""
    return F.array_sort(F.json_object_keys(payload))


def same_json(a: Column, b: Column) -> Column:
    """Whether two texts are the same JSON: key order and the spelling of numbers don't count."""
    return F.coalesce(F.to_json(F.try_parse_json(a)) == F.to_json(F.try_parse_json(b)), F.lit(False))
