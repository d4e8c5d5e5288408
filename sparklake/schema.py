"""The one event schema, as Spark and as Arrow types, and the guard that holds tables and batches to it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from .errors import SchemaEvolutionError

VERSION = "1"
INT64_MAX = 2**63 - 1
MAX_NAME = 256

# Names, types, nullability and Parquet field ids of the columns.
_COLUMNS = (("event_id", LongType(), False), ("user_id", LongType(), False), ("event_name", StringType(), False), ("event_ts", TimestampType(), False), ("payload", StringType(), True))
EVENT_SCHEMA = StructType([StructField(n, t, null, {"parquet.field.id": i}) for i, (n, t, null) in enumerate(_COLUMNS, 1)])
COLUMNS = tuple(n for n, _, _ in _COLUMNS)
_ARROW = {LongType(): pa.int64(), StringType(): pa.string(), TimestampType(): pa.timestamp("us", tz="UTC")}
EVENT_ARROW = pa.schema([pa.field(n, _ARROW[t], null) for n, t, null in _COLUMNS])


def describe(schema: StructType) -> list[dict]:
    """What the table log keeps of a schema: Parquet reads lose which columns are required, so it must be written down."""
    return [{"name": f.name, "type": f.dataType.simpleString(), "required": not f.nullable} for f in schema]


def guard(found: list[dict], expected: StructType = EVENT_SCHEMA) -> None:
    """Raises SchemaEvolutionError with all differences of count, position, name, type and nullability."""
    want, diff = describe(expected), []
    if len(found) != len(want):
        diff.append(f"{len(found)} columns instead of {len(want)}")
    for i, (a, b) in enumerate(zip(found, want, strict=False)):
        for key in ("name", "type", "required"):
            if a[key] != b[key]:
                diff.append(f"column {i}: {key} {a[key]!r} instead of {b[key]!r}")
    if diff:
        raise SchemaEvolutionError("the table's schema is not the engine's", diff=diff)


def same_arrow(schema: pa.Schema) -> bool:
    """Whether an Arrow schema is the event schema; metadata and 64-bit offsets of strings make no difference."""
    plain = pa.schema([f.with_type(pa.string()) if pa.types.is_large_string(f.type) else f for f in schema])
    return plain.equals(EVENT_ARROW, check_metadata=False)


def from_driver_events(events: DataFrame) -> DataFrame:
    """The driver's events table under the event contract; rows that break the contract are still among them."""
    return events.select("event_id", "user_id", F.col("event_type").alias("event_name"), F.col("ts").cast("timestamp").alias("event_ts"), F.col("props").alias("payload"))
