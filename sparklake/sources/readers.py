"""What events can be read from: lines, JSON arrays, Arrow, CSV, Parquet, and a generator."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..errors import EngineCapabilityError, SchemaMismatchError
from ..schema import COLUMNS, EVENT_ARROW, EVENT_SCHEMA, same_arrow


#: The event schema for files of others, whose columns have names but no field ids.
NAMED = StructType([StructField(f.name, f.dataType, f.nullable) for f in EVENT_SCHEMA])


def ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw): the lines of text files. line_no counts a file's non-blank lines, split by split, so it is null
    where files are split; a blank line is no line."""
    lines = spark.read.text(path).withColumnRenamed("value", "raw")
    return lines.where(F.trim("raw") != "").select(F.lit(None).cast("long").alias("line_no"), "raw")


def json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw): the elements of files that each hold one JSON array, numbered from 1 and written as canonical JSON.

    A file that is no array is one element, itself, which validation will find malformed."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value", F.lit(" \t\r\n")).alias("body"))
    array = F.try_parse_json("body")
    element = F.when(F.schema_of_variant(array).startswith("ARRAY"), F.expr("CAST(try_parse_json(body) AS ARRAY<VARIANT>)")).otherwise(F.lit(None))
    good = whole.where(F.schema_of_variant(array).startswith("ARRAY")).select(F.posexplode(element)).select((F.col("pos") + 1).cast("long").alias("line_no"), F.to_json("col").alias("raw"))
    bad = whole.where((F.col("body") != "") & ~F.coalesce(F.schema_of_variant(array).startswith("ARRAY"), F.lit(False))).select(F.lit(1).cast("long").alias("line_no"), F.col("body").alias("raw"))
    return good.unionByName(bad)


def arrow(spark: SparkSession, data: pa.Table | pa.RecordBatch | pa.RecordBatchReader) -> DataFrame:
    """Events that are already columns. Only their schema is checked; a reader is consumed."""
    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    if isinstance(data, pa.RecordBatchReader):
        data = data.read_all()
    if not same_arrow(data.schema):
        raise SchemaMismatchError("the batch's schema is not the event schema", found=str(data.schema))
    if data.num_rows == 0:
        return spark.createDataFrame([], EVENT_SCHEMA)
    return spark.createDataFrame(data.cast(EVENT_ARROW))


def arrow_stream(spark: SparkSession, source) -> DataFrame:
    """A DataFrame of any object that speaks the Arrow C stream protocol; it is read once, here."""
    if not hasattr(source, "__arrow_c_stream__") and not isinstance(source, pa.RecordBatchReader):
        raise EngineCapabilityError("the source has no Arrow stream", kind=type(source).__name__)
    reader = source if isinstance(source, pa.RecordBatchReader) else pa.RecordBatchReader.from_stream(source)
    return spark.createDataFrame(reader.read_all())


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Event columns of CSV files with a header; an empty payload is null."""
    return spark.read.csv(path, header=True, schema=NAMED, quote='"', escape='"').select(*COLUMNS)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """Event columns of Parquet files, a folder or a glob."""
    return spark.read.schema(NAMED).parquet(path)


def generate(spark: SparkSession, rows: int, seed: int = 20260930, partitions: int | None = None) -> DataFrame:
    """rows made-up events: ids from 1, 100,000 users, five names, whole seconds over 30 days, a fifth without payload.

    Each row follows from its id and the seed, so the same call gives the same rows on any cluster."""
    # The event names, the first second and the ranges of the generator.
    names = ("click", "page_view", "purchase", "add_to_cart", "search")
    first, seconds, users = "2026-09-30 00:00:00", 30 * 86_400, 100_000
    draw = lambda k: F.pmod(F.xxhash64("event_id", F.lit(seed), F.lit(k)), F.lit(1 << 40))
    ids = spark.range(1, rows + 1, numPartitions=partitions).withColumnRenamed("id", "event_id")
    price = F.format_string("%.2f", (draw(4) % 49_901 + 100) / F.lit(100.0))
    return ids.select(
        "event_id",
        (draw(1) % users + 1).alias("user_id"),
        F.element_at(F.array(*map(F.lit, names)), (draw(2) % len(names) + 1).cast("int")).alias("event_name"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(first)) + draw(3) % seconds).alias("event_ts"),
        F.when(draw(5) % 5 != 0, F.concat(F.lit('{"page":"/item","price":'), price, F.lit("}"))).alias("payload"),
    )
