"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: with texts of 100 kB this is still some 50 MB.
ARROW_ROWS = "512"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark only, so that any store that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small: the texts' lengths vary by four orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where it is unset, a temporary one
    if all run on this machine, else a ValueError: executors elsewhere would write what nobody else can read."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df computed and kept in the shared folder, so that lost executors don't matter and nothing is computed twice."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of strings with 64-bit offsets; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings one after the other, and the n + 1 offsets into them."""
    n, at = len(strings), strings.offset
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(strings: pa.Array, most_bytes: int = 2_000_000):
    """(first row, slice) pairs of about most_bytes at most; a longer text has a slice of its own."""
    offsets = flat(strings)[1]
    i, n = 0, len(strings)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield i, strings.slice(i, min(j, n) - i)
        i = min(j, n)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names, whatever else df holds."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


#: Bits of the filter in parted(): a power of two. 64 bits are a row, so it is 2^18 rows of 16 bytes, 4 MB, at any input.
FILTER_BITS = 1 << 24


def parted(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be in ids(id), rows whose id surely isn't), so that only the former need a join's shuffle.

    The ids set bits of a filter of fixed size, which is broadcast; however many ids there are it only gets less
    selective. Null ids are surely not in it.
    """
    spot = F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(FILTER_BITS))
    bits = ids.where("id IS NOT NULL").select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot & 63 AS INT))")).alias("_bits"))
    own, word, set_bits = (free_name(df, n) for n in ("_spot", "_word", "_bits"))
    bits = bits.select(F.col("_word").alias(word), F.col("_bits").alias(set_bits))
    marked = df.withColumn(own, F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("long")), F.lit(FILTER_BITS)))
    marked = marked.join(F.broadcast(bits), (F.shiftright(own, 6) == F.col(word)) & F.col(f"`{id_col}`").isNotNull(), "left")
    hit = F.coalesce(F.expr(f"shiftright(`{set_bits}`, CAST(`{own}` & 63 AS INT)) & 1L"), F.lit(0).cast("long")) == 1
    return tuple(marked.where(c).drop(own, word, set_bits) for c in (hit, ~hit))


def without(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose id is not in ids(id); null ids stay. ids is computed twice: hand in a durable one."""
    may, sure = parted(df, id_col, ids)
    key = free_name(df, "_gone")
    return sure.unionByName(may.join(ids.select(F.col("id").alias(key)).distinct(), F.col(f"`{id_col}`") == F.col(key), "left_anti"))
