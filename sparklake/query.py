"""Reading the table: DataFrames of a pinned snapshot, guarded SQL over it, Arrow."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .errors import StreamConsumedError
from .operators.lease import QUERY, Leases
from .plans import sqlguard
from .schema import EVENT_SCHEMA
from .session import harden
from .sources import readers
from .table.log import SnapshotLog


def scan(spark: SparkSession, log: SnapshotLog, snapshot_id: int | None = None) -> DataFrame:
    """The rows of a snapshot, by default the current one; without files an empty DataFrame of the same schema."""
    paths = [f.path for f in log.files(snapshot_id)]
    return spark.read.schema(EVENT_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], EVENT_SCHEMA)


def arrow_reader(df: DataFrame, batch_rows: int = 100_000) -> pa.RecordBatchReader:
    """df as a stream of Arrow batches that is consumed once. The driver holds one partition at a time."""
    empty = df.limit(0).toArrow()

    def batches() -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in df.toLocalIterator(prefetchPartitions=True):
            rows.append(row)
            if len(rows) >= batch_rows:
                yield from _batch(rows, empty.schema)
                rows = []
        if rows:
            yield from _batch(rows, empty.schema)

    return pa.RecordBatchReader.from_batches(empty.schema, batches())


def _batch(rows: list, schema: pa.Schema) -> list[pa.RecordBatch]:
    columns = zip(*rows, strict=True)
    arrays = [pa.array([v.asDict(True) if hasattr(v, "asDict") else v for v in c], f.type) if not pa.types.is_timestamp(f.type) else pa.array(c, pa.timestamp("us")).cast(f.type, safe=False) for c, f in zip(columns, schema, strict=True)]
    return pa.Table.from_arrays(arrays, schema=schema).to_batches()


class SqlSession:
    """A Spark session of its own with the pinned snapshot as the view events; other views can be added."""

    def __init__(self, spark: SparkSession, log: SnapshotLog, snapshot_id: int | None = None):
        self.spark, self._streams = spark.newSession(), set()
        harden(self.spark)
        scan(self.spark, log, snapshot_id).createOrReplaceTempView("events")

    def register_frame(self, name: str, data: Any) -> None:
        """A DataFrame, Arrow table or pandas frame as a view; a name may be registered again."""
        sqlguard.identifier(name)
        if isinstance(data, DataFrame):
            plan = data._jdf.queryExecution().logical()
            self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan).createOrReplaceTempView(name)
        else:
            self.spark.createDataFrame(data).createOrReplaceTempView(name)

    def register_stream(self, name: str, source: Any) -> None:
        """An Arrow stream as a view. The stream is read here, so the view can be read often, but the name counts once."""
        if sqlguard.identifier(name) in self._streams:
            raise StreamConsumedError(f"the stream {name!r} has been registered already", name=name)
        readers.arrow_stream(self.spark, source).createOrReplaceTempView(name)
        self._streams.add(name)

    def sql(self, query: str, params: Mapping[str, Any] | Sequence[Any] | None = None) -> DataFrame:
        """The query, lazily. params: a mapping for :name or $name, a sequence for ?."""
        text = sqlguard.named(query) if isinstance(params, Mapping) else query
        sqlguard.check(self.spark, text)
        if not params:
            return self.spark.sql(text)
        return self.spark.sql(text, args=dict(params) if isinstance(params, Mapping) else list(params))

    def sql_stream(self, query: str, params: Mapping[str, Any] | Sequence[Any] | None = None, batch_rows: int = 100_000) -> pa.RecordBatchReader:
        return arrow_reader(self.sql(query, params), batch_rows)


class QueryService:
    def __init__(self, spark: SparkSession, log: SnapshotLog, leases: Leases):
        self.spark, self.log, self.leases = spark, log, leases

    def dataframe(self, snapshot_id: int | None = None, columns: Sequence[str] = (), row_filter: str = "true") -> DataFrame:
        """The snapshot, lazily; the filter and the columns reach the Parquet scan."""
        with self.leases.lease(QUERY):
            df = scan(self.spark, self.log, snapshot_id).where(row_filter)
            return df.select(*columns) if columns else df

    def collect(self, snapshot_id: int | None = None, columns: Sequence[str] = (), row_filter: str = "true") -> pa.Table:
        with self.leases.lease(QUERY):
            return self.dataframe(snapshot_id, columns, row_filter).toArrow()

    def session(self, snapshot_id: int | None = None) -> SqlSession:
        return SqlSession(self.spark, self.log, snapshot_id)

    def query(self, query: str, snapshot_id: int | None = None, params: Mapping[str, Any] | Sequence[Any] | None = None) -> pa.Table:
        """The result of a query over the snapshot, as an Arrow table on the driver."""
        with self.leases.lease(QUERY):
            return self.session(snapshot_id).sql(query, params).toArrow()

    def to_arrow_reader(self, snapshot_id: int | None = None, row_filter: str = "true", columns: Sequence[str] = (), batch_rows: int = 100_000) -> pa.RecordBatchReader:
        return arrow_reader(self.dataframe(snapshot_id, columns, row_filter), batch_rows)

    def from_stream(self, source: Any) -> DataFrame:
        return readers.arrow_stream(self.spark, source)
