"""The facade: ingest, flush, compact, query, status, close."""

from __future__ import annotations

import fcntl
import logging
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .config import Settings
from .errors import CatalogConnectionError, SchemaMismatchError
from .operators.deadletter import DeadLetters
from .operators.lease import Leases, StagedBytes
from .operators.validate import ValidatedBatch, Validator
from .query import QueryService
from .schema import COLUMNS
from .session import session
from .table.compact import CompactionResult, Compactor
from .table.log import CommitResult, SnapshotLog
from .table.writer import Buffer, append_frame

log = logging.getLogger(__name__)


class Engine:
    """One table, one writer. Readers need no engine: a SnapshotLog and a QueryService over the same folder will do."""

    def __init__(self, settings: Settings | None = None, spark: SparkSession | None = None):
        self.settings = settings or Settings.load()
        self.spark = spark or session(self.settings)
        s = self.settings
        self.log = SnapshotLog(self.spark, s.table_path, s.catalog).open()
        self._lock = self._exclusive()
        self.leases = Leases(s.runtime)
        self.buffer = Buffer(self.log, s.buffer, self.leases, StagedBytes(s.runtime))
        self.validator = Validator(s.ingestion, DeadLetters(s.ingestion))
        self.compactor = Compactor(self.log, s.compaction, s.buffer, self.leases)
        self._query = QueryService(self.spark, self.log, self.leases)
        self._closed = False

    def _exclusive(self):
        """An advisory lock against a second writer, where the table is on this machine; elsewhere the log alone decides."""
        if not self.log.store.local:
            return None
        f = open(Path(self.log.store.local) / "_writer.lock", "w")
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            f.close()
            raise CatalogConnectionError("another engine has the table open for writing", root=self.log.store.root) from e
        return f

    def _open(self) -> None:
        if self._closed:
            raise RuntimeError("the engine is closed")

    def ingest(self, raw: bytes | bytearray | memoryview, *, source: str, source_offset: int | None = None) -> ValidatedBatch:
        """Validates a micro-batch of JSON and stages what is accepted."""
        self._open()
        batch = self.validator.validate(raw, source=source, source_offset=source_offset)
        if batch.table is not None:
            self.buffer.append(batch.table)
        return batch

    def append_arrow_batch(self, batch: pa.RecordBatch | pa.Table) -> CommitResult | None:
        """Stages columns whose rows are not validated; only their schema is."""
        self._open()
        return self.buffer.append(batch)

    def append_frame(self, df: DataFrame, flush_id: str) -> CommitResult | None:
        """Writes a DataFrame of any size with its own tasks, as one snapshot; the same flush id again changes nothing."""
        self._open()
        if tuple(df.columns) != COLUMNS:
            raise SchemaMismatchError("the DataFrame's columns are not the event columns", found=df.columns)
        return append_frame(self.log, df, flush_id, self.settings.buffer)

    def flush(self) -> CommitResult | None:
        self._open()
        return self.buffer.flush()

    def recover_pending(self) -> CommitResult | None:
        self._open()
        return self.buffer.recover_pending()

    def compact(self) -> CompactionResult | None:
        self._open()
        plan = self.compactor.plan()
        return self.compactor.run(plan) if plan else None

    @property
    def query(self) -> QueryService:
        self._open()
        return self._query

    def status(self) -> dict:
        self._open()
        return {"snapshot_id": self.log.snapshot_id(), "buffered_rows": self.buffer.rows, "buffered_bytes": self.buffer.bytes, "pending_files": sum(map(len, self.buffer.pending.values())), "leases": self.leases.held()}

    def close(self) -> None:
        """Flushes and lets go. A flush that fails is raised after the lock is released; its rows, if they were written, are
        pending on disk and the next engine commits them."""
        if self._closed:
            return
        self._closed = True
        try:
            self.buffer.close()
        finally:
            if self._lock:
                self._lock.close()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()
