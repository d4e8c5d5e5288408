"""Staged rows, when they are flushed, and how their files are written and committed."""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Buffer as BufferSettings
from ..errors import BufferOverflowError, FlushError, ParquetWriteError, SchemaMismatchError
from ..operators.lease import FLUSH, Leases, StagedBytes
from ..schema import EVENT_ARROW, EVENT_SCHEMA, same_arrow
from .log import CommitResult, DataFile, SnapshotLog

# Why a flush happens.
ROWS, BYTES, AGE, MEMORY, EXPLICIT, CLOSE = "row_limit", "byte_limit", "age_limit", "memory_pressure", "explicit", "close"


def parquet_options(settings: BufferSettings) -> dict[str, str]:
    """Row groups are cut by bytes here: there is no row limit to give, so files hold one row group's rows at most."""
    return {"compression": settings.compression, "parquet.compression.codec.zstd.level": str(settings.compression_level), "parquet.page.size": str(settings.data_page_bytes), "maxRecordsPerFile": str(settings.row_group_max_rows)}


def write_files(log: SnapshotLog, df: DataFrame, folder: str, settings: BufferSettings, most_rows: int | None = None) -> list[DataFile]:
    """df as Parquet files in a folder of the table, replacing what an earlier attempt left there; not committed yet.

    most_rows is a file's limit instead of the settings' one; 0 is none."""
    path, options = log.store.uri(f"data/{folder}"), parquet_options(settings)
    if most_rows is not None:
        options["maxRecordsPerFile"] = str(most_rows)
    columns = [F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in EVENT_SCHEMA]
    required = [f.name for f in EVENT_SCHEMA if not f.nullable]
    try:
        df.select(columns).write.mode("overwrite").options(**options).parquet(path)
        known = [F.count(c).alias(c) for c in required]
        found = log.spark.read.schema(EVENT_SCHEMA).parquet(path).groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count("*").alias("n"), *known).collect()
    except Exception as e:
        raise ParquetWriteError(f"files can't be written: {str(e)[:300]}", path=path) from e
    if nulls := sorted({c for r in found for c in required if r[c] < r.n}):
        log.store.delete(f"data/{folder}")
        raise SchemaMismatchError("required columns have nulls", columns=nulls)
    return sorted((DataFile(r.file_path, r.n, r.file_size) for r in found), key=lambda f: f.path)


def append_frame(log: SnapshotLog, df: DataFrame, flush_id: str, settings: BufferSettings | None = None) -> CommitResult | None:
    """A DataFrame of any size, written by its own tasks and committed as one snapshot; None if it has no rows."""
    if (done := log.replay(flush_id)) is not None:
        return done
    files = write_files(log, df, flush_id, settings or BufferSettings())
    return log.append(files, flush_id) if files else None


class Buffer:
    """Rows that wait on the driver until there are enough of them.

    Files are durable before their commit: between the two they are pending, on disk in _pending as well as here, and
    the next flush (of this process or, after a crash, of another) commits them first, under their own flush id.
    """

    def __init__(self, log: SnapshotLog, settings: BufferSettings, leases: Leases, memory: StagedBytes, clock=time.monotonic):
        self.log, self.settings, self.leases, self.memory, self.clock = log, settings, leases, memory, clock
        self._lock, self._staged, self._closed, self._flush_id = threading.RLock(), [], False, None
        self.rows = self.bytes = 0
        self._oldest = 0.0
        self._pending: dict[str, list[DataFile]] = {n.removesuffix(".json"): [DataFile(**f) for f in json.loads(log.store.get(f"_pending/{n}"))] for n in log.store.names("_pending")}

    def append(self, batch: pa.Table | pa.RecordBatch) -> CommitResult | None:
        """Stages a batch; flushes before it if the two wouldn't fit together, and after it if a limit is reached. Returns
        the last commit that this made."""
        with self._lock:
            if self._closed:
                raise RuntimeError("the buffer is closed")
            table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
            if not same_arrow(table.schema):
                raise SchemaMismatchError("the batch's schema is not the event schema", found=str(table.schema))
            if table.nbytes > self.settings.max_bytes:
                raise BufferOverflowError("the batch alone is larger than the buffer", size=table.nbytes, limit=self.settings.max_bytes)
            done = None
            if self._staged and self.bytes + table.nbytes > self.settings.max_bytes:
                done = self.flush(BYTES)
            elif self._staged and self.rows + table.num_rows > self.settings.max_rows:
                done = self.flush(ROWS)
            self.memory.check(self.bytes, table.nbytes)
            if not self._staged:
                self._oldest = self.clock()
            self._staged.append(table.cast(EVENT_ARROW))
            self.rows += table.num_rows
            self.bytes += table.nbytes
            if self.bytes >= self.settings.max_bytes:
                return self.flush(BYTES) or done
            if self.rows >= self.settings.max_rows:
                return self.flush(ROWS) or done
            if self.clock() - self._oldest >= self.settings.max_age_seconds:
                return self.flush(AGE) or done
            if self.memory.pressed(self.bytes):
                return self.flush(MEMORY) or done
            return done

    def flush(self, reason: str = EXPLICIT) -> CommitResult | None:
        """Commits what is pending, then writes and commits what is staged; None if there is neither."""
        with self._lock:
            if not self._staged and not self._pending:
                return None
            with self.leases.lease(FLUSH):
                done = None
                for flush_id, files in list(self._pending.items()):
                    done = self._commit(flush_id, files)
                if not self._staged:
                    return done
                self._flush_id = self._flush_id or uuid.uuid4().hex  # a flush that failed keeps its id
                frame = self.log.spark.createDataFrame(pa.concat_tables(self._staged)).coalesce(1)
                files = write_files(self.log, frame, self._flush_id, self.settings)
                if sum(f.rows for f in files) != self.rows:
                    raise FlushError("the files don't hold the staged rows", staged=self.rows, written=sum(f.rows for f in files), reason=reason)
                flush_id, self._flush_id = self._flush_id, None
                self.log.store.put_new(f"_pending/{flush_id}.json", json.dumps([asdict(f) for f in files]).encode())
                self._pending[flush_id] = files
                self._staged, self.rows, self.bytes = [], 0, 0
                return self._commit(flush_id, files)

    def _commit(self, flush_id: str, files: list[DataFile]) -> CommitResult:
        done = self.log.append(files, flush_id)
        self.log.store.delete(f"_pending/{flush_id}.json")
        self._pending.pop(flush_id, None)
        return done

    def recover_pending(self) -> CommitResult | None:
        return self.flush(EXPLICIT) if self._pending else None

    @property
    def pending(self) -> dict[str, list[DataFile]]:
        return dict(self._pending)

    def close(self) -> CommitResult | None:
        with self._lock:
            if self._closed:
                return None
            done = self.flush(CLOSE)
            self._closed = True
            return done

