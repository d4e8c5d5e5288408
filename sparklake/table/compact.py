"""Compaction: many small files become few large ones, in a snapshot that changes no row."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from ..config import Buffer, Compaction
from ..errors import CompactionError, SparklakeError
from ..operators.lease import COMPACT, Leases
from ..schema import EVENT_SCHEMA
from .log import CommitResult, DataFile, SnapshotLog
from .writer import write_files


@dataclass(frozen=True)
class CompactionPlan:
    paths: list[str]
    rows: int
    bytes: int
    snapshot_id: int


@dataclass(frozen=True)
class CompactionResult:
    paths: list[str]
    rows: int
    commit: CommitResult


class Compactor:
    def __init__(self, log: SnapshotLog, settings: Compaction, buffer: Buffer, leases: Leases):
        self.log, self.settings, self.buffer, self.leases = log, settings, buffer, leases

    def plan(self) -> CompactionPlan | None:
        """The smallest files under the threshold, by size and path; None if they are too few or there is no snapshot."""
        s, snapshot = self.settings, self.log.snapshot_id()
        if snapshot is None:
            return None
        small = sorted((f for f in self.log.files(snapshot) if f.bytes < s.small_file_threshold_bytes), key=lambda f: (f.bytes, f.path))
        if len(small) < s.min_input_files:
            return None
        small = small[: s.max_input_files_per_run]
        return CompactionPlan([f.path for f in small], sum(f.rows for f in small), sum(f.bytes for f in small), snapshot)

    def run(self, plan: CompactionPlan) -> CompactionResult:
        """Rewrites the plan's files and commits the outputs in their place; on any failure the outputs are deleted."""
        with self.leases.lease(COMPACT):
            flush_id = f"compact-{uuid.uuid4().hex}"
            try:
                if self.log.snapshot_id() != plan.snapshot_id:
                    live = {f.path for f in self.log.files()}
                    if gone := [p for p in plan.paths if p not in live]:
                        raise CompactionError("the plan is stale: its files are not live any more", missing=gone)
                if not plan.paths:
                    raise CompactionError("the outputs don't hold the plan's rows", planned=plan.rows, written=0)
                files = self._write(plan, flush_id)
                if (rows := sum(f.rows for f in files)) != plan.rows:
                    raise CompactionError("the outputs don't hold the plan's rows", planned=plan.rows, written=rows)
                return CompactionResult([f.path for f in files], plan.rows, self.log.replace(plan.paths, files, flush_id))
            except Exception as e:
                self.log.store.delete(f"data/{flush_id}")
                if isinstance(e, CompactionError):
                    raise
                raise CompactionError(f"compaction failed: {e}", **(dict(e.context) if isinstance(e, SparklakeError) else {})) from e

    def _write(self, plan: CompactionPlan, flush_id: str) -> list[DataFile]:
        outputs = max(1, -(-plan.bytes // self.settings.target_file_bytes))
        rows = self.log.spark.read.schema(EVENT_SCHEMA).parquet(*plan.paths)
        # no shuffle: a task reads whole inputs one after the other and writes one file
        return write_files(self.log, rows.coalesce(outputs), flush_id, self.buffer, 0)


def vacuum(log: SnapshotLog, keep: int = 1) -> list[str]:
    """Deletes the folders of data/ that none of the last keep snapshots and no pending flush refers to; names them.

    Older snapshots can't be read any more afterwards. Not run by anything: call it when no reader pins them."""
    state = log.state()
    used = {f.path.rsplit("/", 2)[-2] for s in list(state.snapshots)[-keep:] for f in log.files(s)} | {n.removesuffix(".json") for n in log.store.names("_pending")}
    if not log.store.local or not (log.store.local / "data").is_dir():
        return []
    gone = sorted(p.name for p in (log.store.local / "data").iterdir() if p.is_dir() and p.name not in used)
    for name in gone:
        log.store.delete(f"data/{name}")
    return gone

