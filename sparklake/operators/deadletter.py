"""The dead-letter queue: rejected records as JSON lines, in dated files that rotate and expire."""

from __future__ import annotations

import json
import logging
import os
import time
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Ingestion
from ..errors import DeadLetterWriteError
from ..schema import VERSION

log = logging.getLogger(__name__)
#: Bytes that are gathered before they are written.
STAGED = 1_000_000


class DeadLetters:
    """Writes letters to <folder>/dlq-<UTC date>-<number>.ndjson; a write is on disk when it returns."""

    def __init__(self, settings: Ingestion):
        self.settings, self.folder = settings, Path(settings.dlq_dir).resolve()
        try:
            self.folder.mkdir(parents=True, exist_ok=True, mode=0o700)
            self.folder.chmod(0o700)
        except OSError as e:
            raise DeadLetterWriteError("the dead-letter folder can't be made", path=str(self.folder)) from e

    def _file(self) -> Path:
        day = datetime.now(UTC).strftime("%Y%m%d")
        n = 0
        while (p := self.folder / f"dlq-{day}-{n:05d}.ndjson").exists() and p.stat().st_size >= self.settings.dlq_rotate_bytes:
            n += 1
        if p.resolve().parent != self.folder:
            raise DeadLetterWriteError("a dead-letter file would be outside its folder", path=str(p))
        return p

    def write(self, letters: list[dict[str, Any]]) -> None:
        """All letters, flushed and synced, in chunks of STAGED bytes at most; each chunk picks its file anew."""
        staged, size = [], 0
        now = datetime.now(UTC).isoformat()
        for letter in letters:
            line = json.dumps({"received_at": now, **letter, "engine_schema_version": VERSION}, ensure_ascii=False).encode("utf-8", "replace") + b"\n"
            staged.append(line)
            size += len(line)
            if size >= STAGED:
                self._append(b"".join(staged))
                staged, size = [], 0
        if staged:
            self._append(b"".join(staged))
        self.expire()

    def _append(self, data: bytes) -> None:
        try:
            with open(self._file(), "ab") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
        except OSError as e:
            raise DeadLetterWriteError("dead letters can't be written", path=str(self.folder)) from e

    def expire(self) -> list[str]:
        """Deletes files older than the retention, then the oldest ones until the rest fit; failures are only logged."""
        gone = []
        files = sorted(((p.stat().st_mtime, p.stat().st_size, p) for p in self.folder.glob("dlq-*.ndjson")), key=lambda x: (x[0], x[2]))
        total, oldest = sum(s for _, s, _ in files), time.time() - 86_400 * self.settings.dlq_retention_days
        for mtime, size, path in files:
            if mtime < oldest or total > self.settings.dlq_max_total_bytes:
                try:
                    path.unlink()
                    gone.append(path.name)
                    total -= size
                except OSError as e:
                    log.warning("dead letters %s can't be deleted: %s", path, e)
        return gone


def write_rejects(rejects: DataFrame, folder: str, flush_id: str, source: str) -> None:
    """A DataFrame of rejects as JSON lines under <folder>/flush=<id>; the same flush again replaces what it wrote."""
    letters = rejects.select(F.current_timestamp().alias("received_at"), F.lit(source).alias("source"), "line_no", F.lit(None).cast("long").alias("source_offset"), "reason", "errors", "raw", F.lit(VERSION).alias("engine_schema_version"))
    letters.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/flush={flush_id}")
