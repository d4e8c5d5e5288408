"""Who may run beside whom: flushes, compactions and queries hold leases of their mode."""

from __future__ import annotations

import threading
from collections import Counter
from contextlib import contextmanager

from ..config import Runtime
from ..errors import MemoryBudgetExceededError, ResourceBusyError

FLUSH, COMPACT, QUERY = "flush", "compact", "query"


class Leases:
    """Counted leases. Writers keep out queries, and queries writers, unless the settings let them run together; flush and
    compaction keep each other out. A mode that is held may be taken again. Snapshots would make queries safe anyway;
    the leases bound what runs at once."""

    def __init__(self, settings: Runtime):
        self.together, self._lock, self._held = settings.allow_concurrent_query_during_flush, threading.RLock(), Counter()

    def _in_the_way(self, mode: str) -> list[str]:
        rivals = {FLUSH: {COMPACT}, COMPACT: {FLUSH}, QUERY: set()}[mode]
        if not self.together:
            rivals |= {QUERY} if mode != QUERY else {FLUSH, COMPACT}
        return sorted(m for m in rivals if self._held[m] > 0)

    @contextmanager
    def lease(self, mode: str):
        with self._lock:
            if self._held[mode] == 0 and (rivals := self._in_the_way(mode)):
                raise ResourceBusyError(f"{mode} has to wait for {', '.join(rivals)}", mode=mode, held=rivals)
            self._held[mode] += 1
        try:
            yield
        finally:
            with self._lock:
                self._held[mode] -= 1

    def held(self) -> dict[str, int]:
        with self._lock:
            return {m: n for m, n in self._held.items() if n}


class StagedBytes:
    """The guard over what the driver holds before a flush; all other memory is Spark's to manage."""

    def __init__(self, settings: Runtime):
        self.hard, self.soft = settings.hard_memory_bytes, settings.soft_memory_bytes

    def check(self, held: int, incoming: int) -> None:
        if held + incoming >= self.hard:
            raise MemoryBudgetExceededError("staged rows would go over the hard limit", held=held, incoming=incoming, limit=self.hard)

    def pressed(self, held: int) -> bool:
        return held >= self.soft
