"""The library's errors. Each has a code, says whether trying again may help, and carries a read-only context."""

from __future__ import annotations

from types import MappingProxyType
from typing import Any


class SparklakeError(Exception):
    code = 0
    retryable = False

    def __init__(self, message: str, **context: Any):
        super().__init__(message)
        self.message = message
        self.context = MappingProxyType(context)

    def __str__(self) -> str:
        return f"[{self.code}] {self.message}"


def _kind(name: str, code: int, parent: type = SparklakeError, retryable: bool = False) -> type:
    return type(name, (parent,), {"code": code, "retryable": retryable, "__module__": __name__})


# The codes and which of them may be retried.
ConfigurationError = _kind("ConfigurationError", 1001)
MemoryBudgetExceededError = _kind("MemoryBudgetExceededError", 1002)
ResourceBusyError = _kind("ResourceBusyError", 1003, retryable=True)

IngestionError = _kind("IngestionError", 2000)
SchemaValidationError = _kind("SchemaValidationError", 2001, IngestionError)
OversizeBatchError = _kind("OversizeBatchError", 2002, IngestionError)
DeadLetterThresholdExceeded = _kind("DeadLetterThresholdExceeded", 2003, IngestionError)
DeadLetterWriteError = _kind("DeadLetterWriteError", 2004, IngestionError)

BufferOverflowError = _kind("BufferOverflowError", 3001)
SchemaMismatchError = _kind("SchemaMismatchError", 3002)
FlushError = _kind("FlushError", 3003)
ParquetWriteError = _kind("ParquetWriteError", 3004, FlushError, retryable=True)
CompactionError = _kind("CompactionError", 3005)

CatalogError = _kind("CatalogError", 4000)
CatalogConnectionError = _kind("CatalogConnectionError", 4001, CatalogError, retryable=True)
SchemaEvolutionError = _kind("SchemaEvolutionError", 4002, CatalogError)
CatalogCommitError = _kind("CatalogCommitError", 4003, CatalogError, retryable=True)

QueryError = _kind("QueryError", 5000)
EngineCapabilityError = _kind("EngineCapabilityError", 5001, QueryError)
StreamConsumedError = _kind("StreamConsumedError", 5002, QueryError)
UnsafeSqlError = _kind("UnsafeSqlError", 5003, QueryError)

BenchmarkError = _kind("BenchmarkError", 6000)
BenchmarkBudgetExceeded = _kind("BenchmarkBudgetExceeded", 6001, BenchmarkError)
