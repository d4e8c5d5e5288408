"""Settings: frozen sections with bounds, checked against one another, read from keywords and the environment."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any, get_args, get_type_hints

from .errors import ConfigurationError

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
PREFIX = "SPARKLAKE_"


class Secret(str):
    """A string that doesn't show itself."""

    def __repr__(self) -> str:
        return "Secret('**********')" if self else "Secret('')"

    __str__ = __repr__

    def reveal(self) -> str:
        return str.__str__(self)


def bound(default: Any, low: float | None = None, high: float | None = None, above: float | None = None, one_of: tuple = (), pattern: str = "") -> Any:
    return field(default=default, metadata={"low": low, "high": high, "above": above, "one_of": one_of, "pattern": pattern})


# The defaults and bounds of all settings.
@dataclass(frozen=True)
class Runtime:
    env: str = bound("dev", one_of=("dev", "test", "prod"))
    hard_memory_bytes: int = bound(480 * MIB, 64 * MIB, 4096 * MIB)
    soft_memory_bytes: int = bound(440 * MIB, 32 * MIB)
    memory_ceiling_bytes: int = bound(500 * MIB, 64 * MIB)
    cpu_threads: int = bound(2, 1)
    allow_concurrent_query_during_flush: bool = False


@dataclass(frozen=True)
class Ingestion:
    max_batch_rows: int = bound(20_000, 1, 100_000)
    max_batch_bytes: int = bound(8 * MIB, KIB, 64 * MIB)
    max_line_bytes: int = bound(MIB, 256, 8 * MIB)
    dlq_dir: str = "/tmp/sparklake/dlq"
    dlq_rotate_bytes: int = bound(16 * MIB, MIB)
    dlq_raw_truncate_chars: int = bound(64 * KIB, 256, MIB)
    dlq_retention_days: int = bound(30, 1, 365)
    dlq_max_total_bytes: int = bound(GIB, 10 * MIB)
    max_reject_ratio: float = bound(0.5, 0.0, 1.0)
    reject_min_sample: int = bound(1_000, 1)


@dataclass(frozen=True)
class Buffer:
    max_bytes: int = bound(128 * MIB, 1, 128 * MIB)
    max_rows: int = bound(500_000, 100_000, 500_000)
    max_age_seconds: float = bound(60.0, above=0)
    compression: str = bound("zstd", one_of=("zstd",))
    compression_level: int = bound(3, 1, 19)
    data_page_bytes: int = bound(MIB, 64 * KIB, 8 * MIB)
    row_group_max_rows: int = bound(500_000, 100_000, 500_000)


@dataclass(frozen=True)
class Compaction:
    min_input_files: int = bound(8, 2)
    max_input_files_per_run: int = bound(64, 2, 256)
    small_file_threshold_bytes: int = bound(64 * MIB, MIB)
    target_file_bytes: int = bound(128 * MIB, 8 * MIB, 512 * MIB)


@dataclass(frozen=True)
class Storage:
    s3_endpoint: str = ""
    s3_region: str = ""
    s3_access_key: Secret = Secret("")
    s3_secret_key: Secret = Secret("")


@dataclass(frozen=True)
class Catalog:
    name: str = "local"
    warehouse: str = "/tmp/sparklake/warehouse"
    namespace: str = bound("default", pattern=r"^[A-Za-z_][A-Za-z0-9_]{0,62}$")
    table_name: str = bound("events", pattern=r"^[A-Za-z_][A-Za-z0-9_]{0,62}$")
    commit_max_attempts: int = bound(5, 1, 20)
    commit_backoff_base_seconds: float = bound(0.2, above=0)
    commit_backoff_max_seconds: float = bound(5.0, above=0)


@dataclass(frozen=True)
class Query:
    result_bytes: int = bound(GIB, 32 * MIB)
    threads: int = bound(2, 1, 16)
    temp_dir: str = "/tmp/sparklake/tmp"
    arrow_batch_rows: int = bound(100_000, 1)


def _local_tmp(path: str) -> bool:
    return re.sub(r"^file:/*", "/", path).startswith("/tmp")


#: What must hold between settings, each with what is said if it doesn't. The driver holds staged rows up to the hard limit
#: and one pushed batch beside them; all other memory is Spark's.
RULES: tuple[tuple[str, Any], ...] = (
    ("the warehouse, the dead letters and spilled rows must not be under /tmp in prod", lambda s: s.runtime.env != "prod" or not any(map(_local_tmp, (s.catalog.warehouse, s.ingestion.dlq_dir, s.query.temp_dir)))),
    ("rows must be flushed before they are refused: the soft limit must be below the hard one", lambda s: s.runtime.soft_memory_bytes < s.runtime.hard_memory_bytes),
    ("a pushed batch must fit between the hard limit and the ceiling", lambda s: s.runtime.hard_memory_bytes + s.ingestion.max_batch_bytes <= s.runtime.memory_ceiling_bytes),
    ("a commit must not wait longer at first than at last", lambda s: s.catalog.commit_backoff_base_seconds <= s.catalog.commit_backoff_max_seconds),
    ("a compacted file must not be smaller than an eighth of a flush", lambda s: 8 * s.compaction.target_file_bytes >= s.buffer.max_bytes),
)


@dataclass(frozen=True)
class Settings:
    runtime: Runtime = field(default_factory=Runtime)
    ingestion: Ingestion = field(default_factory=Ingestion)
    buffer: Buffer = field(default_factory=Buffer)
    compaction: Compaction = field(default_factory=Compaction)
    storage: Storage = field(default_factory=Storage)
    catalog: Catalog = field(default_factory=Catalog)
    query: Query = field(default_factory=Query)

    def __post_init__(self) -> None:
        for section in fields(self):
            _check(section.name, getattr(self, section.name))
        broken = [said for said, holds in RULES if not holds(self)]
        if broken:
            raise ConfigurationError("; ".join(broken))

    @property
    def table_path(self) -> str:
        return f"{self.catalog.warehouse.rstrip('/')}/{self.catalog.namespace}/{self.catalog.table_name}"

    @classmethod
    def load(cls, env_file: str | None = None, environ: dict[str, str] | None = None, **sections: Any) -> Settings:
        """Settings from keywords (section=dict or section object), then SPARKLAKE_SECTION__KEY variables, then env_file."""
        values: dict[str, dict[str, Any]] = {}
        lines = Path(env_file).read_text().splitlines() if env_file and Path(env_file).exists() else []
        from_file = dict(x.strip().split("=", 1) for x in lines if "=" in x and not x.lstrip().startswith("#"))
        for source in ({k.strip(): v.strip().strip("\"'") for k, v in from_file.items()}, dict(os.environ if environ is None else environ)):
            for name, value in source.items():
                if name.upper().startswith(PREFIX) and "__" in name:
                    section, key = name[len(PREFIX) :].lower().split("__", 1)
                    values.setdefault(section, {})[key] = value
        kinds = {f.name: f.default_factory for f in fields(cls)}
        done = {}
        for name in [*values, *(s for s in sections if s not in values)]:
            if name not in kinds:
                raise ConfigurationError(f"unknown section {name!r}")
            given = sections.get(name)
            if given is not None and not isinstance(given, dict):
                done[name] = given
                continue
            done[name] = _section(kinds[name], name, values.get(name, {}) | (given or {}))
        return cls(**done)


def _section(kind: Any, name: str, values: dict[str, Any]) -> Any:
    hints = get_type_hints(kind)
    out = {}
    for key, value in values.items():
        if key not in hints:
            raise ConfigurationError(f"unknown setting {name}.{key}")
        try:
            out[key] = _cast(hints[key], value)
        except (TypeError, ValueError) as e:
            raise ConfigurationError(f"{name}.{key}: {value!r} is not a {hints[key].__name__}") from e
    return replace(kind(), **out)


def _cast(kind: Any, value: Any) -> Any:
    kind = next((k for k in get_args(kind) if k is not type(None)), kind)
    if kind is bool:
        if isinstance(value, str):
            low = value.lower()
            if low not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
                raise ValueError(value)
            return low in ("1", "true", "yes", "on")
        if not isinstance(value, bool):
            raise TypeError(value)
        return value
    if kind in (int, float) and isinstance(value, bool) or kind is int and isinstance(value, float) and value != int(value):
        raise TypeError(value)
    return kind(value)


def _check(section: str, values: Any) -> None:
    for f in fields(values):
        value, m = getattr(values, f.name), f.metadata
        bad = m and (
            m["low"] is not None and value < m["low"] or m["high"] is not None and value > m["high"] or m["above"] is not None and value <= m["above"] or m["one_of"] and value not in m["one_of"] or m["pattern"] and not re.match(m["pattern"], value)
        )
        if bad:
            raise ConfigurationError(f"{section}.{f.name} = {value!r} is out of bounds", setting=f"{section}.{f.name}", value=value)
