"""Strict validation of event records, for pushed micro-batches and for whole DataFrames of lines.

A record is judged by strict_event(), in Python, by the exact contract. DataFrames are judged by Catalyst expressions
that accept only what strict_event() would accept; the few rows that they don't accept go to strict_event() in Arrow
batches, which accepts the rare spellings that expressions can't tell and words the reasons of the rest.
"""

from __future__ import annotations

import json
import re
import sys
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta, timezone
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Ingestion
from ..errors import DeadLetterThresholdExceeded, OversizeBatchError
from ..schema import COLUMNS, EVENT_ARROW, INT64_MAX, MAX_NAME

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VALIDATION, DRIFT, MALFORMED, OVERSIZE = "validation", "schema_drift", "malformed_json", "oversize"
STAMP = re.compile(r"^(\d{4})-(\d{2})-(\d{2})[Tt _](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s?([Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2})?$", re.A)
NUMBER = re.compile(r"^[+-]?\d+(\.\d*)?$", re.A)
#: Seconds since 1970 beyond which a bare number counts as milliseconds.
MILLISECONDS_FROM = 20_000_000_000


def _error(kind: str, loc: str | None, msg: str) -> dict[str, Any]:
    return {"type": kind, "loc": [loc] if loc else [], "msg": msg}


def parse_stamp(text: str) -> tuple[datetime | None, str]:
    """(moment, '') of a timestamp with an offset, or (None, the kind of error)."""
    text = text.strip()
    if NUMBER.match(text):
        seconds = float(text) if "." in text else int(text)
        seconds = seconds / 1000 if abs(seconds) > MILLISECONDS_FROM else seconds
        try:
            return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds), ""
        except OverflowError:
            return None, "datetime_parsing"
    m = STAMP.match(text)
    if not m:
        try:
            date.fromisoformat(text)
            return None, "timezone_aware"
        except ValueError:
            return None, "datetime_from_date_parsing"
    try:
        micro = int((m[7] or "0")[:6].ljust(6, "0"))
        moment = datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4]), int(m[5]), int(m[6] or 0), micro)
        if m[8] is None:
            return None, "timezone_aware"
        if m[8] in "Zz":
            return moment.replace(tzinfo=UTC), ""
        digits = m[8][1:].replace(":", "").ljust(4, "0")
        if int(digits[2:]) > 59 or int(digits[:2]) > 23:
            return None, "datetime_parsing"
        offset = timedelta(hours=int(digits[:2]), minutes=int(digits[2:])) * (-1 if m[8][0] == "-" else 1)
        return moment.replace(tzinfo=timezone(offset)).astimezone(UTC), ""
    except (ValueError, OverflowError):
        return None, "datetime_parsing"


def _integer(value: Any, loc: str, least: int) -> list[dict]:
    if isinstance(value, bool) or not isinstance(value, int):
        return [_error("int_type", loc, "Input should be a valid integer")]
    if value < least:
        return [_error("greater_than" if least else "greater_than_equal", loc, f"Input should be greater than {'0' if least else 'or equal to 0'}")]
    if value > INT64_MAX:
        return [_error("less_than_equal", loc, f"Input should be less than or equal to {INT64_MAX}")]
    return []


def judge(value: Any) -> tuple[dict[str, Any] | None, list[dict]]:
    """(event, []) of a parsed record that keeps the contract, else (None, errors in the order of the columns)."""
    if not isinstance(value, dict):
        return None, [_error("model_type", None, "Input should be an object")]
    errors: list[dict] = []
    stamp = None
    for name in COLUMNS:
        if name not in value:
            if name != "payload":
                errors.append(_error("missing", name, "Field required"))
            continue
        v = value[name]
        if name == "event_id":
            errors += _integer(v, name, 1)
        elif name == "user_id":
            errors += _integer(v, name, 0)
        elif name == "event_name":
            if not isinstance(v, str):
                errors.append(_error("string_type", name, "Input should be a valid string"))
            elif not v:
                errors.append(_error("string_too_short", name, "String should have at least 1 character"))
            elif len(v) > MAX_NAME:
                errors.append(_error("string_too_long", name, f"String should have at most {MAX_NAME} characters"))
        elif name == "event_ts":
            if not isinstance(v, str):
                errors.append(_error("datetime_type", name, "Input should be a valid datetime"))
            else:
                stamp, kind = parse_stamp(v)
                if kind:
                    errors.append(_error(kind, name, "Input should have timezone info" if kind == "timezone_aware" else "Input should be a valid datetime"))
        elif v is not None and not isinstance(v, dict):
            errors.append(_error("dict_type", name, "Input should be a valid dictionary"))
    errors += [_error("extra_forbidden", k, "Extra inputs are not permitted") for k in value if k not in COLUMNS]
    if errors:
        return None, errors
    payload = value.get("payload")
    text = None if payload is None else json.dumps(payload, separators=(",", ":"), ensure_ascii=False)
    return {"event_id": value["event_id"], "user_id": value["user_id"], "event_name": value["event_name"], "event_ts": stamp, "payload": text}, []


def parse(raw: bytes | str) -> Any:
    """The JSON value of a text; ValueError for whatever is none, lone surrogates and invalid UTF-8 among it."""
    if isinstance(raw, bytes):
        raw = raw.decode("utf-8")
    try:
        value = json.loads(raw)
        if "\\u" in raw or "\\U" in raw:
            json.dumps(value, ensure_ascii=False).encode("utf-8")
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    return value


def strict_event(raw: bytes | str) -> tuple[dict[str, Any] | None, list[dict]]:
    try:
        value = parse(raw)
    except ValueError as e:
        return None, [_error("json_invalid", None, f"Invalid JSON: {getattr(e, 'msg', 'not a JSON text')}")]
    return judge(value)


def reason_of(errors: list[dict]) -> str:
    """An extra key is drift, whatever else is wrong; else anything about JSON is malformed; else it is validation."""
    kinds = [e["type"] for e in errors]
    return DRIFT if "extra_forbidden" in kinds else MALFORMED if any("json" in k for k in kinds) else VALIDATION


def truncated(raw: bytes | str, chars: int) -> str:
    """The first chars characters, decoded with replacement: characters, not bytes."""
    return (raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw)[:chars]


@dataclass(frozen=True)
class ValidatedBatch:
    table: pa.Table | None
    accepted: int
    rejected: int
    source: str
    source_offset: int | None
    raw_bytes: int


def split_batch(raw: bytes) -> tuple[bool, list[bytes]]:
    """(whether the body is an array, its lines that aren't blank); an array is one line, a blank body none."""
    body = raw.strip()
    if not body:
        return False, []
    if body.startswith(b"["):
        return True, [body]
    return False, [x for x in raw.splitlines() if x.strip()]


class Validator:
    """Judges pushed micro-batches of bounded size; rejects go to the dead-letter sink before anything else happens."""

    def __init__(self, settings: Ingestion, sink):
        self.settings, self.sink, self.checked, self.rejected = settings, sink, 0, 0

    def validate(self, raw: bytes | bytearray | memoryview, *, source: str, source_offset: int | None = None) -> ValidatedBatch:
        s, raw = self.settings, bytes(raw)
        if len(raw) > s.max_batch_bytes:
            raise OversizeBatchError("the batch has too many bytes", size=len(raw), limit=s.max_batch_bytes)
        array, items = split_batch(raw)
        if not items:
            return ValidatedBatch(None, 0, 0, source, source_offset, len(raw))
        letters: list[dict] = []

        def reject(line: int, item: bytes | str, reason: str, errors: list[dict]) -> None:
            letters.append({"source": source, "line_no": line, "source_offset": source_offset, "reason": reason, "errors": errors, "raw": truncated(item, s.dlq_raw_truncate_chars)})

        judged: list[tuple[bytes | str, dict | None, list[dict]]] = []
        if array:
            try:
                values = parse(items[0])
            except ValueError as e:
                reject(1, items[0], MALFORMED, [_error("json_invalid", None, f"Invalid JSON: {getattr(e, 'msg', 'not a JSON text')}")])
                values = []
            self._bounded(len(values))
            judged = [(json.dumps(v, ensure_ascii=False, separators=(",", ":")), *judge(v)) for v in values]
        else:
            self._bounded(len(items))
            judged = [(x, *strict_event(x)) for x in items]
        good = [e for _, e, _ in judged if e is not None]
        if len(good) < len(judged):  # only a batch with a bad record is looked at line by line
            good = []
            for k, (item, event, errors) in enumerate(judged, 1):
                size = len(item) if isinstance(item, bytes) else len(item.encode("utf-8", "replace"))
                if size > s.max_line_bytes:
                    reject(k, item, OVERSIZE, [_error("oversize", None, f"{size} bytes of {s.max_line_bytes} allowed")])
                elif event is None:
                    reject(k, item, reason_of(errors), errors)
                else:
                    good.append(event)
        if letters:
            self.sink.write(letters)
        self.trip(len(good), len(letters))
        table = pa.Table.from_pylist(good, EVENT_ARROW) if good else None
        return ValidatedBatch(table, len(good), len(letters), source, source_offset, len(raw))

    def _bounded(self, rows: int) -> None:
        if rows > self.settings.max_batch_rows:
            raise OversizeBatchError("the batch has too many rows", rows=rows, limit=self.settings.max_batch_rows)

    def trip(self, accepted: int, rejected: int) -> None:
        """Counts for as long as the validator lives, and raises when the share of rejects is over the limit.

        The accepted rows of the batch that trips it don't go on; the error says how many they are."""
        self.checked += accepted + rejected
        self.rejected += rejected
        s = self.settings
        if self.checked >= s.reject_min_sample and self.rejected / self.checked > s.max_reject_ratio:
            raise DeadLetterThresholdExceeded("too many records are rejected", checked=self.checked, rejected=self.rejected, limit=s.max_reject_ratio, accepted_not_written=accepted)


# ---- DataFrames of lines

_ERRORS = "array<struct<type:string,loc:array<string>,msg:string>>"
JUDGED = f"line_no long, raw string, event_id long, user_id long, event_name string, event_ts timestamp, payload string, reason string, errors {_ERRORS}"
_STRICT = f"struct<event_id:bigint,user_id:bigint,event_name:string,event_ts:timestamp,payload:string,raw:string,reason:string,errors:{_ERRORS}>"
_STRICT_ARROW = pa.struct(
    [("event_id", pa.int64()), ("user_id", pa.int64()), ("event_name", pa.string()), ("event_ts", pa.timestamp("us", tz="UTC")), ("payload", pa.string()), ("raw", pa.string()), ("reason", pa.string())]
    + [("errors", pa.list_(pa.struct([("type", pa.string()), ("loc", pa.list_(pa.string())), ("msg", pa.string())])))]
)


def _member(name: str) -> Column:
    return F.expr(f"try_variant_get(_o, '$.{name}', 'variant')")


def _kind(name: str) -> Column:
    """The variant type of a member: null if it is absent, VOID for a JSON null."""
    return F.schema_of_variant(_member(name))


def parsed(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """lines with _o, the record as a variant (null unless the line is exactly one JSON value), and _ok, whether the
    expressions accept it. The line is parsed as the only element of an array: text after a value shows that way."""
    wrapped = F.concat(F.lit("["), F.col(raw), F.lit("]"))
    one = F.try_parse_json(wrapped)
    # explode keeps the optimizer from copying the parse into each of the dozen places that look at its result
    lines = lines.select("*", F.explode(F.array(one)).alias("_a"))
    alone = F.when(F.try_variant_get("_a", "$[1]", "variant").isNull(), F.try_variant_get("_a", "$[0]", "variant"))
    lines = lines.select("*", F.explode(F.array(alone)).alias("_o")).drop("_a")
    stamp = F.expr("try_variant_get(_o, '$.event_ts', 'string')")
    name = F.expr("try_variant_get(_o, '$.event_name', 'string')")
    iso = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})$"
    known = F.array(*map(F.lit, COLUMNS))
    ok = (
        F.schema_of_variant("_o").startswith("OBJECT")
        & (F.size(F.array_except(F.json_object_keys(F.col(raw)), known)) == 0)
        & (_kind("event_id") == "BIGINT") & (F.expr("try_variant_get(_o, '$.event_id', 'bigint')") > 0)
        & (_kind("user_id") == "BIGINT") & (F.expr("try_variant_get(_o, '$.user_id', 'bigint')") >= 0)
        & (_kind("event_name") == "STRING") & F.char_length(name).between(1, MAX_NAME)
        & (_kind("event_ts") == "STRING") & stamp.rlike(iso) & stamp.try_cast("timestamp").isNotNull()
        & F.coalesce((_kind("payload") == "VOID") | _kind("payload").startswith("OBJECT"), F.lit(True))
    )
    return lines.withColumn("_ok", F.coalesce(ok, F.lit(False)))


def _strictly(chars: int, line_bytes: int):
    @F.arrow_udf(_STRICT)
    def run(raws: pa.Array, doubtful: pa.Array, isolated: pa.Array) -> pa.Array:
        rows = []
        for raw, doubt, apart in zip(raws.to_pylist(), doubtful.to_pylist(), isolated.to_pylist(), strict=True):
            if not doubt:
                rows.append(None)
                continue
            size = len(raw.encode("utf-8", "replace"))
            if apart and size > line_bytes:
                event, errors, reason = None, [_error("oversize", None, f"{size} bytes of {line_bytes} allowed")], OVERSIZE
            else:
                event, errors = strict_event(raw)
                reason = reason_of(errors) if errors else None
            rows.append({"raw": truncated(raw, chars), "reason": reason, "errors": errors} | (event or {}))
        return pa.array(rows, _STRICT_ARROW)

    return run


def judge_lines(lines: DataFrame, settings: Ingestion | None = None, raw: str = "raw", line_no: str | None = None, isolated: bool = False) -> DataFrame:
    """The columns of JUDGED for every line that isn't blank: an event with a null reason, or a reason with its errors.

    Two objects on one line are malformed. A line without a number has a null one. The lines are read and parsed once:
    expressions judge what they accept, and only the others go through the strict parser, in Arrow batches; nothing is
    shuffled. isolated is for batches that are known to hold a bad line: lines of more than max_line_bytes are then
    rejected, good or bad, as a batch that is looked at line by line rejects them.
    """
    settings = settings or Ingestion()
    number = F.col(line_no).cast("long") if line_no else F.lit(None).cast("long")
    solid = lines.select(number.alias("line_no"), F.col(raw).cast("string").alias("raw")).where(F.trim("raw", F.lit(" \t\r\n\f\v")) != "")
    seen = parsed(solid)
    big = F.octet_length("raw") > settings.max_line_bytes if isolated else F.lit(False)
    sure = F.col("_ok") & ~big
    own = {
        "event_id": F.expr("try_variant_get(_o, '$.event_id', 'bigint')"),
        "user_id": F.expr("try_variant_get(_o, '$.user_id', 'bigint')"),
        "event_name": F.expr("try_variant_get(_o, '$.event_name', 'string')"),
        "event_ts": F.expr("try_cast(try_variant_get(_o, '$.event_ts', 'string') AS timestamp)"),
        "payload": F.when(_kind("payload").startswith("OBJECT"), F.get_json_object("raw", "$.payload")),
    }
    known = seen.select("line_no", F.when(~sure, F.col("raw")).alias("_rest"), *(F.when(sure, v).alias(c) for c, v in own.items()))
    known = known.withColumn("_strict", _strictly(settings.dlq_raw_truncate_chars, settings.max_line_bytes)("_rest", F.col("_rest").isNotNull(), F.lit(isolated)))
    strict = F.col("_rest").isNotNull()
    judged = [F.when(strict, F.col(f"_strict.{c}")).otherwise(F.col(c)).alias(c) for c in own]
    return known.select("line_no", F.col("_strict.raw").alias("raw"), *judged, F.col("_strict.reason").alias("reason"), F.coalesce(F.col("_strict.errors"), F.array().cast(_ERRORS)).alias("errors"))


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NULL").select(*COLUMNS)


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NOT NULL").select("line_no", "reason", "errors", "raw")
