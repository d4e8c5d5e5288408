import json

import pytest
from hypothesis import HealthCheck, given, settings as hsettings
from hypothesis import strategies as st

from sparklake.config import Ingestion
from sparklake.errors import DeadLetterThresholdExceeded, OversizeBatchError
from sparklake.operators.deadletter import DeadLetters
from sparklake.operators.validate import DRIFT, MALFORMED, OVERSIZE, VALIDATION, Validator, accepted, judge_lines, reason_of, rejected, strict_event
from sparklake.schema import COLUMNS

GOOD = {"event_id": 1, "user_id": 0, "event_name": "click", "event_ts": "2026-09-30T12:00:00Z"}


def line(**changes):
    return json.dumps({k: v for k, v in (GOOD | changes).items() if v is not ...}, ensure_ascii=False)


ACCEPTED = [
    line(), line(event_id=2**63 - 1), line(user_id=2**63 - 1), line(event_name="é" * 256), line(event_name="x"), line(payload=None), line(payload={}), line(payload={"a": {"b": [1, 2.5, "x", None]}}),
    line(event_ts="2026-09-30T12:00:00.1234567+02:00"), line(event_ts="2026-09-30T12:00Z"), line(event_ts="2026-09-30T12:00:00z"), line(event_ts="1700000000"), line()[:-1] + ',"payload":{"n":NaN}}',
    '{"event_id":5,' + line()[1:], "  " + line() + " ", line(payload={"big": 10**50}),
]
REJECTED = [
    (line(event_id=0), VALIDATION), (line(event_id=2**63), VALIDATION), (line(event_id=1.0), VALIDATION), (line(event_id=True), VALIDATION), (line(event_id="1"), VALIDATION), (line(event_id=...), VALIDATION), (line(user_id=-1), VALIDATION),
    (line(event_name=""), VALIDATION), (line(event_name="é" * 257), VALIDATION), (line(event_name=5), VALIDATION), (line(event_ts="2026-09-30T12:00:00"), VALIDATION), (line(event_ts="2026-09-30"), VALIDATION), (line(event_ts="12:00"), VALIDATION),
    (line(event_ts="2026-13-30T12:00:00Z"), VALIDATION), (line(event_ts=1700000000), VALIDATION), (line(payload="s"), VALIDATION), (line(payload=[1]), VALIDATION), (line(payload=3), VALIDATION), (line(extra=1), DRIFT), (line(extra=1, event_id="x"), DRIFT),
    (line() + " trailing", MALFORMED), (line() + "," + line(), MALFORMED), (line() + line(), MALFORMED), (line()[:-1], MALFORMED), ("{'event_id':1}", MALFORMED), ("[1]", VALIDATION), ("7", VALIDATION), ("null", VALIDATION), ('{"event_id":1,}', MALFORMED),
]


class Sink(list):
    def write(self, letters):
        self.extend(letters)


@pytest.mark.parametrize("raw", ACCEPTED)
def test_strict_accepts(raw):
    event, errors = strict_event(raw)
    assert event and not errors and set(event) == set(COLUMNS)


@pytest.mark.parametrize(("raw", "reason"), REJECTED)
def test_strict_rejects(raw, reason):
    event, errors = strict_event(raw)
    assert event is None and reason_of(errors) == reason


def test_contract_agrees_with_pydantic():
    pydantic = pytest.importorskip("pydantic")
    from typing import Annotated

    class Event(pydantic.BaseModel):
        model_config = pydantic.ConfigDict(strict=True, extra="forbid")
        event_id: Annotated[int, pydantic.Field(gt=0, le=2**63 - 1)]
        user_id: Annotated[int, pydantic.Field(ge=0, le=2**63 - 1)]
        event_name: Annotated[str, pydantic.Field(min_length=1, max_length=256)]
        event_ts: pydantic.AwareDatetime
        payload: dict[str, pydantic.JsonValue] | None = None

    for raw in [*ACCEPTED, *(r for r, _ in REJECTED)]:
        try:
            theirs = Event.model_validate_json(raw)
        except pydantic.ValidationError:
            theirs = None
        ours, _ = strict_event(raw)
        assert (theirs is None) == (ours is None), raw
        if ours:
            assert ours["event_ts"] == theirs.event_ts and ours["event_id"] == theirs.event_id


def test_lines_in_a_dataframe_agree_with_strict(spark):
    raws = [*ACCEPTED, *(r for r, _ in REJECTED), "", "   ", line() + "\r"]
    df = spark.createDataFrame(list(enumerate(raws)), "k long, raw string")
    rows = {r.line_no: r for r in judge_lines(df, line_no="k").collect()}
    solid = [k for k, r in enumerate(raws) if r.strip()]
    assert sorted(rows) == solid
    for k in solid:
        event, errors = strict_event(raws[k])
        assert (rows[k].reason is None) == (event is not None), raws[k]
        if event:
            assert rows[k].event_id == event["event_id"] and rows[k].event_name == event["event_name"]
            same = lambda a, b: a is b is None or json.loads(a) == json.loads(b)
            assert same(rows[k].payload, event["payload"]) or "NaN" in raws[k]
        else:
            assert rows[k].reason == reason_of(errors) and rows[k].raw == raws[k]


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], "raw string")
    assert judge_lines(none).count() == 0
    odd = spark.createDataFrame([(line(), "x", 1)], "raw string, reason string, event_id int")
    judged = judge_lines(odd)
    assert accepted(judged).count() == 1 and rejected(judged).count() == 0


text = st.one_of(st.text(max_size=8), st.integers(-2, 2**64), st.none(), st.booleans(), st.floats(allow_nan=False), st.dictionaries(st.text(max_size=3), st.integers(), max_size=2))


@hsettings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from([*COLUMNS, "x"]), text, max_size=6), min_size=1, max_size=25))
def test_native_acceptance_is_sound(spark, records):
    raws = [json.dumps(GOOD | r) for r in records]
    rows = judge_lines(spark.createDataFrame(list(enumerate(raws)), "k long, raw string"), line_no="k").collect()
    assert len(rows) == len(raws)
    assert {r.line_no for r in rows if r.reason is None} == {k for k, r in enumerate(raws) if strict_event(r)[0]}


def validator(**changes):
    sink = Sink()
    return Validator(Ingestion(**changes), sink), sink


def test_batches_of_lines_and_arrays():
    v, sink = validator()
    lines = f"{line()}\n\n\r\n{line(event_id='x')}\n{line(event_id=2)}".encode()
    b = v.validate(lines, source="s", source_offset=7)
    assert (b.accepted, b.rejected, b.table.column("event_id").to_pylist()) == (2, 1, [1, 2])
    assert sink[0]["line_no"] == 2 and sink[0]["source_offset"] == 7 and sink[0]["reason"] == VALIDATION
    b = v.validate(f"  [{line()}, {line(x=1)}] ".encode(), source="s")
    assert (b.accepted, b.rejected, sink[1]["line_no"], sink[1]["reason"]) == (1, 1, 2, DRIFT)
    assert json.loads(sink[1]["raw"])["x"] == 1
    b = v.validate(b"[{,]", source="s")
    assert (b.accepted, b.rejected, sink[2]["line_no"], sink[2]["reason"]) == (0, 1, 1, MALFORMED)
    assert v.validate(b" \n ", source="s").table is None


def test_size_limits():
    v, sink = validator(max_batch_bytes=1024)
    with pytest.raises(OversizeBatchError):
        v.validate(b"x" * 1025, source="s")
    v, sink = validator(max_batch_rows=1)
    with pytest.raises(OversizeBatchError):
        v.validate(f"{line()}\n{line()}".encode(), source="s")
    with pytest.raises(OversizeBatchError):
        v.validate(f"[{line()},{line()}]".encode(), source="s")
    assert not sink
    long = line(payload={"a": "x" * 400})
    v, sink = validator(max_line_bytes=300)
    assert v.validate(long.encode(), source="s").accepted == 1  # all valid: lines aren't looked at one by one
    b = v.validate(f"{long}\nbad".encode(), source="s")
    assert (b.accepted, b.rejected) == (0, 2) and sink[0]["reason"] == OVERSIZE


def test_raw_is_cut_in_characters():
    v, sink = validator(dlq_raw_truncate_chars=256)
    v.validate(("é" * 300).encode() + b"\n" + line().encode(), source="s")
    assert sink[0]["raw"] == "é" * 256


def test_breaker_trips_above_the_limit_only():
    v, _ = validator(reject_min_sample=4, max_reject_ratio=0.5)
    v.validate(f"{line()}\n{line()}\nx\ny".encode(), source="s")  # exactly half
    with pytest.raises(DeadLetterThresholdExceeded) as e:
        v.validate(f"{line()}\nx\ny".encode(), source="s")
    assert e.value.context["accepted_not_written"] == 1


def test_dead_letter_files(tmp_path):
    import os

    s = Ingestion(dlq_dir=str(tmp_path / "q"), dlq_rotate_bytes=1 << 20, dlq_max_total_bytes=10 << 20, dlq_retention_days=1)
    q = DeadLetters(s)
    assert (tmp_path / "q").stat().st_mode & 0o777 == 0o700
    q.write([{"source": "s", "raw": "x" * 600_000}] * 4)
    files = sorted((tmp_path / "q").glob("dlq-*.ndjson"))
    assert len(files) >= 2 and sum(len(f.read_text().splitlines()) for f in files) == 4
    assert json.loads(files[0].read_text().splitlines()[0])["engine_schema_version"] == "1"
    os.utime(files[0], (0, 0))
    assert q.expire() == [files[0].name]
