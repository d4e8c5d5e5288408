import json

import pytest

from sparklake.operators.joins import asof_join, range_join
from sparklake.query import scan
from sparklake.streaming.ingest import StreamIngest, start, windowed_counts


def lines(ids):
    return "".join(json.dumps({"event_id": i, "user_id": 1, "event_name": "x", "event_ts": "2026-09-30T12:00:00Z"}) + "\n" for i in ids)


def test_restart_neither_loses_nor_repeats(engine, spark, tmp_path):
    source, checkpoint = tmp_path / "in", str(tmp_path / "cp")
    source.mkdir()
    (source / "a.ndjson").write_text(lines(range(0, 5)) + "\nbad\n")
    go = lambda: start(spark, engine.log, engine.settings, str(source), checkpoint, "s1", available_now=True).awaitTermination()
    go()
    (source / "b.ndjson").write_text(lines(range(10, 15)))
    go()
    go()
    assert sorted(r.event_id for r in scan(spark, engine.log).collect()) == [1, 2, 3, 4, 10, 11, 12, 13, 14]
    letters = spark.read.json(f"{engine.settings.ingestion.dlq_dir}/stream=s1").collect()
    assert sorted(r.reason for r in letters) == ["malformed_json", "validation"]
    # a batch that is run again after a crash between commit and checkpoint
    again = StreamIngest(spark, engine.log, engine.settings, "x", "s1")
    again.batch(spark.createDataFrame([(x,) for x in lines([7]).splitlines()], "raw string"), 0)
    assert scan(spark, engine.log).count() == 9


def test_stream_breaker(engine, spark):
    import dataclasses

    from sparklake.errors import DeadLetterThresholdExceeded

    s = dataclasses.replace(engine.settings, ingestion=dataclasses.replace(engine.settings.ingestion, reject_min_sample=4))
    h = StreamIngest(spark, engine.log, s, "x", "b1")
    h.batch(spark.createDataFrame([(lines([1]),), ("bad",)], "raw string"), 0)
    with pytest.raises(DeadLetterThresholdExceeded):
        h.batch(spark.createDataFrame([("bad",), ("worse",)], "raw string"), 1)
    assert scan(spark, engine.log).count() == 1


def test_windowed_counts(spark):
    df = spark.sql("SELECT timestamp'2026-01-01 00:10:00' AS event_ts, 'a' AS event_name UNION ALL SELECT timestamp'2026-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2026-01-01 01:00:00', 'a'")
    assert sorted(r.cnt for r in windowed_counts(df).collect()) == [1, 2]


def test_joins_against_brute_force(spark):
    left = [(1, 5, "a"), (1, None, "b"), (2, 1, "c"), (None, 5, "d"), (1, 3, "e")]
    right = [(1, 3, 10), (1, 3, 11), (1, 6, 12), (2, 2, 13), (None, 1, 14), (1, None, 15)]
    got = asof_join(spark.createDataFrame(left, "k int, t int, v string"), spark.createDataFrame(right, "k int, u int, w int"), ["k"], "t", "u", ["w"])
    assert {r.v: r.w for r in got.collect()} == {"a": 11, "b": None, "c": None, "d": None, "e": 11}
    points = [(x / 2,) for x in range(-5, 40)]
    ranges = [(0.0, 3.5, 1), (3.0, 3.0, 2), (-2.5, 17.0, 3), (5.0, 4.0, 4)]
    got = range_join(spark.createDataFrame(points, "x double"), spark.createDataFrame(ranges, "lo double, hi double, r int"), "x", "lo", "hi", 2.0)
    assert sorted((r.x, r.r) for r in got.collect()) == sorted((x, r) for (x,) in points for lo, hi, r in ranges if lo <= x < hi)


def test_long_lines_and_a_breaker_that_remembers(engine, spark):
    import dataclasses

    s = dataclasses.replace(engine.settings, ingestion=dataclasses.replace(engine.settings.ingestion, reject_min_sample=1000, max_line_bytes=256))
    long = lines([5]).strip()[:-1] + ', "payload": {"x": "' + "y" * 300 + '"}}'
    h = StreamIngest(spark, engine.log, s, "x", "o1")
    h.batch(spark.createDataFrame([(long,)], "raw string"), 0)  # no bad line, so nothing is looked at line by line
    h.batch(spark.createDataFrame([(long,), ("bad",), (lines([6]).strip(),)], "raw string"), 1)
    assert sorted(r.event_id for r in scan(spark, engine.log).collect()) == [5, 6]
    letters = spark.read.json(h.folder).collect()
    assert sorted(r.reason for r in letters) == ["malformed_json", "oversize"] and h._letters() == {"o1-0": 0, "o1-1": 2}
    again = StreamIngest(spark, engine.log, s, "x", "o1")
    assert sum(again._letters().values()) == 2
