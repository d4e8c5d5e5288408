import json
import threading
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparklake import errors
from sparklake.config import Runtime
from sparklake.engine import Engine
from sparklake.operators.lease import COMPACT, FLUSH, QUERY, Leases, StagedBytes
from sparklake.query import scan
from sparklake.schema import EVENT_ARROW
from sparklake.sources.filesystem import Store, spark_path
from sparklake.table import log as table_log
from sparklake.table.compact import CompactionPlan, vacuum
from sparklake.table.log import DataFile, SnapshotLog
from sparklake.table.writer import Buffer, append_frame


def events(first, n=5, payload='{"a":1}'):
    ids = list(range(first, first + n))
    return pa.table({"event_id": ids, "user_id": ids, "event_name": ["view"] * n, "event_ts": [datetime(2026, 9, 30, tzinfo=UTC)] * n, "payload": [payload] * n}, EVENT_ARROW)


def body(n):
    return json.dumps([{"event_id": i, "user_id": i % 10, "event_name": "click" if i % 2 == 0 else "purchase", "event_ts": "2026-09-30T12:00:00Z", "payload": {"item_id": i}} for i in range(1, n + 1)]).encode()


def test_ingest_flush_query_compact(engine, spark):
    assert engine.log.snapshot_id() is None and engine.query.dataframe().count() == 0 and engine.compact() is None
    b = engine.ingest(body(100), source="t")
    assert (b.accepted, b.rejected) == (100, 0) and engine.status()["buffered_rows"] == 100
    first = engine.flush()
    assert first.added_rows == 100 and engine.flush() is None
    file = engine.log.files()[0].path.removeprefix("file://")
    meta = pq.ParquetFile(file)
    assert meta.metadata.row_group(0).column(0).compression == "ZSTD"
    assert [meta.schema_arrow.field(i).metadata[b"PARQUET:field_id"] for i in range(5)] == [b"1", b"2", b"3", b"4", b"5"]
    engine.append_arrow_batch(events(1000))
    second = engine.flush()
    q = engine.query
    assert q.collect().num_rows == 105 and q.collect(first.snapshot_id).num_rows == 100
    assert q.collect(columns=["event_id"], row_filter="event_id > 1000").column("event_id").to_pylist() == [1001, 1002, 1003, 1004]
    got = q.query("SELECT event_name, count(*) AS n FROM events WHERE user_id < $u GROUP BY event_name ORDER BY event_name", params={"u": 5})
    assert got.to_pylist() == [{"event_name": "click", "n": 30}, {"event_name": "purchase", "n": 20}]
    assert q.to_arrow_reader(batch_rows=30).read_all().num_rows == 105
    done = engine.compact()
    assert done.rows == 105 and len(engine.log.files()) == 1 and q.collect().num_rows == 105
    assert q.collect(second.snapshot_id).num_rows == 105  # the files of older snapshots are still there
    assert vacuum(engine.log) and q.collect().num_rows == 105
    with pytest.raises(errors.CatalogError):
        q.dataframe(-999)


def test_use_after_close_and_second_writer(settings, spark):
    e = Engine(settings, spark)
    with pytest.raises(errors.CatalogConnectionError):
        Engine(settings, spark)
    e.append_arrow_batch(events(1))
    e.close()
    e.close()
    with pytest.raises(RuntimeError):
        e.flush()
    with Engine(settings, spark) as again:
        assert again.query.collect().num_rows == 5


def test_commits_are_idempotent_and_race_safely(spark, tmp_path, settings):
    log = SnapshotLog(spark, str(tmp_path / "t"), settings.catalog).open()
    f = lambda k: [DataFile(f"/x/{k}", 1, 1)]
    a = log.append(f("a"), "one")
    assert log.append([], "one") == table_log.CommitResult(a.snapshot_id, "one", 1, 0, 0, True)
    with pytest.raises(errors.CatalogCommitError):
        log.append([], "two")
    many = type(settings.catalog)(commit_max_attempts=20, commit_backoff_base_seconds=0.005, commit_backoff_max_seconds=0.02)
    threads = [threading.Thread(target=lambda k=k: SnapshotLog(spark, str(tmp_path / "t"), many).append(f(k), f"f{k}")) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(log.files()) == 9 and len(log.state().snapshots) == 9
    with pytest.raises(errors.CatalogCommitError) as e:
        log.replace(["/x/none"], f("z"), "r")
    assert e.value.context["missing"] == ["/x/none"]


def test_commit_gives_up(spark, tmp_path, settings, monkeypatch):
    log = SnapshotLog(spark, str(tmp_path / "t"), settings.catalog).open()
    monkeypatch.setattr(log.store, "put_new", lambda *a: False)
    with pytest.raises(errors.CatalogCommitError, match="exhausted") as e:
        log.append([DataFile("/x", 1, 1)], "f")
    assert e.value.context["pending_files"] == ["/x"] and e.value.context["attempts"] == 5


def test_checkpoints_of_the_log(spark, tmp_path, settings, monkeypatch):
    monkeypatch.setattr(table_log, "CHECKPOINT", 4)
    log = SnapshotLog(spark, str(tmp_path / "t"), settings.catalog).open()
    done = [log.append([DataFile(f"/x/{k}", 1, 1)], str(k)) for k in range(10)]
    assert [n for n in log.store.names("_log") if n.endswith("checkpoint")]
    fresh = SnapshotLog(spark, str(tmp_path / "t"), settings.catalog)
    assert len(fresh.files()) == 10 and len(fresh.files(done[2].snapshot_id)) == 3 and fresh.replay("3").replayed


def test_schema_change_is_refused(spark, tmp_path, settings):
    log = SnapshotLog(spark, str(tmp_path / "t"), settings.catalog).open()
    p = tmp_path / "t" / "_log" / f"{0:020d}.json"
    x = json.loads(p.read_text())
    x["properties"]["schema"][0]["type"] = "int"
    p.write_text(json.dumps(x))
    with pytest.raises(errors.SchemaEvolutionError):
        SnapshotLog(spark, str(tmp_path / "t"), settings.catalog).open()
    del log


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def small(engine, **changes):
    import dataclasses

    clock = Clock()
    s = dataclasses.replace(engine.settings.buffer, **changes)
    return Buffer(engine.log, s, engine.leases, StagedBytes(engine.settings.runtime), clock), clock


def test_buffer_limits(engine):
    one = events(1).nbytes
    b, clock = small(engine, max_bytes=int(one * 2.5), max_age_seconds=10)
    with pytest.raises(errors.BufferOverflowError):
        b.append(events(1, 50))
    with pytest.raises(errors.SchemaMismatchError):
        b.append(pa.table({"x": [1]}))
    assert b.append(events(1)) is None and b.append(events(6)) is None
    assert b.append(events(11)).added_rows == 10 and b.rows == 5  # flushed before the third
    clock.now = 11
    assert b.append(events(16)).added_rows == 10 and b.rows == 0  # the oldest is too old
    assert b.append(events(21)) is None and b.close().added_rows == 5 and b.close() is None
    with pytest.raises(RuntimeError):
        b.append(events(1))


def test_failed_commit_stays_pending_and_goes_first(engine, spark, monkeypatch):
    b, _ = small(engine)
    b.append(events(1))
    real = engine.log.append
    monkeypatch.setattr(engine.log, "append", lambda files, flush_id: (_ for _ in ()).throw(errors.CatalogCommitError("no", pending_files=[])))
    with pytest.raises(errors.CatalogCommitError):
        b.flush()
    (flush_id,) = b.pending
    assert b.rows == 0 and engine.log.snapshot_id() is None
    monkeypatch.setattr(engine.log, "append", real)
    after_crash, _ = small(engine)  # another process finds it on disk
    assert after_crash.recover_pending().flush_id == flush_id and after_crash.recover_pending() is None
    b.append(events(10))
    assert b.flush().flush_id != flush_id
    assert scan(spark, engine.log).count() == 10  # the first five once


def test_failed_write_keeps_rows_and_id(engine, monkeypatch):
    from sparklake.table import writer

    b, _ = small(engine)
    b.append(events(1))
    real, ids = writer.write_files, []
    monkeypatch.setattr(writer, "write_files", lambda log, df, folder, s: ids.append(folder) or (_ for _ in ()).throw(errors.ParquetWriteError("disk")))
    for _ in range(2):
        with pytest.raises(errors.ParquetWriteError):
            b.flush()
    assert b.rows == 5 and ids[0] == ids[1]
    monkeypatch.setattr(writer, "write_files", real)
    assert b.flush().flush_id == ids[0]


def test_nulls_in_required_columns_are_refused(engine, spark):
    bad = spark.sql("SELECT 1L AS event_id, CAST(NULL AS BIGINT) AS user_id, 'x' AS event_name, current_timestamp() AS event_ts, CAST(NULL AS STRING) AS payload")
    with pytest.raises(errors.SchemaMismatchError):
        engine.append_frame(bad, "f")
    with pytest.raises(errors.SchemaMismatchError):
        engine.append_frame(bad.drop("payload"), "g")
    assert append_frame(engine.log, bad.limit(0), "none") is None


def test_compaction_refuses_bad_plans(engine):
    with pytest.raises(errors.CompactionError):
        engine.compactor.run(CompactionPlan([], 999, 0, -1))
    engine.append_arrow_batch(events(1))
    engine.flush()
    with pytest.raises(errors.CompactionError, match="stale"):
        engine.compactor.run(CompactionPlan(["/gone"], 5, 5, -999))
    live = engine.log.files()[0]
    with pytest.raises(errors.CompactionError, match="rows"):
        engine.compactor.run(CompactionPlan([live.path], 99, live.bytes, engine.log.snapshot_id()))
    assert engine.compactor.plan() is None and len(engine.log.files()) == 1


def test_leases():
    leases = Leases(Runtime())
    with leases.lease(QUERY), leases.lease(QUERY):
        with pytest.raises(errors.ResourceBusyError) as e, leases.lease(FLUSH):
            pass
        assert e.value.retryable
    with leases.lease(FLUSH), leases.lease(FLUSH):
        for mode in (COMPACT, QUERY):
            with pytest.raises(errors.ResourceBusyError), leases.lease(mode):
                pass
    with Leases(Runtime(allow_concurrent_query_during_flush=True)).lease(QUERY):
        pass
    free = Leases(Runtime(allow_concurrent_query_during_flush=True))
    with free.lease(QUERY), free.lease(FLUSH), pytest.raises(errors.ResourceBusyError), free.lease(COMPACT):
        pass
    assert leases.held() == {}
    with pytest.raises(errors.MemoryBudgetExceededError):
        StagedBytes(Runtime()).check(480 << 20, 1)


def test_stores(spark, tmp_path):
    for uri, path in (("s3://b/p/f", "s3a://b/p/f"), ("/x/y", "file:///x/y"), ("file:///x/y", "file:///x/y")):
        assert spark_path(uri) == path
    with pytest.raises(errors.ConfigurationError):
        spark_path("ftp://x/y")
    by_hadoop = Store(spark, str(tmp_path))
    by_hadoop.local = None  # the way that other stores are reached
    for store in (Store(spark, str(tmp_path)), by_hadoop):
        assert store.put_new("d/a", b"1") and not store.put_new("d/a", b"2") and store.get("d/a") == b"1"
        assert store.names("d") == ["a"] and store.names("none") == []
        store.delete("d")
        assert store.names("d") == []


@pytest.mark.parametrize("hadoop", [False, True])
def test_one_of_many_writers_wins_an_entry(spark, tmp_path, hadoop):
    """Threads put the same new file at the same time: one wins, and no reader sees a part of it."""
    from concurrent.futures import ThreadPoolExecutor

    from sparklake.sources.filesystem import Store

    stores = [Store(spark, str(tmp_path)) for _ in range(4)]
    if hadoop:
        for s in stores:
            s.local = None
    assert stores[0].put_new("_log/first.json", b"1") and not stores[1].put_new("_log/first.json", b"2") and stores[2].get("_log/first.json") == b"1"
    body = [bytes([65 + k]) * 200_000 for k in range(4)]
    if hadoop:  # a local disk, unlike HDFS, renames after it has looked: one after the other here
        assert [s.put_new("_log/x.json", b) for s, b in zip(stores, body, strict=True)] == [True, False, False, False]
    else:
        for n in range(20):
            with ThreadPoolExecutor(4) as pool:
                won = list(pool.map(lambda sb, n=n: sb[0].put_new(f"_log/{n}.json", sb[1]), zip(stores, body, strict=True)))
            assert sum(won) == 1 and stores[0].get(f"_log/{n}.json") == body[won.index(True)]
    assert all(not x.startswith(".") for x in stores[0].names("_log"))


def test_stores_without_conditional_writes_are_refused(spark, tmp_path):
    from sparklake.errors import EngineCapabilityError
    from sparklake.sources.filesystem import Store

    s = Store(spark, str(tmp_path))
    fs, path = s._hadoop("_log/0.json")
    with pytest.raises(EngineCapabilityError):
        s._put_on_condition(fs, path, b"x")


def test_many_commits_at_once(spark, tmp_path):
    """Every one of concurrent appends is in the log, in some order, and none is lost."""
    import dataclasses
    from concurrent.futures import ThreadPoolExecutor

    from sparklake.config import Catalog
    from sparklake.table.log import DataFile, SnapshotLog

    settings = Catalog(commit_max_attempts=20, commit_backoff_base_seconds=0.001, commit_backoff_max_seconds=0.01)
    logs = [SnapshotLog(spark, str(tmp_path), settings).open() for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: logs[k % 4].append([dataclasses.replace(DataFile("p", 1, 1), path=f"file-{k}")], f"flush-{k}"), range(40)))
    state = SnapshotLog(spark, str(tmp_path), settings).open().state()
    assert set(state.live) == {f"file-{k}" for k in range(40)} and state.version == 40
