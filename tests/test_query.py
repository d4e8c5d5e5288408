import pyarrow as pa
import pytest

from sparklake.errors import EngineCapabilityError, SchemaMismatchError, StreamConsumedError, UnsafeSqlError
from sparklake.plans import sqlguard
from sparklake.sources import readers

ALLOWED = ["SELECT 1", "  -- hi\nSELECT 1 AS x", "/* c */ SELECT 1", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "(SELECT 1)", "SELECT*FROM events", "DESCRIBE events", "EXPLAIN SELECT 1", "SELECT ';'", "SELECT (SELECT max(event_id) FROM events) AS m"]
REFUSED = [
    "DROP TABLE x", "INSERT INTO x SELECT 1", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "SELECT 1; DROP TABLE x", "SET a=b", "CREATE TABLE t AS SELECT 1", "SHOW TABLES", "EXPLAIN DROP TABLE x", "SELECT reflect('java.lang.Math', 'abs', -3)", "REFRESH TABLE x",
    "SELECT x FROM (SELECT java_method('java.lang.Math', 'abs', -3) AS x)", "SELECT 1 WHERE EXISTS (SELECT reflect('java.lang.Math', 'abs', -3))", "SELECT TRANSFORM(event_id) USING 'cat' FROM events", "", "selekt 1", "CACHE TABLE events", "ADD JAR '/x'",
]


@pytest.fixture
def own(engine):
    return engine.query.session()


@pytest.mark.parametrize("text", ALLOWED)
def test_queries_are_allowed(own, text):
    own.sql(text).collect()


@pytest.mark.parametrize("text", REFUSED)
def test_all_else_is_refused(own, text):
    with pytest.raises(UnsafeSqlError):
        own.sql(text)


def test_no_files_by_path(own, tmp_path):
    with pytest.raises(Exception, match="NOT_FOUND|cannot be found"):
        own.sql(f"SELECT * FROM parquet.`{tmp_path}`").collect()


def test_parameters(own):
    assert own.sql("SELECT $x::int AS v, '$x' AS t", {"x": "42"}).collect() == [(42, "$x")]
    assert own.sql("SELECT ? + ? AS v", [1, 2]).collect()[0].v == 3
    assert own.sql("SELECT :a AS v", {"a": "; DROP TABLE x"}).collect()[0].v == "; DROP TABLE x"
    assert sqlguard.named("SELECT $a, \"$b\", `$c` -- $d") == "SELECT :a, \"$b\", `$c` -- $d"


def test_views(own, spark):
    own.register_frame("f", spark.range(3))
    own.register_frame("f", pa.table({"id": [7]}))
    assert own.sql("SELECT * FROM f").collect()[0].id == 7
    reader = pa.table({"x": [1, 2]}).to_reader()
    own.register_stream("s", reader)
    assert own.sql("SELECT sum(x) AS n FROM s").collect()[0].n == own.sql("SELECT sum(x) AS n FROM s").collect()[0].n == 3
    with pytest.raises(StreamConsumedError):
        own.register_stream("s", reader)
    for bad in ("1x", "a-b", "x" * 64):
        with pytest.raises(UnsafeSqlError):
            own.register_frame(bad, spark.range(1))
    assert own.sql_stream("SELECT id, struct(id AS a) AS s, array(id) AS l, current_timestamp() AS t FROM range(10)", batch_rows=3).read_all().num_rows == 10


def test_pushdown_reaches_the_scan(engine):
    import json

    engine.ingest(json.dumps({"event_id": 42, "user_id": 1, "event_name": "x", "event_ts": "2026-09-30T12:00:00Z"}).encode(), source="t")
    engine.flush()
    df = engine.query.dataframe(columns=["user_id"], row_filter="event_id = 42")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_id,42)" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan and df.collect()[0].user_id == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"event_id": 1}, {"event_id": 2}]')
    (tmp_path / "b.json").write_text("[{]")
    (tmp_path / "c.json").write_text(" ")
    rows = sorted(map(tuple, readers.json_arrays(spark, str(tmp_path / "*.json")).collect()))
    assert rows == [(1, "[{]"), (1, '{"event_id":1}'), (2, '{"event_id":2}')]
    (tmp_path / "x.ndjson").write_text("a\n\n b\n")
    assert readers.ndjson(spark, str(tmp_path / "x.ndjson")).count() == 2
    made = readers.generate(spark, 1000, seed=3)
    assert made.exceptAll(readers.generate(spark, 1000, seed=3, partitions=7)).count() == 0
    made.write.csv(str(tmp_path / "csv"), header=True, quote='"', escape='"')
    assert readers.csv(spark, str(tmp_path / "csv")).exceptAll(made).count() == 0
    made.write.parquet(str(tmp_path / "pq"))
    assert readers.parquet(spark, str(tmp_path / "pq")).where("payload IS NULL").count() == made.where("payload IS NULL").count() > 100
    assert readers.arrow(spark, readers.arrow_stream(spark, pa.table({"x": [1]})).toArrow().schema and _events()).count() == 1
    with pytest.raises(SchemaMismatchError):
        readers.arrow(spark, pa.table({"x": [1]}))
    with pytest.raises(EngineCapabilityError):
        readers.arrow_stream(spark, [1])


def _events():
    from tests.test_table import events

    return events(1, 1)
