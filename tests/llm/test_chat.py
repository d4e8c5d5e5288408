import duckdb

from sparklake.llm.chat import rotate_perspectives
from sparklake.llm.queries import ORACLES, QUERIES


def test_query_against_sql(spark, sf_dir):
    df = QUERIES["op5_chat_formatting"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = con.execute(ORACLES["op5_chat_formatting"])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(found.fetchall())


def test_every_speaker_in_turn(spark):
    rows = [(1, 0, "system", "Be nice."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hé"), (1, 3, "ann", "Bye"), (2, 0, "system", "alone")]
    got = {r.speaker: r for r in rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {"ann", "bob"}
    a = got["ann"]
    assert a.text == "<|system|>\nBe nice.<|end|>\n<|assistant|>\nHi<|end|>\n<|user name=bob|>\nHé<|end|>\n<|assistant|>\nBye<|end|>\n"
    assert [a.text[m.start : m.end] for m in a.masks] == ["Hi<|end|>\n", "Bye<|end|>\n"] and (a.n_turns, a.n_own) == (4, 2)
    assert [got["bob"].text[m.start : m.end] for m in got["bob"].masks] == ["Hé<|end|>\n"]


def test_odd_rows_and_parts(spark):
    schema = "conv_id long, turn long, role string, text string, speaker int, part string"
    rows = [(1, None, None, None, 1, "x"), (1, 0, "", "a", 2, "y"), (1, 0, "b", "x", 3, None), (1, 0, "b", "x", 3, None), (None, 1, "c", "lost", None, None), (1, 5, "b", "later", 0, "")]
    df = spark.createDataFrame(rows, schema)
    got = {(r.conv_id, r.part, r.speaker): r for r in rotate_perspectives(df, part_turns=4).collect()}
    assert set(got) == {(1, p, s) for p in (-1, 0, 1) for s in ("unknown", "b")} | {(None, 0, "c")}
    assert got[1, 0, "b"].n_own == 2 and got[1, 1, "unknown"].n_own == 0 and got[1, -1, "unknown"].n_own == 1
    assert rotate_perspectives(df.limit(0)).count() == 0
