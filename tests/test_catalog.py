"""Every registered query against its DuckDB text, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from sparklake.plans import catalog


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_oracle(spark, sf_dir, oracle, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    found = oracle.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, found.fetchall())


def test_lateral_join_heeds_its_order_wherever_rows_come_from(spark, tmp_path):
    """Sorts that spill deliver rows of equal keys in any order, as remote shuffles do; ties and nulls are the oracle's too."""
    con, threshold = duckdb.connect(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    con.execute("CREATE TABLE customer AS SELECT CASE WHEN k < 42 THEN k % 40 END AS c_custkey FROM range(43) t(k)")
    con.execute("CREATE TABLE orders AS SELECT CASE WHEN k % 13 > 0 THEN k END AS o_orderkey, CASE WHEN k % 17 > 0 THEN k % 37 END AS o_custkey, CASE k % 11 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE ELSE k * 7919 % 1009 END * CASE WHEN k % 37 % 2 = 0 THEN 1 END AS o_totalprice FROM range(20000) t(k)")
    for t in ("customer", "orders"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    conf = spark.sparkContext._jsc.sc().env().conf()
    conf.set(threshold, "100")
    try:
        got = catalog.QUERIES["join_lateral"](spark, str(tmp_path)).collect()
    finally:
        conf.remove(threshold)
    assert rows(["c_custkey", "o_orderkey"], got) == rows(["c_custkey", "o_orderkey"], con.execute(catalog.ORACLES["join_lateral"]).fetchall())


def test_entry_without_the_subpackage(spark):
    """The entry point works when the subpackage and the pipeline are gone."""
    import importlib
    import sys

    import __spark_entry__ as entry

    hidden = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("sparklake.llm") or k == "corpus_pipeline"}
    try:
        sys.modules["sparklake.llm"] = sys.modules["corpus_pipeline"] = None
        alone = importlib.reload(entry)
        assert set(alone.queries()) == set(catalog.QUERIES) and set(alone.oracle_sql()) == set(catalog.ORACLES)
    finally:
        for k in ("sparklake.llm", "corpus_pipeline"):
            del sys.modules[k]
        sys.modules.update(hidden)
        importlib.reload(entry)
