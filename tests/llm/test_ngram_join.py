import random
import re
import string

import numpy as np
import pytest

from sparklake.llm import ngram_join as nj
from sparklake.llm.graph import components
from sparklake.llm.queries import QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def grams(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(texts, k, percent):
    sets = {d: grams(t, k) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def copies(seed, groups=6, most=40):
    rng = random.Random(seed)
    out = {}
    for _ in range(groups):
        base = [rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(rng.randint(0, 30)) for _ in range(rng.choice([2, 5, 12, 40, 120]))]
        for _ in range(rng.randint(1, most)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 500)}"
            out[len(out) * 3 + 1] = rng.choice([" ", "  ", "\n"]).join(w).replace("alpha", rng.choice(["alpha", "ALPHA"]))
    return out


def found(spark, texts, **kw):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.id: (r.n, r.component) for r in nj.ngram_jaccard_groups(df, **kw).collect()}


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 60), (6, 2, 50)])
def test_groups_of_copies(spark, seed, k, percent):
    texts = copies(seed)
    assert found(spark, texts, k=k, percent=percent) == brute(texts, k, percent)


def test_many_blocks(spark, monkeypatch):
    """The same groups when every cluster is cut into many blocks, tiles and column blocks."""
    for name, value in (("BLOCK_WEIGHT", 300), ("LEAST_WEIGHT", 20), ("ROWS", 3), ("CELLS", 64), ("FEW", 2)):
        monkeypatch.setattr(nj, name, value)
    texts = copies(4, groups=4, most=50)
    assert found(spark, texts, k=3, percent=90) == brute(texts, 3, 90)


def test_query_against_brute_force(spark, sf_dir, texts_by_id):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_ngram_jaccard_join"](spark, sf_dir).collect()}
    assert got == brute(texts_by_id, 3, 90)


def test_links_by_block():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 50).astype(np.uint64)
    rows = [np.unique(np.concatenate([base[rng.random(50) < 0.95], rng.integers(0, 9, 2).astype(np.uint64)])) for _ in range(12)] + [np.zeros(0, np.uint64)]
    want = {(i, j) for i in range(13) for j in range(i + 1, 13) if len(rows[i]) and len(rows[j]) and 100 * len(np.intersect1d(rows[i], rows[j])) >= 90 * len(np.union1d(rows[i], rows[j]))}
    assert {(u, int(v)) for u, vs in nj.links(rows, 90) for v in vs} == want
    assert len(nj.forest(13, nj.links(rows, 90))) < 13


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(3)
    rows = []
    for n in (3, 40, 70, 500, 700):
        base = rng.integers(0, 1 << 62, n).astype(np.uint64)
        rows += [np.unique(np.concatenate([base[rng.random(n) < 0.93], rng.integers(0, 1 << 62, rng.integers(0, 1 + n // 20)).astype(np.uint64)])) for _ in range(8)]
    size = np.array([len(r) for r in rows])
    sketch = nj.parities(np.concatenate(rows), np.repeat(np.arange(len(rows)), size), size)
    for percent in (80, 90):
        may = {(u, int(v)) for u, vs in nj.by_sketch(sketch, size.tolist(), percent) for v in vs}
        have = {(u, int(v)) for u, vs in nj.links(rows, percent) for v in vs}
        assert have and have <= may and len(may) < 400


def test_odd_rows(spark, odd, none):
    rows = nj.ngram_jaccard_groups(odd, k=3, percent=90).collect()
    assert len(rows) == odd.count()
    by = {r.id: r for r in rows}
    assert by[2].component == by[1].component == 1 and by[3].n == by[4].n == by[6].n == 0 and by[4].component == 4 and by[None].component is None
    assert nj.ngram_jaccard_groups(none).count() == 0
    kept = nj.first_of_each(odd, k=3, percent=90)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 1, 3, 4, None, 5, 6, 7], key=str)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u and v and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_oracles_are_sql_and_op3_agrees_with_its_own(spark, tmp_path):
    import duckdb

    import __spark_entry__
    from sparklake.llm.queries import ORACLES, QUERIES

    assert all(isinstance(x, str) for x in __spark_entry__.oracle_sql().values())
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(60)] for _ in range(12)]
    rows = [(i, " ".join(base[i % 12][: 60 - i // 12])) for i in range(48)] + [(48, None), (49, ""), (50, "One two"), (51, "one  TWO"), (52, rng.choice("xyz"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(ORACLES["op3_ngram_jaccard_join"]).fetchall()
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op3_ngram_jaccard_join"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len({c for *_, c in got}) < len(got)
