import random

import numpy as np
import pyarrow as pa
import pytest

from sparklake.llm import decontamination as d
from sparklake.llm.common import texts
from sparklake.llm.queries import QUERIES


def brute(p, t, least):
    pf, tf, total = [True] * len(p), [x != 0 for x in t], 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and pf[i + k] and tf[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < least:
            return total
        for z in range(best[0]):
            pf[z - best[1]] = tf[z - best[2]] = False
        total += best[0]


def test_tiles_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        most = rng.choice([2, 3, 6])
        p = [rng.randint(1, most) for _ in range(rng.randint(1, 25))]
        t = [rng.randint(0, most) for _ in range(rng.randint(1, 40))]
        found = d.tiles(np.array(p, np.uint64), np.array(t, np.uint64), 3)
        assert sum(k for *_, k in found) == brute(p, t, 3)
        assert all(p[i : i + k] == t[j : j + k] for i, j, k in found)


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


@pytest.mark.parametrize(
    ("text", "covered"),
    [
        (ITEM, 16), (ITEM.upper().replace(" ", "!! "), 16), (" ".join(ITEM.split()[8:] + ["and"] + ITEM.split()[:8]), 16), ("“" + ITEM.replace(" ", " — ") + "”", 16), (" ".join(ITEM.split()[:9]), 9),
        (" ".join(ITEM.split()[:7]), None), ("", None), (None, None), (" x ".join(ITEM.split()), None),
    ],
)
def test_coverage(text, covered):
    got = [c for _, _, c, _ in d.Items([7], [ITEM]).leaks(texts(pa.array([text], pa.string())), 0.5)]
    assert got == ([covered] if covered else [])


def test_short_items_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "well hello there my friend"), (2, "hello friend"), (3, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Hello, there"), (2, ITEM), (3, ITEM), (4, ""), (5, None), (None, ITEM)], "item_id long, text string")
    want = {(1, 1), (3, 2), (3, 3)}
    for size in (1_000_000, 1):  # one block, then a block for each item
        monkeypatch.setattr(d, "BLOCK_WORDS", size)
        assert {(r.id, r.item_id) for r in d.find_leaks(docs, items).collect()} == want
        assert [r.doc_id for r in d.without_leaks(docs, items).collect()] == [2]
    empty = items.limit(0)
    assert d.find_leaks(docs, empty).count() == 0 and d.without_leaks(docs, empty).count() == 3


def test_filtering_needs_no_item_id(spark):
    docs = spark.createDataFrame([(1, f"so {ITEM} it goes"), (2, "hello friend")], "doc_id long, text string")
    items = spark.createDataFrame([(None, ITEM), (None, None)], "item_id long, text string")
    assert [r.doc_id for r in d.without_leaks(docs, items).collect()] == [2]


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog")], "item_id long, text string")
    assert sorted(r.id for r in d.find_leaks(odd, items).collect()) == [1, 1, 2]
    assert d.find_leaks(none, items).count() == 0
    assert d.without_leaks(odd, items).columns == odd.columns


def test_query_against_whole_items(spark, sf_dir, texts_by_id):
    import re

    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, sf_dir).collect()}
    items = {r.item_id: " ".join(words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    whole = {(k, i) for k, t in texts_by_id.items() for i, x in items.items() if f" {x} " in f" {' '.join(words(t))} "}
    assert whole and whole <= got
    seeds = {i: {tuple(w[a : a + 5]) for a in range(len(w) - 4)} for i, w in ((i, x.split()) for i, x in items.items())}
    for k, i in got:  # nothing is reported that shares less than half of an item's words in runs of five
        w = words(texts_by_id[k])
        have = {tuple(w[a : a + 5]) for a in range(len(w) - 4)}
        x = items[i].split()
        own = {a + b for a in range(len(x) - 4) if tuple(x[a : a + 5]) in have for b in range(5)}
        assert len(own) >= 0.5 * len(x) and seeds[i]
