import zlib
from collections import Counter, defaultdict

from sparklake.llm import sharding as s
from sparklake.llm.queries import QUERIES


def test_query(spark, sf_dir, texts_by_id):
    df = QUERIES["op2_sharding"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts_by_id)
    slots, size = defaultdict(list), Counter()
    for r in rows:
        raw = texts_by_id[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert sorted(slots) == list(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(r.size for r in rows)
    assert max(size.values()) - min(size.values()) <= 2 * largest


def balanced(spark, rows, shards, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = s.shard_documents(df, shards, **kw).collect()
    total = Counter()
    for r in got:
        total[r.shard] += r.size
    return got, total


def test_even_sizes_with_a_hot_text_and_a_hot_source(spark):
    rows = [(i, "copy " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 17), "en", "src0" if i % 3 else "src1") for i in range(3000)]
    for shards in (8, 3, 1):
        got, total = balanced(spark, rows, shards)
        assert len(got) == 3000 and len(total) == shards and max(total.values()) <= 1.02 * min(total.values())


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text number {i // 2} " * 3, "en", f"s{i % 5}") for i in range(20_000)]
    got, _ = balanced(spark, rows, 8)
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_sources_that_begin_alike_are_split(spark):
    rows = [(i, f"{i:06d}", "en", f"https://host/{i % 2}") for i in range(400)]
    got, total = balanced(spark, rows, 2)
    assert len({(r.shard, r.id % 2) for r in got}) == 2 and len(set(total.values())) == 1
    ordinals = s._ordinals(spark.createDataFrame([(f"https://host/{i}",) for i in range(50)] + [("",), (None,)], "source string"), "source")
    assert ordinals.distinct().count() == 52


def test_target_bytes(spark):
    got, total = balanced(spark, [(i, "x" * 99, "en", "a") for i in range(100)], 8, target_bytes=2_500)
    assert len(total) == 4 and max(total.values()) <= 2_600


def test_odd_rows(spark, odd, none):
    rows = s.shard_documents(odd, 8).collect()
    assert len(rows) == odd.count()
    nulls = next(r for r in rows if r.id == 3)
    assert (nulls.size, nulls.text_crc32) == (1, 0)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert s.shard_documents(none, 8).count() == 0


def test_runs_are_numbered_without_gaps(spark):
    placed = spark.range(5000).selectExpr("id", "1L AS size", "id AS text_crc32", "CAST(id % 3 AS INT) AS shard")
    got = s.number(placed, 5000, run=100).collect()
    for k in range(3):
        x = sorted(r.slot for r in got if r.shard == k)
        assert x == list(range(len(x)))


def test_equal_texts_stay_together_whatever_their_weight(spark, sf_dir):
    # heavy groups of a tenth to nine tenths of a shard, beside single texts that make up for them
    rows = [(i, f"group {i % 7} " * 40, "en", f"s{i % 3}") for i in range(7 * 60)] + [(1000 + i, f"single {i} " * (1 + i % 9), "de", "x") for i in range(4000)]
    got, total = balanced(spark, rows, 8)
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32, r.size].add(r.shard)
    assert all(len(x) == 1 for x in where.values()) and max(total.values()) <= 1.02 * min(total.values())
    documents = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    where = defaultdict(set)
    for r in s.shard_documents(documents, 8).collect():
        where[r.text_crc32, r.size].add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_plans_do_not_grow_with_the_leaves(spark):
    rows = [(i, f"text {i} " * (1 + i % 5), "en", f"s{i % 3}") for i in range(3000)]
    got, total = balanced(spark, rows, 300)
    assert len(total) == 300 and max(total.values()) <= 2 * min(total.values())


def test_medians_against_sorting(spark):
    units = spark.range(2000).selectExpr("id % 3 + 4 AS node", "rand(5) AS size", "rand(6) AS lang", "0D AS source", "shiftrightunsigned(xxhash64(id), 28) AS tie", "1 + id % 11 AS weight")
    units = spark.createDataFrame(units.collect(), units.schema)
    dimension = {4: "size", 5: "lang", 6: "source"}
    rows = units.withColumn("dimension", s.F.element_at(s.F.array(*map(s.F.lit, dimension.values())), (s.F.col("node") - 3).cast("int"))).withColumn("key", s._chosen_key()).collect()
    for share in (0.0, 0.2, 0.5, 1.0):
        left = {n: share * sum(r.weight for r in rows if r.node == n) for n in dimension}
        cut = s.medians(units, dimension, left)
        for n in dimension:
            own = sorted((r.key, r.weight) for r in rows if r.node == n)
            sums = [0]
            for _, w in own:
                sums.append(sums[-1] + w)
            got = sum(w for k, w in own if k <= cut[n])
            assert abs(got - left[n]) == min(abs(x - left[n]) for x in sums)
