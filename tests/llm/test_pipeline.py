import corpus_pipeline as cp
from sparklake.llm import pii, toxicity
from tests.llm.test_ngram_join import brute


def test_stages_against_brute_force(spark, sf_dir, documents, texts_by_id):
    names = documents.columns
    model = toxicity.learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    one = cp.not_toxic(spark, documents, sf_dir)
    scores = {r.id: r.score for r in toxicity.score(documents, model).collect()}
    assert one.columns == names
    kept = {r.doc_id: r.text for r in one.collect()}
    assert set(kept) == {k for k, s in scores.items() if s < 0.5}
    two = cp.one_of_each(spark, one, sf_dir)
    groups = brute(kept, 5, 80)
    assert two.columns == names and sorted(r.doc_id for r in two.collect()) == sorted(k for k, (_, c) in groups.items() if k == c)
    three = cp.not_leaked(spark, two, sf_dir)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in two.collect()} - {r.doc_id for r in three.collect()}
    assert gone >= {r.doc_id for r in two.collect() if any(i in r.text for i in items)}
    four = cp.no_personal_data(spark, three, sf_dir)
    assert four.columns == names and four.count() == three.count()
    for r in four.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
    five = cp.tokens(spark, four, sf_dir)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}


def test_run(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "pii", "sentencepiece"]
    rows = cp.run(spark, sf_dir).collect()
    assert rows and all(len(r.ids) == 4 * r.n_tokens for r in rows)


def test_odd_rows(spark, sf_dir, odd, none):
    for df in (odd.withColumnRenamed("spans", "n_chars").drop("id"), none.drop("id")):
        docs = df
        for _, stage in cp.STAGES[1:]:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() <= df.count()


def test_every_stage_on_odd_rows(spark, sf_dir, odd, none, tmp_path):
    """All five stages, toxicity too, with labels for the odd documents; and the whole run on an empty table."""
    import shutil

    docs = odd.withColumnRenamed("spans", "n_chars").drop("id")
    folder = str(tmp_path / "odd")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, None), (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    shutil.copy(f"{sf_dir}/benchmark.parquet", f"{folder}/benchmark.parquet")
    kept = docs
    for name, stage in cp.STAGES:
        before, kept = kept, stage(spark, kept, folder)
        if name == "toxicity":
            assert kept.count() == docs.count() and kept.columns == docs.columns
        if name == "ngram_jaccard_join":  # rows 1, 1 and 2 are copies: the smallest id stays, as often as it was there
            assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted((x is None, x) for x in (1, 1, 3, 4, None, 5, 6, 7))
        if name in ("pii", "sentencepiece"):
            assert kept.count() == before.count()
    empty = str(tmp_path / "empty")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{empty}/labels.parquet")
    shutil.copy(f"{sf_dir}/benchmark.parquet", f"{empty}/benchmark.parquet")
    assert cp.run(spark, empty).count() == 0
