import corpus_pipeline
from loomline.llm.toxicity import learnt, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        seen[name] = (docs.collect(), spark.read.parquet(str(tmp_path / name)).collect())
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns
    ids = lambda rows: sorted(r.doc_id for r in rows)
    before, after = seen["toxicity"]
    first = spark.read.parquet(f"{SF}/documents.parquet")
    bad = {r.doc_id for r in toxicity(first, learnt(spark, first, SF)).filter("predicted = 1").collect()}
    assert ids(after) == [r.doc_id for r in sorted(before, key=lambda r: r.doc_id) if r.doc_id not in bad]
    before, after = seen["exact_dedup"]
    want = brute.exact([(r.doc_id, r.text) for r in before])
    assert ids(after) == sorted({k for k, _ in want.values()})
    before, after = seen["near_dedup"]
    assert ids(after) == sorted(set(brute.components([(r.doc_id, r.text) for r in before]).values()))
    before, after = seen["mixing"]
    words = lambda rows: sum(len(brute.WORD.findall(r.text)) for r in rows)
    assert abs(words(after) - words(before)) <= 0.02 * words(before) and all(r.n_chars == len(r.text) for r in after)
    packed = seen["packing"][1]
    assert {r.doc_id for r in packed} == {r.doc_id for r in after} and max(r.offset + r.length for r in packed) <= 1024


def test_repeats_and_nulls(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "q w e r t y"), (None, "z"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    kept = corpus_pipeline.unique_texts(spark, docs, SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "q w e r t y"), (0, "z"), (1, "a b"), (3, "")]
    assert corpus_pipeline.distinct_documents(spark, kept, SF).count() == 4
    assert corpus_pipeline.clean_language(spark, kept, SF).count() == 4
    mixed = corpus_pipeline.mixed_sources(spark, kept, SF)
    assert mixed.columns == docs.columns and corpus_pipeline.packed_sequences(spark, mixed, SF).count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
