"""Toxicity decides row by row in the pipeline."""

import corpus_pipeline
from loomline.llm.toxicity import learnt, toxicity

SF = "/root/testdata/sf0.001"


def test_toxic_rows_go_whatever_their_id(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    model = learnt(spark, first, SF)
    scored = toxicity(first, model).select("doc_id", "predicted")
    texts = {r.doc_id: (r.predicted, r.text) for r in first.join(scored, "doc_id").select("doc_id", "predicted", "text").collect()}
    bad, good = (min((i, t) for i, (p, t) in texts.items() if p == kind) for kind in (1, 0))
    # The documents that the score is learnt from, then a toxic row without an id, and a toxic and a clean row of one id.
    more = [(None, bad[1]), (None, good[1]), (None, None), (-5, bad[1]), (-5, good[1])]
    rows = spark.createDataFrame(more, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    kept = corpus_pipeline.clean_language(spark, first.select(rows.columns).unionByName(rows), SF)
    assert kept.columns == rows.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.filter("source = 's'").collect())
    assert got == sorted([("None", good[1]), ("None", ""), ("-5", good[1])])
    assert kept.filter("source = 's' AND text IS NULL").count() == 1
