"""Stages of the pipeline over columns that bear a stage's own names, null ids, and a row repeated many times."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm.exact_dedup import exact_dedup

SF = "/root/testdata/sf0.001"
CLASHES = ["_row", "_key", "_kept", "_gone", "_id", "_doc", "_own", "_size", "_of", "_run", "_text", "_bad", "passes", "runs", "taken", "size", "start", "end", "row", "length", "piece", "score", "predicted", "copies", "kept", "id", "bucket", "a.b"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "a b c d e f g"), (None, "a b c d e f g h"), (2, None), (3, "x " * 200), (3, "x " * 200), (4, ""), (5, "one two three four five six seven"), (6, "one two three four five six seven eight nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "if(doc_id % 2 = 0, 's', 't') AS source", "cast(length(text) AS long) AS n_chars")
    return docs.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_that_clash(spark, clashing, name):
    got = dict(corpus_pipeline.STAGES)[name](spark, clashing, SF)
    assert got.columns == clashing.columns and got.schema.simpleString() == clashing.schema.simpleString()
    rows = got.collect()
    assert rows and all(r[c] == f"{c}-{'none' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)


def test_the_last_stage_over_clashing_columns(spark, clashing):
    assert corpus_pipeline.packed_sequences(spark, clashing, SF).count() == 8


def test_a_row_repeated_many_times(spark):
    one = spark.createDataFrame([(None, "some words of a repeated row")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    docs = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(100_000))).alias("n")).drop("n").unionByName(one.withColumn("doc_id", F.lit(9).cast("long")))
    assert corpus_pipeline.clean_language(spark, docs, SF).count() == 100_001
    kept = corpus_pipeline.unique_texts(spark, docs, SF)
    assert [r.doc_id for r in kept.collect()] == [9]
    assert corpus_pipeline.distinct_documents(spark, docs, SF).count() == 100_001
    mixed = corpus_pipeline.mixed_sources(spark, docs, SF)
    assert abs(mixed.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] - 600_006) <= 64
    sizes = exact_dedup(docs, slice_rows=999).groupBy("kept").count().collect()
    assert sorted((r["kept"], r["count"]) for r in sizes) == [(False, 100_000), (True, 1)]
