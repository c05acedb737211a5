"""Queries over the driver's tables for vector search and indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import relational as R
from loomline.operators import vectors as V
from loomline.operators.editing import chunked
from loomline.plans.registry import query


def _points(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("src/"), F.col("label").cast("string"), F.lit("/f")).alias("filePath"), "label")


def _query(t, vec_id: int) -> list[float]:
    return t("embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query("vs01_search", f"SELECT e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND {_COS} >= 0.2 ORDER BY {_COS} DESC, e.vec_id LIMIT 50")
def _(t, spark):
    return V.search(_points(t), _query(t, 0), min_score=0.2).select("id", F.round("score", 6).alias("score"))


_THREE = "(SELECT list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE + b.embedding[i]::DOUBLE + c.embedding[i]::DOUBLE) AS embedding FROM embeddings a, embeddings b, embeddings c WHERE a.vec_id = 0 AND b.vec_id = 1 AND c.vec_id = 2)"


@query("vs01_search_default", f"SELECT e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, {_THREE} q WHERE {_COS} >= 0.4 ORDER BY {_COS} DESC, e.vec_id LIMIT 50")
def _(t, spark):
    """What is like three vectors at once, by the default threshold and limit."""
    whole = [float(sum(x)) for x in zip(*(_query(t, i) for i in range(3)), strict=True)]
    return V.search(_points(t), whole).select("id", F.round("score", 6).alias("score"))


@query("vs02_search_prefix", f"SELECT e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 3 AND e.label = 1 AND {_COS} >= -1 ORDER BY {_COS} DESC LIMIT 20")
def _(t, spark):
    return V.search(_points(t), _query(t, 3), prefix="src/1", min_score=-1.0, limit=20).select("id", F.round("score", 6).alias("score"))


@query("vs03_search_many", f"""
SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.label = 2 AND {_COS} >= 0.1
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) <= 5""")
def _(t, spark):
    queries = t("embeddings").filter("label = 2").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.search_many(_points(t), queries, 5, 0.1).select("query_id", "id", F.round("score", 6).alias("score"))


@query("vs03_search_twentieth", f"""
SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND {_COS} >= 0.1
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) <= 5""")
def _(t, spark):
    queries = t("embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.search_many(_points(t), queries, 5, 0.1).select("query_id", "id", F.round("score", 6).alias("score"))


@query("vs04_threshold", "SELECT vec_id, coalesce(CASE WHEN label = 1 THEN 0.7::DOUBLE END, CASE WHEN label = 2 THEN 0.25::DOUBLE END, 0.4::DOUBLE) AS threshold FROM embeddings")
def _(t, spark):
    user, model = F.when(F.col("label") == 1, 0.7), F.when(F.col("label") == 2, 0.25)
    return t("embeddings").select("vec_id", V.min_score(user, model).alias("threshold"))


@query("vs05_workspaces", f"""
SELECT * FROM (SELECT 'even' AS workspace, e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label % 2 = 0 AND {_COS} >= 0.2 ORDER BY {_COS} DESC LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'odd', e.vec_id, round({_COS}, 6) FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label % 2 = 1 AND {_COS} >= 0.2 ORDER BY {_COS} DESC LIMIT 10)""")
def _(t, spark):
    q, points = _query(t, 0), _points(t)
    one = lambda name, r: V.search(points.filter(F.col("label") % 2 == r), q, min_score=0.2, limit=10).select(F.lit(name).alias("workspace"), "id", F.round("score", 6).alias("score"))
    return R.concatenated(one("even", 0), one("odd", 1))


@query("vs07_chunks")
def _(t, spark):
    return chunked(t("documents"), "doc_id", "text")


@query("vs10_segment_hash", "SELECT doc_id, sha256(doc_id::VARCHAR || '-1-' || (1 + length(text) - length(replace(text, chr(10), '')))::VARCHAR || '-' || length(text)::VARCHAR || '-' || substring(text, 1, 100)) AS digest FROM documents")
def _(t, spark):
    lines = F.size(F.split("text", "\n"))
    return t("documents").select("doc_id", V.segment_hash(F.col("doc_id").cast("string"), F.lit(1), lines, F.col("text")).alias("digest"))


@query("vs11_point_id", """
WITH h AS (SELECT doc_id, sha1(unhex('f47ac10b58cc4372a5670e02b2c3d479') || encode(sha256(text))) AS r FROM documents)
SELECT doc_id, r[1:8] || '-' || r[9:12] || '-5' || r[14:16] || '-' || substring('89ab', ((strpos('0123456789abcdef', r[17:17]) - 1) % 4 + 1)::INT, 1) || r[18:20] || '-' || r[21:32] AS id FROM h""")
def _(t, spark):
    return t("documents").select("doc_id", V.point_id(F.sha2("text", 256)).alias("id"))


@query("vs15_segments", """
WITH p AS (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS s FROM pages) SELECT page_id, (generate_subscripts(s, 1) - 1)::VARCHAR AS place, unnest(s) AS segment FROM p""")
def _(t, spark):
    return V.with_segments(t("pages"), "url").select("page_id", F.explode("pathSegments").alias("place", "segment"))
