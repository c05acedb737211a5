"""Queries over the driver's tables for the evaluation store, registered functions and states of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions.registry import Registry, Tool
from loomline.operators import aggregates as A
from loomline.operators import editing as E
from loomline.plans.registry import query
from loomline.sources import stores as St


def _some(t, low, high):
    return t("orders").filter(f"o_orderkey % 10 BETWEEN {low} AND {high}").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))


@query("sc05_inserted", """
WITH old AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 < 5), new AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 5),
top AS (SELECT greatest((SELECT max(id) FROM old), (SELECT max(id) FROM new)) AS top), n AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 10 > 7)
SELECT id, 'kept' AS state FROM old UNION ALL SELECT id, 'own' FROM new UNION ALL SELECT unnest(range(top + 1, top + n + 1)), 'numbered' FROM top, n""")
def _(t, spark):
    old = _some(t, 0, 4).withColumn("state", F.lit("kept"))
    new = _some(t, 5, 5).withColumn("state", F.lit("own")).unionByName(_some(t, 8, 9).withColumns({"id": F.lit(None).cast("long"), "state": F.lit("numbered")}))
    return St.inserted(old, new)[0]


@query("sc06_updated", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 3 THEN 'new' ELSE o_orderstatus END AS state FROM orders WHERE o_orderkey % 10 < 5")
def _(t, spark):
    changes = _some(t, 3, 3).withColumn("state", F.lit("new")).unionByName(_some(t, 4, 4).withColumn("state", F.lit(None).cast("string")))
    return St.updated(_some(t, 0, 4), changes)


# Orders as runs, their lines as tasks; each has metrics of its own, and every fifth line an error.
def _store(t):
    runs = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 10).alias("task_metrics_id"))
    line = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    tasks = line.select(key.alias("id"), F.col("l_orderkey").alias("run_id"), key.alias("task_metrics_id"))
    metrics = runs.select(F.col("task_metrics_id").alias("id")).unionByName(tasks.select(F.col("task_metrics_id").alias("id")))
    errors = line.filter("p % 5 = 0").select(key.alias("id"), F.col("l_orderkey").alias("run_id"), key.alias("task_id"))
    return {"runs": runs, "tasks": tasks, "metrics": metrics, "tool_errors": errors}


_STORE_COUNTS = """
WITH l AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2), o AS (SELECT o_orderkey FROM orders WHERE {runs}), k AS (SELECT * FROM l WHERE {tasks})
SELECT 'runs' AS name, count(*) AS n FROM o UNION ALL SELECT 'tasks', count(*) FROM k UNION ALL SELECT 'metrics', (SELECT count(*) FROM o) + (SELECT count(*) FROM k) UNION ALL SELECT 'tool_errors', count(*) FROM k WHERE p % 5 = 0"""


def _counts(tables):
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, d in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("sc07_deleted_runs", _STORE_COUNTS.format(runs="o_orderkey % 3 <> 0", tasks="l_orderkey % 3 <> 0"))
def _(t, spark):
    return _counts(St.deleted_runs(_store(t), t("orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))))


@query("sc08_copied_run", """
WITH r AS (SELECT max(l_orderkey) AS r FROM lineitem), l AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2), m AS (SELECT * FROM l, r WHERE l_orderkey = r)
SELECT 'runs' AS name, (SELECT count(*) FROM orders) + 1 AS n, (SELECT count(*) FROM orders) + 1 AS keys UNION ALL SELECT 'tasks', (SELECT count(*) FROM l) + count(*), (SELECT count(*) FROM l) + count(*) FROM m
UNION ALL SELECT 'metrics', (SELECT count(*) FROM orders) + (SELECT count(*) FROM l) + 1 + count(*), (SELECT count(*) FROM orders) + (SELECT count(*) FROM l) + 1 + count(*) FROM m
UNION ALL SELECT 'tool_errors', (SELECT count(*) FROM l WHERE p % 5 = 0) + count(*), (SELECT count(*) FROM l WHERE p % 5 = 0) + count(*) FROM m WHERE p % 5 = 0""")
def _(t, spark):
    run = t("lineitem").agg(F.max("l_orderkey")).first()[0]
    own = _store(t)
    both = St.copied_run(own, own, run)
    counted = [d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("keys")).select(F.lit(name).alias("name"), "n", "keys") for name, d in both.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


@query("st08_changes", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r = 1 OR b IS DISTINCT FROM event_type")
def _(t, spark):
    return A.changes(t("events"), "user_id", "event_id", ["event_type"]).select("event_id")


class _Halves:
    def eval(self, n: int):
        while n > 0:
            yield (n,)
            n //= 2


@query("ud01_scalar", "SELECT p_partkey, p_size * 2 + 1 AS made FROM part")
def _(t, spark):
    r = Registry(spark)
    r.register(Tool("loomline_odd", lambda n: n * 2 + 1, "the odd number after twice a number", {"n": "long"}, "long"))
    return r.apply(t("part").select("p_partkey", F.col("p_size").cast("long").alias("p_size")), "loomline_odd", "p_size", into="made").select("p_partkey", "made")


@query("ud02_aggregate", "SELECT p_brand, max(p_size) - min(p_size) AS made FROM part GROUP BY 1")
def _(t, spark):
    def spread(n):
        return int(n.max() - n.min())

    # A pandas function is an aggregate by the types of its parameter and result.
    import pandas as pd

    spread.__annotations__ = {"n": pd.Series, "return": int}
    Registry(spark).register(Tool("loomline_spread", spread, "greatest less least", {"n": "long"}, "long", "aggregate"))
    return t("part").groupBy("p_brand").agg(F.call_function("loomline_spread", F.col("p_size").cast("long")).alias("made"))


@query("ud03_problems", "SELECT * FROM (VALUES ('good', 0::BIGINT), ('no name', 1), ('typeless', 1), ('kindless', 1)) v(name, problems)")
def _(t, spark):
    from loomline.functions.registry import problems_of

    tools = [Tool("good", str, "fine"), Tool("no name", str, "spaces"), Tool("typeless", str, "odd type", {"x": "strange"}), Tool("kindless", str, "odd kind", kind="odd")]
    return spark.createDataFrame([(x.name, len(problems_of(x))) for x in tools], "name string, problems long")


@query("ud04_table", "WITH RECURSIVE h AS (SELECT DISTINCT p_size AS of, p_size AS n FROM part UNION ALL SELECT of, n // 2 FROM h WHERE n // 2 > 0) SELECT of, n FROM h")
def _(t, spark):
    Registry(spark).register(Tool("loomline_halves", _Halves, "a number and its halves", {"n": "long"}, "n long", "table"))
    t("part").select(F.col("p_size").cast("long").alias("of")).distinct().createOrReplaceTempView("loomline_sizes")
    return spark.sql("SELECT of, n FROM loomline_sizes, LATERAL loomline_halves(of)")


@query("xs06_path_order", "SELECT p_partkey, (row_number() OVER (ORDER BY p_size % 3 = 0, p_size, p_partkey))::BIGINT AS place FROM part")
def _(t, spark):
    from pyspark.sql import Window

    # Folders before files, then numbers by value.
    path = F.concat(F.lit("Item"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("/"), F.col("p_partkey").cast("string"))).otherwise(F.lit("")))
    key = T.path_sort_key(path)
    return t("part").select("p_partkey", F.row_number().over(Window.orderBy(key, "p_partkey")).cast("long").alias("place"))


@query("bg06_pruned_tokens")
def _(t, spark):
    import public_tokenizers

    return t("benchmark").select("item_id", E.pruned_tokens(F.col("text"), 12, public_tokenizers.path("byte_bpe_50k.json")).alias("head"))


@query("bg15_token_counts")
def _(t, spark):
    import public_tokenizers

    return t("benchmark").select("item_id", E.token_count(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("n"))
