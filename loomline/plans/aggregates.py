"""Queries over the driver's tables for aggregations and streams in their batch form."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loomline.operators import aggregates as A
from loomline.operators import budgets as B
from loomline.operators import sequences as S
from loomline.plans.registry import query
from loomline.plans.relational import SQL_PASSED, passed
from loomline.streaming import jobs as J


@query("ag01_finish_run", f"""
SELECT o_custkey, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price, count(*) FILTER (passed) AS passed, count(*) FILTER (passed IS NOT TRUE) AS failed
FROM (SELECT *, {SQL_PASSED} AS passed FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def _(t, spark):
    """Sums of a run's metrics, and its verdicts; a task without one failed."""
    tasks = t("lineitem").withColumn("passed", passed())
    runs = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey")
    out = A.run_totals(tasks, runs, "o_custkey", "o_orderkey", "l_orderkey", sums=("l_quantity", "l_extendedprice"))
    return out.select("o_custkey", F.col("l_quantity").alias("quantity"), F.round("l_extendedprice", 2).alias("price"), "passed", "failed")


@query("ag02_language_scores", """
SELECT l_suppkey, coalesce(avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0 END) FILTER (l_linestatus = 'O'), 0) AS "O", coalesce(avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0 END) FILTER (l_linestatus = 'F'), 0) AS "F" FROM lineitem GROUP BY 1""")
def _(t, spark):
    return A.language_scores(t("lineitem").withColumn("passed", passed()), "l_suppkey", "l_linestatus", "passed", ["O", "F"])


def _usage(t):
    entry = F.create_map(F.col("event_type"), F.struct(F.lit(1).alias("attempts"), (F.col("value") < 10).cast("int").alias("failures")))
    return t("events").select("user_id", "ts", entry.alias("tool_usage"))


@query("ag03_tool_usage", "SELECT user_id, event_type AS tool, count(*) AS attempts, sum(CASE WHEN value < 10 THEN 1 ELSE 0 END)::BIGINT AS failures FROM events GROUP BY 1, 2")
def _(t, spark):
    return A.merged_usage(_usage(t), ["user_id"])


@query("ag05_run_stats", f"""
SELECT l_suppkey, count(*) AS total, count(*) FILTER (p) AS passed, count(*) FILTER (NOT p) AS failed, count(p) AS completed, count(*) - count(p) AS remaining, count(*) FILTER (p) * 100.0::DOUBLE / nullif(count(p), 0) AS pass_rate, count(*) FILTER (l_linestatus = 'F') AS finished
FROM (SELECT *, {SQL_PASSED} AS p FROM lineitem) GROUP BY 1""")
def _(t, spark):
    return A.run_stats(t("lineitem").withColumn("passed", passed()), "l_suppkey", "passed", F.col("l_linestatus") == "F")


@query("ag07_last_value", "SELECT user_id, arg_max(value, (ts, event_id)) FILTER (value > 0 AND event_type <> 'error') AS last_value FROM events GROUP BY 1")
def _(t, spark):
    ok = (F.col("value") > 0) & (F.col("event_type") != "error")
    return t("events").groupBy("user_id").agg(F.max_by(F.when(ok, F.col("value")), F.when(ok, F.struct("ts", "event_id"))).alias("last_value"))


def _tree_costs(t, spark, roots):
    n = S.numbered(t("orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("cost")), [F.asc_nulls_last("o_orderkey")]).select((F.col("index") + 1).cast("long").alias("id"), "cost")
    n.withColumn("parent", F.when(F.floor(F.col("id") / 2) != F.col("id"), F.floor(F.col("id") / 2))).createOrReplaceTempView("loomline_tree")
    return A.tree_cost(spark, "loomline_tree", "id", "parent", "cost", roots)


@query("ag08_tree_cost", """
WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS id, round(o_totalprice)::BIGINT AS cost FROM orders),
t AS (SELECT id AS root, id, cost, 0 AS d FROM n WHERE id % 100 = 1 UNION ALL SELECT t.root, n.id, n.cost, d + 1 FROM t JOIN n ON n.id // 2 = t.id AND n.id <> t.id)
SELECT root, sum(cost) FILTER (d = 0)::BIGINT AS own, coalesce(sum(cost) FILTER (d > 0), 0)::BIGINT AS children, sum(cost)::BIGINT AS total, count(*) AS nodes FROM t GROUP BY 1""")
def _(t, spark):
    return _tree_costs(t, spark, "id % 100 = 1")


@query("ag08_all_tree_costs", """
WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS id, round(o_totalprice)::BIGINT AS cost FROM orders),
t AS (SELECT id AS root, id, cost, 0 AS d FROM n UNION ALL SELECT t.root, n.id, n.cost, d + 1 FROM t JOIN n ON n.id // 2 = t.id AND n.id <> t.id)
SELECT root, sum(cost) FILTER (d = 0)::BIGINT AS own, coalesce(sum(cost) FILTER (d > 0), 0)::BIGINT AS children, sum(cost)::BIGINT AS total, count(*) AS nodes FROM t GROUP BY 1""")
def _(t, spark):
    """Every node's tree; ag08_tree_cost shows those that its SQL asks for."""
    return _tree_costs(t, spark, "true")


@query("ag09_storage_stats", "SELECT event_type, count(*) AS n, min(ts) AS oldest, max(ts) AS newest, round(sum(value), 4) AS size FROM events GROUP BY 1")
def _(t, spark):
    return A.storage_stats(t("events"), "event_type", "ts", "value").withColumn("size", F.round("size", 4))


@query("ag10_accuracy", """
WITH r AS (SELECT lang, CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS outcome FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT lang, count(*) AS n, count(*) FILTER (outcome = 'pass') AS passed, count(*) FILTER (outcome = 'pass')::DOUBLE / count(*) AS rate, (SELECT count(*) FILTER (outcome = 'pass')::DOUBLE / count(*) FILTER (outcome <> 'unknown') FROM r) AS accuracy FROM r GROUP BY 1""")
def _(t, spark):
    rows = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    outcome = F.when(F.col("quality").isNull(), "unknown").when(F.col("quality") == 1, "pass").otherwise("fail")
    return A.category_accuracy(rows.select("lang", outcome.alias("outcome")), "lang", "outcome")


@query("ag11_latency", "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest, list_sort(list(value))[(count(*) // 2 + 1)::INT] AS median FROM events GROUP BY 1")
def _(t, spark):
    return A.latency_stats(t("events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("ag12_shares", "SELECT l_returnflag, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem) AS percent FROM lineitem GROUP BY 1")
def _(t, spark):
    return A.shares(t("lineitem"), "l_returnflag")


@query("ag13_options", "SELECT DISTINCT p_brand FROM part")
def _(t, spark):
    return A.options(t("part"), "p_brand")


@query("ag14_tool_columns", "SELECT event_type AS tool, count(*) AS attempts FROM events GROUP BY 1")
def _(t, spark):
    return A.tool_columns(A.merged_usage(_usage(t), ["user_id"]))


@query("ag15_tool_groups", "SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'browsing' ELSE event_type END AS name, count(*) AS attempts, sum(CASE WHEN value < 10 THEN 1 ELSE 0 END)::BIGINT AS failures FROM events GROUP BY 1, 2")
def _(t, spark):
    groups = spark.createDataFrame([("click", "browsing"), ("view", "browsing")], "tool string, group string")
    return A.grouped_tools(A.merged_usage(_usage(t), ["user_id"]), groups, ["user_id"])


@query("ag16_usage_window", """
WITH n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, coalesce(sum(event_id) FILTER (event_type = 'view'), 0)::BIGINT AS tokens, coalesce(sum(event_id) FILTER (event_type = 'click'), 0)::BIGINT AS requests FROM events, n WHERE ts >= now - INTERVAL 86400 SECOND AND ts <= now GROUP BY 1""")
def _(t, spark):
    e = t("events").withColumn("kind", F.when(F.col("event_type") == "view", "tokens").when(F.col("event_type") == "click", "requests"))
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    return A.usage_in_window(e, "user_id", "ts", now, 86400, "kind", "event_id")


@query("ag17_elapsed", "SELECT user_id, date_diff('second', min(ts), max(ts)) AS seconds FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY 1")
def _(t, spark):
    e = t("events").withColumn("ts", F.date_trunc("second", "ts"))
    return A.elapsed(e, "user_id", "ts", "ts")


@query("ag18_counters", "SELECT count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS incomplete, count(*) FILTER (l_shipdate < TIMESTAMP '1995-06-01' - INTERVAL 30 DAY) AS old FROM lineitem")
def _(t, spark):
    old = F.col("l_shipdate") < F.lit(datetime(1995, 6, 1)).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")
    return t("lineitem").agg(F.count_if(passed().isNull()).alias("incomplete"), F.count_if(old).alias("old"))


@query("ag19_purge", """
WITH k AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderpriority = '1-URGENT' THEN 'favorite' WHEN o_orderstatus = 'F' THEN 'default' ELSE 'incomplete' END AS class FROM orders),
a AS (SELECT o_orderkey, class, (epoch(TIMESTAMP '1999-01-01') - epoch(o_orderdate))::BIGINT // 86400 AS age_days, CASE class WHEN 'default' THEN 1500 WHEN 'incomplete' THEN 700 END AS retention FROM k)
SELECT * FROM a WHERE age_days > retention""")
def _(t, spark):
    o = t("orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    done = t("orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "favorite").otherwise("default")
    return A.purgeable(o, done, "o_orderkey", kind, "o_orderdate", {"favorite": None, "default": 1500, "incomplete": 700}, F.lit(datetime(1999, 1, 1))).select("o_orderkey", "class", "age_days", "retention")


@query("ag20_first_blocks", "SELECT event_id, user_id, k FROM (SELECT event_id, user_id, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_id) AS r FROM events) WHERE r = 1")
def _(t, spark):
    e = t("events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"))
    return A.first_of_each(e, ["user_id", "k"], "event_id", blank="k")


@query("ag21_api_cost", "SELECT l_orderkey, l_linenumber, round((greatest(0, l_extendedprice - l_quantity * 10 - l_partkey) * 3.0::DOUBLE + l_suppkey * 15.0::DOUBLE + l_quantity * 10 * 3.75::DOUBLE + l_partkey * 0.3::DOUBLE) / 1000000, 8) AS cost FROM lineitem")
def _(t, spark):
    prices = {"input": 3.0, "output": 15.0, "cache_writes": 3.75, "cache_reads": 0.3}
    c = A.api_cost(F.col("l_extendedprice"), F.col("l_suppkey"), F.col("l_quantity") * 10, F.col("l_partkey"), prices, cached_in_input=True)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(c, 8).alias("cost"))


@query("ag23_counters", "SELECT event_type, count(*) AS attempts, count(*) FILTER (value < 5) AS failures FROM events GROUP BY 1")
def _(t, spark):
    return A.tool_counters(t("events"), ["event_type"], F.col("value") < 5)


@query("ag24_changes", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r = 1 OR before IS DISTINCT FROM event_type")
def _(t, spark):
    return A.changes(t("events"), "user_id", "event_id", ["event_type"]).select("event_id")


@query("st01_bursts", """
WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM b), z AS (SELECT burst, min(ts) AS start, count(*) AS events FROM s GROUP BY 1)
SELECT start, events, user_id AS path, arg_max(event_type, (ts, event_type)) AS change FROM s JOIN z USING (burst) GROUP BY ALL""")
def _(t, spark):
    e = t("events")
    out = J.debounced(e, "user_id", "ts", "event_type", gap="5 minutes").select("start", F.col("events").cast("long").alias("events"), "path", "change")
    # Events without a time are a burst each.
    alone = e.filter("ts IS NULL").groupBy(F.col("user_id").alias("path")).agg(F.max("event_type").alias("change"))
    return out.unionByName(alone.withColumns({"start": F.lit(None).cast(e.schema["ts"].dataType), "events": F.lit(1).cast("long")}))


@query("st02_trailing_usage", "SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS tokens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
def _(t, spark):
    t("events").createOrReplaceTempView("loomline_events")
    return spark.sql("SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS tokens FROM loomline_events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")


@query("st09_queue", """
WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT user_id, event_type, event_id FROM l QUALIFY count(*) OVER (PARTITION BY user_id) >= 4""")
def _(t, spark):
    return J.queue_to_flush(t("events"), "user_id", "event_type", "event_id", 4).select("user_id", "event_type", "event_id")


@query("st10_dwell", """
WITH s AS (SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) - ts AS stay FROM events)
SELECT user_id, event_type, min(ts) AS first_seen FROM s WHERE stay >= INTERVAL 300 SECOND GROUP BY 1, 2""")
def _(t, spark):
    return J.dwelt(t("events"), "user_id", "ts", "event_type", 300_000)


@query("st11_funnel", """
SELECT user_id, a AS accepted, r AS returned, c AS cached, a::DOUBLE / nullif(r, 0) AS accept_rate, a::DOUBLE / nullif(r + c, 0) AS shown_rate
FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'view') AS r, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY 1)""")
def _(t, spark):
    kind = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "view", "returned").when(F.col("event_type") == "click", "cached")
    return J.funnel(t("events").withColumn("kind", kind), "user_id", "kind")


@query("st12_alive", "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND")
def _(t, spark):
    now = F.lit(t("events").agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    return J.alive(t("events"), "user_id", "ts", now, 3600)


@query("st13_rate_limit", """
SELECT event_id, coalesce(ceil(least(600.0::DOUBLE, greatest(0.0::DOUBLE, (600000 - (epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)))) / 1000.0::DOUBLE))), 0)::BIGINT AS wait FROM events""")
def _(t, spark):
    return B.wait_seconds(t("events"), "user_id", "ts", 600).select("event_id", F.col("wait").cast("long").alias("wait"))


@query("xs03_prefixes", "SELECT split_part(c_name, '#', 1) AS prefix, count(*) AS n FROM customer GROUP BY 1")
def _(t, spark):
    from loomline.operators.search import prefix_counts

    return prefix_counts(t("customer"), "c_name", "#")


@query("xs14_levels", "SELECT l.event_type, count(e.event_id) AS n FROM (SELECT unnest(['error', 'view', 'trace']) AS event_type) l LEFT JOIN events e USING (event_type) GROUP BY 1")
def _(t, spark):
    from loomline.operators.search import level_counts

    return level_counts(t("events"), "event_type", ["error", "view", "trace"])


@query("xs16_tags", "SELECT DISTINCT unnest(string_split(p_type, ' ')) AS tag FROM part")
def _(t, spark):
    return A.options(t("part").select(F.explode(F.split("p_type", " ")).alias("tag")), "tag")


# Extensions: what the engine offers beyond the surveyed operators, by Spark's own SQL.


@query("ex01_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t, spark):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("ex02_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def _(t, spark):
    return t("lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("ex03_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def _(t, spark):
    return t("events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
