"""Queries over the driver's tables for scans, filters, joins, sets, sorting and paging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loomline.operators import relational as R
from loomline.plans.registry import query

NOW = datetime(1995, 6, 1)
#: A tri-state verdict: returned lines failed, accepted ones passed, the rest have none.
SQL_PASSED = "CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE END"


def passed():
    return F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)


@query("sc01_runs_newest_first", "SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t, spark):
    return R.with_metrics(t("orders"), t("customer"), "o_custkey", "c_custkey", newest_first="o_orderkey").select("o_orderkey", "o_totalprice", "c_mktsegment")


@query("sc02_find_run", "SELECT * FROM nation WHERE n_nationkey = 7")
def _(t, spark):
    return R.find_one(t("nation"), n_nationkey=7)


@query("sc03_find_task", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 0 AND turn = 1 AND role IS NOT NULL")
def _(t, spark):
    return R.find_one(t("conversations"), conv_id=0, turn=1).select("conv_id", "turn", "role")


@query("sc04_tasks_of_run", "SELECT l_linenumber, l_partkey, p_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)")
def _(t, spark):
    first = t("lineitem").agg(F.min("l_orderkey")).first()[0]
    return R.tasks_of(t("lineitem"), t("part"), "l_orderkey", first, "l_partkey", "p_partkey", "l_linenumber").select("l_linenumber", "l_partkey", "p_name")


@query("sc19_failed_logs", "SELECT l_orderkey, l_linenumber, l_orderkey::VARCHAR || '/' || l_linestatus || '/' || l_linenumber::VARCHAR || '.log' AS path FROM lineitem WHERE l_returnflag = 'R'")
def _(t, spark):
    return R.failed_files(t("lineitem"), passed(), ["l_orderkey", "l_linestatus", "l_linenumber"]).select("l_orderkey", "l_linenumber", "path")


@query("fl01_timeframe", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' - INTERVAL 90 DAY")
def _(t, spark):
    return R.in_timeframe(t("orders"), "o_orderdate", "90d", NOW).select("o_orderkey", "o_orderdate")


@query("fl02_models", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def _(t, spark):
    return R.in_list(t("orders"), F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("fl03_provider_by_json", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('1', '2', '3')")
def _(t, spark):
    return R.in_list(t("events"), F.get_json_object("props", "$.k"), ["1", "2", "3"]).select("event_id")


@query("fl04_incomplete", "SELECT l_orderkey FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')")
def _(t, spark):
    return R.incomplete(t("lineitem").withColumn("passed", passed()), "passed", "l_orderkey")


@query("fl05_old_runs", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' - INTERVAL 30 DAY")
def _(t, spark):
    return R.older_than(t("orders"), "o_orderdate", NOW).select("o_orderkey")


def _catalog(t):
    return t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.split("p_type", " ").alias("tags"))


@query("fl06_catalog", "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name) || ' ' || lower(p_type), 'an') AND list_has_any(string_split(p_type, ' '), [split_part((SELECT min(p_type) FROM part), ' ', 1)])")
def _(t, spark):
    tag = t("part").agg(F.min("p_type")).first()[0].split(" ")[0]
    return R.catalog_filter(_catalog(t), search="AN", tags=[tag]).select("id", "name")


@query("fl07_catalog_installed", "SELECT p_partkey AS id FROM part WHERE (contains(lower(p_name), 'e') OR contains(lower(p_type), 'e')) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(t, spark):
    installed = t("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return R.catalog_filter(_catalog(t), search="e", separately=True, installed=installed, is_installed=False).select("id")


@query("fl08_subscribed", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY 1")
def _(t, spark):
    return R.subscribed(t("events"), "event_type", exclude=["error", "view"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("fl10_status", f"SELECT CASE WHEN passed = FALSE THEN 'failed' WHEN passed THEN 'passed' WHEN l_linestatus = 'O' THEN 'in_progress' ELSE 'not_started' END AS status, count(*) AS n FROM (SELECT *, {SQL_PASSED} AS passed FROM lineitem) GROUP BY 1")
def _(t, spark):
    started = F.when(F.col("l_linestatus") == "O", F.col("l_shipdate"))
    return t("lineitem").select(R.task_status(passed(), started, F.lit(None)).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("fl16_columns", "SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0")
def _(t, spark):
    return R.incomplete(t("customer").withColumn("balance", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))), "balance", "c_custkey")


@query("jn03_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(t, spark):
    ids = t("orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(ids, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("jn04_visible", """
WITH m AS (SELECT conv_id, turn AS seq, role, turn = 2 AS is_summary, CASE WHEN turn IN (1, 3) THEN 's' || (CASE WHEN turn = 1 THEN 2 ELSE 99 END)::VARCHAR END AS parent, 's' || turn::VARCHAR AS id FROM conversations)
SELECT conv_id, seq, role FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS s WHERE s.conv_id = m.conv_id AND s.is_summary AND s.id = m.parent)""")
def _(t, spark):
    c = t("conversations")
    parent = F.when(F.col("turn") == 1, "s2").when(F.col("turn") == 3, "s99")
    m = c.select("conv_id", F.col("turn").alias("seq"), "role", (F.col("turn") == 2).alias("isSummary"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("condenseId"), parent.alias("condenseParent"), F.lit(False).alias("isTruncationMarker"), F.lit(None).cast("string").alias("truncationId"), F.lit(None).cast("string").alias("truncationParent"))
    return R.hidden_by_parent(m).select("conv_id", "seq", "role")


_OLD = "(SELECT doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 3 <> 0)"
_NEW = "(SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0)"


def _snapshots(t):
    """Two states of the same files: some only in one, some changed. What differs is the test data, not what the query reads."""
    d = t("documents")
    old = d.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return old, d.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))


@query("jn07_changed_files", f"SELECT n.path, n.hash FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM {_OLD} o WHERE o.path = n.path AND o.hash = n.hash)")
def _(t, spark):
    old, new = _snapshots(t)
    return R.changed_files(new, old)


@query("jn08_deleted_files", f"SELECT o.path FROM {_OLD} o WHERE o.path NOT IN (SELECT path FROM {_NEW})")
def _(t, spark):
    old, new = _snapshots(t)
    return R.missing_files(old, new).select("path")


@query("jn09_manifest", f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'delete' WHEN o.hash IS NOT DISTINCT FROM n.hash THEN 'skip' ELSE 'upsert' END AS action FROM {_OLD} o FULL JOIN {_NEW} n ON o.path = n.path")
def _(t, spark):
    return R.manifest_diff(*_snapshots(t))


@query("jn10_hidden", "SELECT p_partkey AS id, p_brand AS type FROM part WHERE NOT (p_brand = (SELECT min(p_brand) FROM part) AND p_size > 25)")
def _(t, spark):
    brand = t("part").agg(F.min("p_brand")).first()[0]
    hidden = t("part").filter("p_size > 25").select(F.col("p_partkey").alias("id"))
    return R.without_hidden(_catalog(t).select("id", "type"), hidden, brand)


@query("jn11_as_of_order", """
SELECT event_id, coalesce(o.o_orderkey, -1) AS o_orderkey, o.o_orderdate AS o_orderkey_at
FROM (SELECT event_id, user_id, ts - INTERVAL 29 YEAR AS ts FROM events) e
ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def _(t, spark):
    events = t("events").select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 29 YEARS")).alias("ts"))
    orders = t("orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey")
    return R.as_of(events, orders, "user_id", "ts", "o_orderdate", "o_orderkey").select("event_id", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"), "o_orderkey_at")


@query("jn12_longest_prefix", """
WITH p AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS prefix FROM part UNION SELECT DISTINCT p_type FROM part WHERE p_size < 10 UNION SELECT '*')
SELECT p_partkey, arg_max(prefix, CASE prefix WHEN '*' THEN 1 ELSE length(prefix) END) AS matched, max(CASE prefix WHEN '*' THEN 1 ELSE length(prefix) END)::BIGINT AS matched_length
FROM part JOIN p ON prefix = '*' OR starts_with(lower(p_type), lower(prefix)) GROUP BY 1""")
def _(t, spark):
    part = t("part")
    prefixes = part.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("prefix")).union(part.filter("p_size < 10").select("p_type")).union(spark.range(1).select(F.lit("*"))).distinct()
    return R.longest_prefix(part.select("p_partkey", "p_type"), prefixes, "p_type").select("p_partkey", "matched", F.col("matched_length").cast("long").alias("matched_length"))


@query("jn18_merged_ranges", """
WITH r AS (SELECT l_partkey AS k, l_linenumber * 10 + l_quantity::BIGINT AS s, l_linenumber * 10 + l_quantity::BIGINT + l_suppkey % 9 AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r),
i AS (SELECT *, sum(CASE WHEN reached IS NULL OR s > reached THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT k, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY k, island""")
def _(t, spark):
    start = F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long")
    return R.merged_ranges(t("lineitem").select(F.col("l_partkey").alias("k"), start.alias("s"), (start + F.col("l_suppkey") % 9).alias("e")), ["k"], "s", "e")


@query("jn19_intersections", """
WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity::BIGINT AS start, l_quantity::BIGINT + 10 AS "end" FROM lineitem)
SELECT a.k, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM r a JOIN r b ON a.k = b.k AND a.start <= b."end" AND b.start <= a."end" WHERE a.n % 2 = 1 AND b.n % 2 = 0""")
def _(t, spark):
    r = t("lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity").cast("long") + 10).alias("end"))
    return R.range_intersections(r.filter("l_linenumber % 2 = 1"), r.filter("l_linenumber % 2 = 0"), "k")


@query("jn20_enriched", "SELECT o_orderkey, coalesce(CASE WHEN o_totalprice > 100000 THEN 'large' END, c_mktsegment) AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t, spark):
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_totalprice") > 100000, "large").alias("segment"))
    return R.enriched(o, t("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")), "k", ["segment"]).select("o_orderkey", "segment")


@query("so01_concat", "SELECT s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT c_name, c_nationkey FROM customer")
def _(t, spark):
    return R.concatenated(t("supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), t("customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))


@query("so02_difference", "SELECT p_partkey AS path FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def _(t, spark):
    return R.missing_files(t("part").select(F.col("p_partkey").alias("path")), t("lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("path")))


@query("so03_overlap", """
WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)
SELECT p_partkey, len(list_intersect(a, b))::BIGINT AS both, len(list_distinct(list_concat(a, b)))::BIGINT AS either FROM w""")
def _(t, spark):
    both, either = R.symbol_overlap(F.split("p_name", " "), F.split(F.lower("p_type"), " "))
    return t("part").select("p_partkey", both.cast("long").alias("both"), either.cast("long").alias("either"))


_RUNS = "(SELECT l_suppkey AS id, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS passed, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS failed FROM lineitem GROUP BY 1)"


def _runs(t):
    return t("lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "A").alias("passed"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))


@query("sl01_sorted_runs", f"SELECT id, passed, failed, coalesce(passed * 100.0::DOUBLE / nullif(passed + failed, 0), 0) AS sort_key FROM {_RUNS}")
def _(t, spark):
    return R.sorted_runs(_runs(t), "percent")


@query("sl02_history_page", """
WITH f AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'), n AS (SELECT count(*) AS total FROM f)
SELECT o_orderkey, o_totalprice, 2::INT AS page_index, ceil(total / 10.0)::INT AS page_count, total FROM f, n ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20""")
def _(t, spark):
    return R.history_page(t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), [F.desc("o_totalprice"), F.asc("o_orderkey")], page=2, where=F.col("o_orderstatus") == "O").drop("o_orderstatus")


@query("sl03_leaderboard", f"SELECT id, passed, failed, floor(passed * 100.0::DOUBLE / nullif(passed + failed, 0) + 0.5) AS score FROM {_RUNS} WHERE passed + failed > 3 AND id > 0")
def _(t, spark):
    return R.leaderboard(_runs(t), F.col("passed") + F.col("failed") > 3, F.col("id") > 0)


@query("sl04_axis", "SELECT (floor(min(l_quantity) / 5) * 5)::BIGINT AS low, (ceil(max(l_quantity) / 5) * 5)::BIGINT AS high FROM lineitem WHERE l_discount < 0.05")
def _(t, spark):
    return R.axis_domain(t("lineitem").filter("l_discount < 0.05"), "l_quantity")


@query("sl06_preferred", "SELECT n_name, CASE n_name WHEN (SELECT max(n_name) FROM nation) THEN 1 WHEN (SELECT min(n_name) FROM nation) THEN 2 ELSE 0 END::BIGINT AS preferred FROM nation")
def _(t, spark):
    low, high = t("nation").agg(F.min("n_name"), F.max("n_name")).first()
    return R.preferred_first(t("nation").select("n_name"), [high, low], "n_name").select("n_name", F.coalesce(F.col("preferred").cast("long"), F.lit(0)).alias("preferred"))


@query("sl07_bounded_queue", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(t, spark):
    return R.newest(t("events").select("event_id", "ts"), "ts", 100, "event_id")


@query("xs07_last_checkpoint", """
SELECT e.event_id, coalesce(c.event_id, -1) AS checkpoint, c.ts AS checkpoint_at FROM events e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def _(t, spark):
    e = t("events")
    marks = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("checkpoint"))
    return R.as_of(e.select("event_id", "user_id", "ts"), marks, "user_id", "ts", "at", "checkpoint").select("event_id", F.coalesce("checkpoint", F.lit(-1)).alias("checkpoint"), "checkpoint_at")
