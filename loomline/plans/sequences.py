"""Queries over the driver's tables for ordered rows and budgets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.operators import budgets as B
from loomline.operators import sequences as S
from loomline.plans.registry import query

_LINES = "(SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_W = "[\\s\\x{00A0}\\x{FEFF}]"


def _lines(t):
    return S.lines_of(t("documents"), "doc_id", "text")


def _texts(t):
    """Each text's lines as an array."""
    return t("documents").select("doc_id", F.split("text", "\n").alias("l"))


@query("wn01_time_to_next", """
WITH g AS (SELECT event_id, user_id, greatest(0, epoch_us(lead(ts) OVER w) // 1000 - epoch_us(ts) // 1000) AS gap, lead(ts) OVER w IS NOT NULL AS more FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT event_id, user_id, CASE WHEN more THEN gap END AS gap FROM g)
SELECT event_id, coalesce(gap, -1) AS gap, round(gap::DOUBLE / nullif(max(gap) OVER (PARTITION BY user_id), 0), 8) AS share FROM h""")
def _(t, spark):
    out = S.time_to_next(t("events"), "user_id", "ts", "ts")
    return out.select("event_id", F.coalesce("gap", F.lit(-1)).alias("gap"), F.round("share", 8).alias("share"))


@query("wn02_debounce_delay", """
SELECT event_id, coalesce(CASE WHEN count(*) OVER w = 10 THEN least(1000, greatest(150, floor(avg(v) OVER w + 0.5))) END, -1)::BIGINT AS delay
FROM (SELECT *, floor(value * 10)::BIGINT AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def _(t, spark):
    e = t("events").withColumn("v", F.floor(F.col("value") * 10))
    return S.debounce_delay(e, "user_id", "event_id", "v").select("event_id", F.coalesce("delay", F.lit(-1)).alias("delay"))


@query("wn03_repetition", """
WITH n AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS opens FROM events WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) % 3 = 0 AS blocked FROM i UNION ALL SELECT event_id, FALSE FROM events WHERE event_type = 'view'""")
def _(t, spark):
    return S.repetition_limit(t("events"), "user_id", "event_id", F.col("event_type"), limit=2, exempt=F.col("event_type") == "view").select("event_id", "blocked")


@query("wn04_logged_once", """
SELECT event_id FROM (SELECT event_id, json_extract_string(props, '$.k') AS k, lag(json_extract_string(props, '$.k')) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)) WHERE r = 1 OR k IS DISTINCT FROM b""")
def _(t, spark):
    e = t("events").withColumn("k", F.get_json_object("props", "$.k"))
    return S.logged_once(e, ["user_id", "event_type"], "event_id", "k").select("event_id")


_WORDS_AS_LINES = "(SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line, len(l) AS n FROM (SELECT doc_id, string_split(replace(text, ' ', chr(10)), chr(10)) AS l FROM documents))"


def _words_as_lines(t):
    """Words as lines: the driver's texts repeat words, not lines."""
    return t("documents").select("doc_id", F.split(F.replace(F.col("text"), F.lit(" "), F.lit("\n")), "\n").alias("l"))


@query("wn07_run_length", f"""
WITH x AS (SELECT doc_id, pos, CASE WHEN pos = n - 1 THEN line ELSE line || chr(10) END AS t FROM {_WORDS_AS_LINES}),
y AS (SELECT * FROM x WHERE t <> ''),
n AS (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM t THEN 1 ELSE 0 END AS opens FROM y),
i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM n),
r AS (SELECT doc_id, island, min(pos) AS pos, any_value(t) AS t, count(*) - 1 AS more FROM i GROUP BY 1, 2),
e AS (SELECT *, '<previous line repeated ' || more || ' additional times>' || chr(10) AS note, max(pos) OVER (PARTITION BY doc_id) = pos AS final FROM r)
SELECT doc_id, sha256(string_agg(CASE WHEN more > 0 AND length(note) < length(t) * (more + CASE WHEN final THEN 0 ELSE 1 END) THEN t || note ELSE repeat(t, (more + 1)::INT) END, '' ORDER BY pos)) AS encoded FROM e GROUP BY 1""")
def _(t, spark):
    some = t("documents").filter("text <> ''")
    encoded = S.run_length_encoded(F.replace("text", F.lit(" "), F.lit("\n")))
    return some.select("doc_id", F.sha2(encoded, 256).alias("encoded"))


@query("wn08_stop_at_repeats", f"""
WITH n AS (SELECT doc_id, pos, line, CASE WHEN lag(line) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM line THEN 1 ELSE 0 END AS opens FROM {_WORDS_AS_LINES}),
i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) AS run FROM i),
c AS (SELECT *, coalesce(min(CASE WHEN run >= 3 THEN pos END) OVER (PARTITION BY doc_id), 1000000000) AS cut FROM r)
SELECT doc_id, count(*) AS n, max(pos)::BIGINT AS last FROM c WHERE pos < cut AND run = 1 GROUP BY 1""")
def _(t, spark):
    kept = S.stop_at_repeats(_words_as_lines(t), "l")
    return kept.select("doc_id", F.size("kept").cast("long").alias("n"), F.element_at("kept", -1)["pos"].cast("long").alias("last"))


@query("wn09_stop_at_blank", f"""
WITH c AS (SELECT doc_id, pos, line, coalesce(min(CASE WHEN pos > 0 AND regexp_replace(line, '\\s', '', 'g') = '' THEN pos END) OVER (PARTITION BY doc_id), 1000000000) AS cut FROM {_LINES})
SELECT doc_id, count(*) AS n FROM c WHERE pos < cut GROUP BY 1""")
def _(t, spark):
    return _texts(t).select("doc_id", F.size(S.stop_at_blank("l")).cast("long").alias("n"))


@query("wn14_joined_lines", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t, spark):
    return _texts(t).select("doc_id", F.sha2(S.joined_lines(F.col("l")), 256).alias("digest"))


@query("wn22_numbered", "SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1)::BIGINT AS index FROM lineitem")
def _(t, spark):
    return S.numbered(t("lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey").select("l_orderkey", "l_linenumber", F.col("index").cast("long").alias("index"))


@query("wn22_numbered_all", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS index FROM orders")
def _(t, spark):
    return S.numbered(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("index").cast("long").alias("index"))


@query("wn24_rewound", """
WITH m AS (SELECT conv_id, turn AS seq, turn * 10 AS ts, role, 25 AS cutoff FROM conversations),
a AS (SELECT *, max(CASE WHEN ts = cutoff THEN 1 ELSE 0 END) OVER w AS exact, max(CASE WHEN ts < cutoff THEN 1 ELSE 0 END) OVER w AS earlier, min(CASE WHEN role = 'user' AND ts >= cutoff THEN ts END) OVER w AS u FROM m WINDOW w AS (PARTITION BY conv_id))
SELECT conv_id, seq, ts, role FROM a WHERE ts < CASE WHEN exact = 0 AND earlier = 1 AND u IS NOT NULL THEN u ELSE cutoff END""")
def _(t, spark):
    m = t("conversations").select("conv_id", F.col("turn").alias("seq"), (F.col("turn") * 10).alias("ts"), "role")
    return S.rewound(m, "conv_id", m.select("conv_id").distinct().withColumn("cutoff", F.lit(25)))


@query("bg01_truncated", """
WITH m AS (SELECT conv_id, turn, role, row_number() OVER w AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT *, greatest(0, floor((n - 1) * 0.5)::INT - floor((n - 1) * 0.5)::INT % 2) AS k FROM m),
f AS (SELECT conv_id, any_value(k) AS k, min(CASE WHEN r = k + 2 THEN turn END) AS first FROM k GROUP BY 1)
SELECT conv_id, turn::DOUBLE AS position, CASE WHEN r BETWEEN 2 AND k + 1 THEN 't' END AS parent FROM k UNION ALL SELECT conv_id, first - 0.5, NULL FROM f WHERE k > 0""")
def _(t, spark):
    c = t("conversations")
    m = c.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("ts"), "role", F.col("text").alias("content"), F.lit(None).cast("boolean").alias("isTruncationMarker"), F.lit(None).cast("string").alias("truncationId"), F.lit(None).cast("string").alias("truncationParent"))
    return B.truncated(m, 0.5, "t").select("conv_id", "position", F.col("truncationParent").alias("parent"))


@query("bg02_must_manage", """
SELECT o_orderkey, (o_totalprice + o_custkey) > 200000 * 0.9 - 8192 OR (o_orderstatus = 'O' AND 100.0::DOUBLE * (o_totalprice + o_custkey) / 200000 >= CASE WHEN o_custkey % 120 BETWEEN 5 AND 100 THEN o_custkey % 120 ELSE 75 END) AS manage FROM orders""")
def _(t, spark):
    out = B.must_manage(F.col("o_totalprice"), F.col("o_custkey"), F.lit(200000), F.lit(8192), F.col("o_orderstatus") == "O", F.lit(75), F.col("o_custkey") % 120)
    return t("orders").select("o_orderkey", out.alias("manage"))


@query("bg04_newest_within", """
WITH m AS (SELECT conv_id, turn, role, ceil(length(text) / 4.0)::BIGINT AS n, role = 'system' OR turn = max(turn) OVER (PARTITION BY conv_id) AS keep FROM conversations),
s AS (SELECT *, sum(CASE WHEN keep THEN n ELSE 0 END) OVER (PARTITION BY conv_id) + sum(CASE WHEN keep THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS spent FROM m)
SELECT conv_id, turn FROM s WHERE keep OR spent <= 400""")
def _(t, spark):
    c = t("conversations")
    last = F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))
    return B.newest_within(c, "conv_id", "turn", B.estimated_tokens(F.col("text")), 400, always=(F.col("role") == "system") | last).select("conv_id", "turn")


@query("bg05_pruned_lines", f"""
WITH s AS (SELECT doc_id, pos, sum(ceil(length(line) / 4.0)::BIGINT) OVER w + count(*) OVER w - 1 AS spent FROM {_LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING))
SELECT doc_id, count(*) AS n, min(pos)::BIGINT AS first FROM s WHERE spent <= 200 GROUP BY 1""")
def _(t, spark):
    n = _texts(t).select("doc_id", F.size("l").alias("of"), F.size(B.pruned_lines("l", 200)).cast("long").alias("n")).filter("n > 0")
    return n.select("doc_id", "n", (F.col("of") - F.col("n")).cast("long").alias("first"))


@query("bg07_greedy_fill", """
WITH RECURSIVE r AS (SELECT l_orderkey AS k, l_quantity::BIGINT AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
f AS (SELECT k, i, CASE WHEN n <= 60 THEN 60 - n ELSE 60 END AS room, n <= 60 AS taken FROM r WHERE i = 1
  UNION ALL SELECT r.k, r.i, CASE WHEN r.n <= f.room THEN f.room - r.n ELSE f.room END, r.n <= f.room FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1)
SELECT k AS l_orderkey, (i - 1)::BIGINT AS place FROM f WHERE taken""")
def _(t, spark):
    rows = S.numbered(t("lineitem"), ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_orderkey").select("l_orderkey", F.col("index").cast("long").alias("place"), F.col("l_quantity").cast("long").alias("n"))
    return B.greedy_fill(rows, "l_orderkey", ["place"], "n", 60).select("l_orderkey", "place")


@query("bg09_opened_files", """
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) - 1 AS i, ln(greatest(length(text), 10)::DOUBLE) AS s FROM documents),
c AS (SELECT *, min(s) OVER (PARTITION BY source) AS lo, max(s) OVER (PARTITION BY source) AS hi FROM r WHERE i < 10),
o AS (SELECT source, doc_id, i, 0.6::DOUBLE * pow(1.15::DOUBLE, -i) + 0.4::DOUBLE * CASE WHEN lo = hi THEN 0.5 ELSE 1 - (s - lo) / (hi - lo) END AS score FROM c)
SELECT source, doc_id, round(score, 6) AS score FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, i) <= 5""")
def _(t, spark):
    d = t("documents").withColumn("order", -F.col("doc_id"))
    return B.opened_file_scores(d, "source", "order", "text").select("source", "doc_id", F.round("score", 6).alias("score"))


@query("bg11_next_fit", """
WITH RECURSIVE r AS (SELECT source, doc_id, ceil(length(text) / 4.0)::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE ceil(length(text) / 4.0) <= 2000),
f AS (SELECT source, doc_id, i, n AS held, 0::BIGINT AS batch FROM r WHERE i = 1
  UNION ALL SELECT r.source, r.doc_id, r.i, CASE WHEN f.held + r.n > 4000 THEN r.n ELSE f.held + r.n END, f.batch + CASE WHEN f.held + r.n > 4000 THEN 1 ELSE 0 END FROM f JOIN r ON r.source = f.source AND r.i = f.i + 1)
SELECT doc_id, batch FROM f""")
def _(t, spark):
    sizes = t("documents").select("source", "doc_id", B.estimated_tokens(F.col("text")).alias("n"))
    return B.next_fit(sizes, "source", "doc_id", F.col("n"), 4000, 2000).select("doc_id", "batch")


@query("bg12_batches", "SELECT doc_id, ((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 60)::BIGINT AS batch FROM documents")
def _(t, spark):
    return B.batches_of(t("documents"), "lang", "doc_id").select("doc_id", F.col("batch").cast("long").alias("batch"))


@query("bg13_truncated_output", """
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, sha256(CASE WHEN length(text) > 3000 THEN substring(text, 1, 600) || chr(10) || '[...' || (length(text) - 3000) || ' characters omitted...]' || chr(10) || right(text, 2400)
  WHEN len(l) > 10 THEN array_to_string(l[1:2], chr(10)) || chr(10) || chr(10) || '[...' || (len(l) - 10) || ' lines omitted...]' || chr(10) || chr(10) || array_to_string(l[len(l) - 7:], chr(10)) ELSE text END) AS digest FROM s""")
def _(t, spark):
    return t("documents").select("doc_id", F.sha2(B.truncated_output(F.col("text"), 10, 3000), 256).alias("digest"))


@query("bg14_truncated_line", f"SELECT doc_id, max(length(CASE WHEN length(line) > 500 THEN substring(line, 1, 500) || ' [truncated...]' ELSE line END))::BIGINT AS longest FROM {_LINES} GROUP BY 1")
def _(t, spark):
    return _lines(t).groupBy("doc_id").agg(F.max(F.length(B.truncated_line(F.col("line")))).cast("long").alias("longest"))


@query("xs04_merged_logs", """
WITH o AS (SELECT turn AS ts, conv_id, text FROM conversations WHERE conv_id = 0), n AS (SELECT turn + 1 AS ts, conv_id, text FROM conversations WHERE conv_id = 1)
SELECT ts, conv_id, text FROM n UNION ALL SELECT ts, conv_id, text FROM o WHERE ts NOT IN (SELECT ts FROM n)""")
def _(t, spark):
    c = t("conversations")
    pick = lambda k, d: c.filter(F.col("conv_id") == k).select((F.col("turn") + d).alias("ts"), "conv_id", "text")
    return S.merged_logs(pick(0, 0), pick(1, 1))


@query("xs04_all_merged_logs", """
WITH o AS (SELECT conv_id // 2 AS log, turn AS ts, conv_id, text FROM conversations WHERE conv_id % 2 = 0), n AS (SELECT conv_id // 2 AS log, turn + 1 AS ts, conv_id, text FROM conversations WHERE conv_id % 2 = 1)
SELECT log, ts, conv_id, text FROM n UNION ALL SELECT log, ts, conv_id, text FROM o WHERE (log, ts) NOT IN (SELECT (log, ts) FROM n)""")
def _(t, spark):
    """Each odd conversation is merged into the one before it, over the whole table."""
    c = t("conversations").withColumn("log", F.expr("conv_id div 2"))
    pick = lambda r: c.filter(F.col("conv_id") % 2 == r).select("log", (F.col("turn") + r).alias("ts"), "conv_id", "text")
    return S.merged_logs(pick(0), pick(1), by=["log"])


@query("xs05_recent", """
WITH f AS (SELECT o_orderkey, o_orderpriority, o_orderdate, o_orderdate >= TIMESTAMP '1998-07-01' - INTERVAL 30 DAY AS fresh FROM orders),
n AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY o_orderpriority) AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM f)
SELECT o_orderkey FROM n WHERE CASE WHEN k >= 40 THEN fresh ELSE r <= 40 END""")
def _(t, spark):
    now = F.lit(datetime(1998, 7, 1)).cast("timestamp_ntz")
    return S.recent(t("orders"), "o_orderpriority", "o_orderdate", now, 40, 30, "o_orderkey").select("o_orderkey")


@query("xs08_scd", """
SELECT event_id, CASE WHEN lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL THEN 'active' ELSE 'stale' END AS state,
  last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS viewed FROM events""")
def _(t, spark):
    e = t("events").withColumn("viewed", F.when(F.col("event_type") == "view", F.col("ts")))
    return S.history_scd(e, ["user_id"], "event_id", ["viewed"]).select("event_id", "state", "viewed")


@query("xs09_top_of_recent", """
WITH v AS (SELECT * FROM events WHERE user_id <> 0), l AS (SELECT user_id, max(ts) AS m FROM v GROUP BY 1 ORDER BY m DESC, user_id LIMIT 3)
SELECT event_id, user_id FROM v WHERE user_id IN (SELECT user_id FROM l) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 3""")
def _(t, spark):
    return S.top_of_recent(t("events"), "user_id", "ts", current=0).select("event_id", "user_id")


@query("xs13_last_users", "SELECT conv_id, turn FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def _(t, spark):
    return S.last_users(t("conversations"), "conv_id", "turn").select("conv_id", "turn")


_INDENTED = "(SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query("xs19_dedented", f"""
WITH i AS (SELECT doc_id, pos, repeat(' ', (2 + doc_id % 3 + pos % 2)::INT) || raw AS line FROM {_INDENTED}),
n AS (SELECT *, min(CASE WHEN regexp_replace(line, '\\s', '', 'g') <> '' THEN length(regexp_extract(line, '^([ \\t]*)', 1)) END) OVER (PARTITION BY doc_id) AS k FROM i)
SELECT doc_id, sha256(string_agg(substring(line, (coalesce(k, 0) + 1)::INT), chr(10) ORDER BY pos)) AS digest FROM n GROUP BY 1""")
def _(t, spark):
    indented = F.transform("l", lambda x, i: F.concat(F.repeat(F.lit(" "), (2 + F.col("doc_id") % 3 + i % 2).cast("int")), x))
    return _texts(t).withColumn("l", indented).select("doc_id", F.sha2(S.joined_lines(S.dedented("l")), 256).alias("digest"))
