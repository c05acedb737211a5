"""Queries over the driver's tables for message logs, joins on them, metrics and line streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import aggregates as A
from loomline.operators import budgets as B
from loomline.operators import relational as R
from loomline.operators import search as X
from loomline.operators import sequences as S
from loomline.operators import vectors as V
from loomline.plans.registry import query
from loomline.streaming import jobs as J

# Conversations as a log with summaries and truncation markers: every fifth turn is a summary, every seventh a marker, and parents point to them or nowhere.
_LOG = """(SELECT conv_id, turn AS seq, role, text, turn % 5 = 3 AS is_summary, CASE WHEN turn % 5 = 3 THEN 's' || turn END AS condense_id, turn % 7 = 6 AS is_marker, CASE WHEN turn % 7 = 6 THEN 'm' || turn END AS truncation_id,
  CASE WHEN turn % 4 = 0 THEN 's' || (turn + 3) WHEN turn % 4 = 1 THEN 's99' END AS condense_parent, CASE WHEN turn % 3 = 0 THEN 'm' || (turn + 3) END AS truncation_parent FROM conversations)"""


def _log(t):
    turn, kept = F.col("turn"), F.when
    name = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    return t("conversations").select(
        "conv_id", turn.alias("seq"), "role", "text", (turn % 5 == 3).alias("isSummary"), kept(turn % 5 == 3, name("s", turn)).alias("condenseId"), (turn % 7 == 6).alias("isTruncationMarker"), kept(turn % 7 == 6, name("m", turn)).alias("truncationId"),
        kept(turn % 4 == 0, name("s", turn + 3)).when(turn % 4 == 1, "s99").alias("condenseParent"), kept(turn % 3 == 0, name("m", turn + 3)).alias("truncationParent"),
    )


@query("jn05_cleared", f"""
WITH m AS {_LOG}
SELECT conv_id, seq, CASE WHEN EXISTS (SELECT 1 FROM m s WHERE s.conv_id = m.conv_id AND s.condense_id = m.condense_parent) THEN condense_parent END AS condense_parent,
  CASE WHEN EXISTS (SELECT 1 FROM m s WHERE s.conv_id = m.conv_id AND s.truncation_id = m.truncation_parent) THEN truncation_parent END AS truncation_parent FROM m""")
def _(t, spark):
    return R.cleared_orphans(_log(t)).select("conv_id", "seq", F.col("condenseParent").alias("condense_parent"), F.col("truncationParent").alias("truncation_parent"))


@query("jn06_released", f"""
WITH m AS {_LOG}
SELECT conv_id, seq, CASE WHEN EXISTS (SELECT 1 FROM m s WHERE s.conv_id = m.conv_id AND s.condense_id = m.condense_parent AND s.role <> 'assistant') THEN NULL ELSE condense_parent END AS condense_parent
FROM m WHERE NOT (is_summary AND role <> 'assistant')""")
def _(t, spark):
    return R.released(_log(t), F.col("role") == "assistant").select("conv_id", "seq", F.col("condenseParent").alias("condense_parent"))


_ALLOWED = "(SELECT DISTINCT split_part(p_type, ' ', 1) AS prefix FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT p_type FROM part WHERE p_size = 1)"
_DENIED = "(SELECT DISTINCT split_part(p_type, ' ', 1) AS prefix FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) UNION SELECT DISTINCT p_type FROM part WHERE p_size = 2)"
_BEST = "(SELECT p_partkey, max(length(prefix)) AS n FROM part JOIN {} x ON starts_with(lower(p_type), lower(prefix)) GROUP BY 1)"


@query("jn13_approval", f"""
SELECT p_partkey, CASE WHEN a.n IS NOT NULL AND (d.n IS NULL OR a.n > d.n) THEN 'approve' WHEN d.n IS NOT NULL THEN 'deny' ELSE 'ask' END AS decision
FROM part LEFT JOIN {_BEST.format(_ALLOWED)} a USING (p_partkey) LEFT JOIN {_BEST.format(_DENIED)} d USING (p_partkey)""")
def _(t, spark):
    part = t("part")
    first, low = F.split_part("p_type", F.lit(" "), F.lit(1)).alias("prefix"), part.agg(F.min("p_brand")).first()[0]
    allowed = part.filter("p_size % 2 = 0").select(first).union(part.filter("p_size = 1").select("p_type"))
    denied = part.filter(F.col("p_brand") == low).select(first).union(part.filter("p_size = 2").select("p_type"))
    return R.approval(part.select("p_partkey", "p_type"), allowed, denied, "p_type").select("p_partkey", "decision")


@query("jn14_suggestion", """
WITH r AS (SELECT p_partkey AS req, p_brand AS suffix, left(p_type, (3 + p_partkey % 12)::INT) AS prefix FROM part),
h AS (SELECT p_partkey AS seq, p_brand AS suffix, left(p_type, (2 + p_size % 9)::INT) AS prefix, substring(p_type, (3 + p_size % 9)::INT) AS text FROM part),
j AS (SELECT req, seq, CASE WHEN r.prefix = h.prefix THEN 'exact' WHEN text <> '' AND starts_with(r.prefix, h.prefix) AND starts_with(text, substring(r.prefix, length(h.prefix) + 1)) THEN 'typing'
    WHEN text <> '' AND starts_with(h.prefix, r.prefix) THEN 'deletion' END AS kind, substring(h.prefix || text, length(r.prefix) + 1) AS suggestion FROM r JOIN h USING (suffix))
SELECT req, kind, suggestion FROM j WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY req ORDER BY seq DESC) = 1""")
def _(t, spark):
    p = t("part")
    requests = p.select(F.col("p_partkey").alias("req"), F.col("p_brand").alias("suffix"), F.left("p_type", (3 + F.col("p_partkey") % 12).cast("int")).alias("prefix"))
    cut = (2 + F.col("p_size") % 9).cast("int")
    history = p.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("suffix"), F.left("p_type", cut).alias("prefix"), F.substring("p_type", cut + 1, F.length("p_type")).alias("text"))
    return R.suggestion(requests, history)


@query("jn15_cached_prefix", """
WITH c AS (SELECT left(p_type, (4 + p_size % 6)::INT) AS prefix, min(p_type) AS value FROM part WHERE p_size < 20 GROUP BY 1),
b AS (SELECT p_partkey, p_type, max(length(prefix)) AS n FROM part JOIN c ON starts_with(lower(p_type), lower(prefix)) GROUP BY 1, 2)
SELECT p_partkey, value FROM b JOIN c ON lower(prefix) = lower(left(p_type, n)) WHERE starts_with(value, p_type)""")
def _(t, spark):
    p = t("part")
    cache = p.filter("p_size < 20").groupBy(F.left("p_type", (4 + F.col("p_size") % 6).cast("int")).alias("prefix")).agg(F.min("p_type").alias("value"))
    hit = R.longest_prefix(p.select("p_partkey", "p_type"), cache, "p_type").join(cache, F.col("matched") == F.col("prefix"))
    return hit.filter(F.startswith("value", F.col("p_type"))).select("p_partkey", "value")


# Order lines as tool calls: even lines use a tool, odd ones answer one; some answers have no use, some uses no answer.
_USES = "(SELECT l_orderkey AS conv_id, l_partkey % 5 AS id, l_linenumber AS seq FROM lineitem WHERE l_linenumber % 2 = 0)"
_RESULTS = "(SELECT l_orderkey AS conv_id, l_partkey % 5 AS id, l_linenumber AS seq FROM lineitem WHERE l_linenumber % 2 = 1)"


def _calls(t, odd):
    line = t("lineitem").filter(F.col("l_linenumber") % 2 == odd)
    return line.select(F.col("l_orderkey").alias("conv_id"), (F.col("l_partkey") % 5).alias("tool_use_id"), F.col("l_linenumber").alias("seq"))


@query("jn16_tool_results", f"""
WITH u AS (SELECT DISTINCT conv_id, id FROM {_USES}), r AS (SELECT conv_id, id, count(*) AS n FROM {_RESULTS} GROUP BY 1, 2)
SELECT coalesce(u.conv_id, r.conv_id) AS conv_id, coalesce(u.id, r.id) AS id, CASE WHEN n IS NULL THEN 'missing' WHEN u.id IS NULL THEN 'invalid' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS state
FROM u FULL JOIN r ON u.conv_id = r.conv_id AND u.id = r.id""")
def _(t, spark):
    return R.tool_result_check(_calls(t, 0), _calls(t, 1))


@query("jn17_tool_use_before", f"""
SELECT r.conv_id, r.seq, r.id, coalesce(max(u.seq), -1) AS use_seq FROM (SELECT DISTINCT * FROM {_RESULTS}) r LEFT JOIN {_USES} u ON u.conv_id = r.conv_id AND u.id = r.id AND u.seq BETWEEN r.seq - 3 AND r.seq - 1 GROUP BY 1, 2, 3""")
def _(t, spark):
    return R.tool_use_before(_calls(t, 1), _calls(t, 0)).select("conv_id", "seq", F.col("tool_use_id").alias("id"), F.coalesce("use_seq", F.lit(-1)).alias("use_seq"))


# Events as a log of requests and condensing: purchases start requests with token counts, refunds give bad JSON, the rest is talk.
_MESSAGES = """(SELECT user_id AS task_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'ask' ELSE 'say' END AS type, CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'resume_task' END AS ask,
  CASE WHEN event_type <> 'view' THEN CASE WHEN event_id % 4 = 3 THEN 'text' ELSE 'api_req_started' END END AS say, event_id % 6 AS tin, event_id % 10 AS tout, event_id % 8 = 1 AS bad, event_id % 5 = 0 AS cached FROM events)"""


def _messages(t):
    e = t("events")
    i = F.col("event_id")
    say = F.when(F.col("event_type") != "view", F.when(i % 4 == 3, "text").otherwise("api_req_started"))
    body = F.when(i % 8 == 1, "{bad").otherwise(F.to_json(F.struct((i % 6).alias("tokensIn"), (i % 10).alias("tokensOut"), F.when(i % 5 == 0, i % 7).alias("cacheReads"))))
    condense = F.lit(None).cast("struct<newContextTokens:long,cost:double>")
    return e.select(F.col("user_id").alias("task_id"), i.alias("seq"), "ts", F.when(F.col("event_type") == "view", "ask").otherwise("say").alias("type"), F.when((F.col("event_type") == "view") & (i % 3 == 0), "resume_task").alias("ask"), say.alias("say"), body.alias("text"), condense.alias("contextCondense"))


_USAGE = f"""SELECT task_id, coalesce(sum(CASE WHEN say = 'api_req_started' AND NOT bad THEN tin END), 0)::BIGINT AS tokens_in, coalesce(sum(CASE WHEN say = 'api_req_started' AND NOT bad THEN tout END), 0)::BIGINT AS tokens_out,
  coalesce(sum(CASE WHEN say = 'api_req_started' AND NOT bad AND cached THEN seq % 7 END), -1)::BIGINT AS cache_reads,
  coalesce(arg_max(CASE WHEN say = 'api_req_started' AND NOT bad AND tin + tout > 0 THEN tin + tout END, CASE WHEN say = 'api_req_started' AND NOT bad AND tin + tout > 0 THEN seq END), 0)::BIGINT AS context_tokens"""


@query("ag06_token_usage", f"{_USAGE} FROM {_MESSAGES} GROUP BY 1")
def _(t, spark):
    return A.token_usage(_messages(t)).select("task_id", "tokens_in", "tokens_out", F.coalesce("cache_reads", F.lit(-1)).alias("cache_reads"), "context_tokens")


@query("ag22_task_summary", f"{_USAGE}, arg_max(ts, seq) FILTER (ask IS DISTINCT FROM 'resume_task') AS ts FROM {_MESSAGES} GROUP BY 1 HAVING count(*) FILTER (ask IS DISTINCT FROM 'resume_task') > 0")
def _(t, spark):
    return A.task_summary(_messages(t)).select("task_id", "tokens_in", "tokens_out", F.coalesce("cache_reads", F.lit(-1)).alias("cache_reads"), "context_tokens", "ts").filter("ts is not null")


@query("ag04_greatest_usage", "SELECT l_suppkey, l_linestatus AS tool, max(l_quantity::BIGINT) AS attempts, max(l_linenumber)::BIGINT AS failures FROM lineitem GROUP BY 1, 2")
def _(t, spark):
    usage = F.create_map(F.col("l_linestatus"), F.struct(F.col("l_quantity").cast("long").alias("attempts"), F.col("l_linenumber").cast("long").alias("failures")))
    return A.merged_usage(t("lineitem").select("l_suppkey", usage.alias("tool_usage")), ["l_suppkey"], how="max")


@query("ag25_task_metrics", """
WITH s AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS tokens, 0::BIGINT AS duration FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND coalesce(s.tokens, 0) > 0 THEN s.tokens ELSE o_custkey END AS tokens,
  CASE WHEN o_orderstatus = 'F' THEN CASE WHEN coalesce(s.tokens, 0) > 0 THEN 3600000 ELSE coalesce(nullif(o_custkey % 3, 0), 3600000) END ELSE coalesce(nullif(o_custkey % 3, 0), -1) END AS duration FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def _(t, spark):
    started = F.col("o_orderdate").cast("timestamp_ntz")
    tasks = t("orders").select("o_orderkey", started.alias("started_at"), F.when(F.col("o_orderstatus") == "F", started + F.expr("INTERVAL 1 HOUR")).alias("finished_at"))
    stored = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("tokens"), F.lit(0).cast("long").alias("duration"))
    streamed = t("orders").select("o_orderkey", F.col("o_custkey").alias("tokens"), (F.col("o_custkey") % 3).alias("duration"))
    return A.task_metrics(tasks, stored, streamed, "o_orderkey", ["tokens", "duration"]).select("o_orderkey", "tokens", F.coalesce("duration", F.lit(-1)).alias("duration"))


_LINES = "(SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT conv_id, turn, string_split(replace(text, ' ', chr(10)), chr(10)) AS l FROM conversations))"


def _words(t):
    """Words of conversation turns as lines."""
    rows = t("conversations").select(F.struct("conv_id", "turn").alias("k"), F.replace(F.col("text"), F.lit(" "), F.lit("\n")).alias("text"))
    return S.lines_of(rows, "k", "text")


def _counted(lines):
    return lines.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("pos").cast("long").alias("last")).select("k.*", "n", "last")


@query("wn10_stop_lines", rf"""
WITH c AS (SELECT *, coalesce(min(CASE WHEN regexp_matches(line, '(^|[^"''`A-Za-z0-9_])the($|[^"''`A-Za-z0-9_])') THEN pos END) OVER (PARTITION BY conv_id, turn), 1000000000) AS cut FROM {_LINES})
SELECT conv_id, turn, count(*) AS n, max(pos)::BIGINT AS last FROM c WHERE pos < cut GROUP BY 1, 2""")
def _(t, spark):
    return _counted(S.stop_at_lines(_words(t), "k", ["the"]))


@query("wn11_similar_line", f"""
WITH q AS (SELECT max(line) AS q FROM {_LINES} WHERE regexp_matches(line, '^[a-z]{{11,}}$')),
c AS (SELECT *, coalesce(min(CASE WHEN line = q OR (length(line) > 4 AND levenshtein(line, q)::DOUBLE / length(q) < 0.1) THEN pos END) OVER (PARTITION BY conv_id, turn), 1000000000) AS cut FROM {_LINES}, q WHERE regexp_matches(line, '^[ -~]*$'))
SELECT conv_id, turn, count(*) AS n, max(pos)::BIGINT AS last FROM c WHERE pos < cut GROUP BY 1, 2""")
def _(t, spark):
    lines = _words(t).filter(F.col("line").rlike("^[ -~]*$"))
    word = lines.filter(F.col("line").rlike("^[a-z]{11,}$")).agg(F.max("line")).first()[0] or ""
    return _counted(S.stop_at_similar(lines, "k", word))


@query("wn12_line_filters", f"SELECT conv_id, turn, count(*) AS n, max(pos)::BIGINT AS last FROM {_LINES} WHERE line NOT IN ('a', 'the') GROUP BY 1, 2")
def _(t, spark):
    # A comment mark of "the" and a path of nothing: lines that are the mark, or the mark and the path.
    lines = _words(t).withColumn("line", F.when(F.col("line") == "a", "the x").otherwise(F.col("line")))
    return _counted(S.without_path_lines(lines, "x", "the"))


@query("wn13_prefixes", f"""
WITH f AS (SELECT conv_id, turn, pos, CASE WHEN pos < turn % 4 THEN '<COMPLETION>' || line ELSE line END AS line, line AS plain FROM {_LINES})
SELECT conv_id, turn, sha256(string_agg(plain, chr(10) ORDER BY pos)) AS digest FROM f GROUP BY 1, 2""")
def _(t, spark):
    lines = _words(t).withColumn("line", F.when(F.col("pos") < F.col("k.turn") % 4, F.concat(F.lit("<COMPLETION>"), "line")).otherwise(F.col("line")))
    out = S.without_prefixes(lines, "k").groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return out.select("k.*", F.sha2("text", 256).alias("digest"))


@query("wn17_chunk_lines", """
WITH w AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1)
SELECT conv_id, len(string_split(text, chr(10)))::BIGINT AS n, sha256(string_split(text, chr(10))[-1]) AS last FROM w""")
def _(t, spark):
    lines = S.lines_of_chunks(t("conversations"), "conv_id", "turn", "text")
    return lines.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.max_by("line", "pos"), 256).alias("last"))


# Paragraph lines of texts under headers: every sixth line of a conversation's turns is a header.
_MARKED = "(SELECT conv_id, turn AS pos, CASE WHEN turn % 3 = 1 THEN repeat('#', (1 + turn % 4)::INT) || ' ' || role ELSE 'x' || role END AS line, turn % 3 = 1 AS head, 1 + turn % 4 AS level, role FROM conversations)"


def _marked(t):
    turn = F.col("turn")
    line = F.when(turn % 3 == 1, F.concat(F.expr("repeat('#', cast(1 + turn % 4 as int))"), F.lit(" "), "role")).otherwise(F.concat(F.lit("x"), "role"))
    return t("conversations").select("conv_id", turn.alias("pos"), line.alias("line"))


@query("wn18_sections", f"""
WITH e AS (SELECT *, max(pos) OVER (PARTITION BY conv_id) AS n FROM {_MARKED})
SELECT conv_id, role AS title, level::INT AS level, pos::BIGINT AS start, coalesce(lead(pos) OVER (PARTITION BY conv_id ORDER BY pos) - 1, n)::BIGINT AS "end" FROM e WHERE head""")
def _(t, spark):
    s = S.markdown_sections(_marked(t), "conv_id")
    return s.select("conv_id", "title", F.col("level").cast("int").alias("level"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("wn19_outline", f"""
WITH e AS (SELECT *, max(pos) OVER (PARTITION BY conv_id) AS n FROM {_MARKED}),
s AS (SELECT conv_id, role, level, pos, coalesce(lead(pos) OVER (PARTITION BY conv_id ORDER BY pos) - 1, n) AS e FROM e WHERE head)
SELECT conv_id, (pos + 1) || '--' || (e + 1) || ' | ' || repeat('#', level::INT) || ' ' || role AS outline FROM s WHERE e - pos + 1 >= 3""")
def _(t, spark):
    return S.section_outline(S.markdown_sections(_marked(t), "conv_id"), 3).select("conv_id", "outline")


_DIFF = """(SELECT conv_id, turn AS pos, CASE turn % 6 WHEN 0 THEN '@@ -' || (turn * 7 + 1) || ',9 +' || (turn * 9 + 2) || ',9 @@' WHEN 1 THEN ' c' WHEN 2 THEN '-d' WHEN 3 THEN '+a' WHEN 4 THEN '+b' ELSE ' e' END AS line,
  CASE turn % 6 WHEN 0 THEN 'hunk' WHEN 2 THEN 'deletion' WHEN 3 THEN 'addition' WHEN 4 THEN 'addition' ELSE 'context' END AS kind, turn // 6 AS h, turn - turn % 6 AS base FROM conversations)"""


@query("wn20_diff_numbers", f"""
SELECT conv_id, pos, CASE WHEN kind = 'hunk' THEN 'gap' ELSE kind END AS kind,
  CASE WHEN kind IN ('context', 'deletion') THEN base * 7 + 1 + count(*) FILTER (kind IN ('context', 'deletion')) OVER w - 1 ELSE -1 END AS old, CASE WHEN kind IN ('context', 'addition') THEN base * 9 + 2 + count(*) FILTER (kind IN ('context', 'addition')) OVER w - 1 ELSE -1 END AS new
FROM {_DIFF} WINDOW w AS (PARTITION BY conv_id, h ORDER BY pos) QUALIFY kind <> 'hunk' OR h > 0""")
def _(t, spark):
    turn = F.col("turn")
    head = F.format_string("@@ -%d,9 +%d,9 @@", turn * 7 + 1, turn * 9 + 2)
    line = F.when(turn % 6 == 0, head).when(turn % 6 == 1, " c").when(turn % 6 == 2, "-d").when(turn % 6 == 3, "+a").when(turn % 6 == 4, "+b").otherwise(" e")
    out = S.diff_line_numbers(t("conversations").select("conv_id", turn.alias("pos"), line.alias("line")), "conv_id")
    return out.select("conv_id", "pos", "kind", F.coalesce(F.col("old").cast("long"), F.lit(-1)).alias("old"), F.coalesce(F.col("new").cast("long"), F.lit(-1)).alias("new"))


@query("wn21_log_elapsed", """
SELECT event_id, round((epoch_ms(ts) - min(epoch_ms(ts)) OVER (PARTITION BY user_id)) / 1000.0::DOUBLE, 3) AS elapsed, event_type AS message FROM (SELECT event_id, user_id, event_type, date_trunc('second', ts) AS ts FROM events)""")
def _(t, spark):
    stamp = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    lines = t("events").select("event_id", "user_id", order.alias("pos"), F.concat(F.lit("["), stamp, F.lit("Z] [info] "), "event_type").alias("line"))
    return S.log_elapsed(lines, "user_id").select("event_id", F.round("elapsed", 3).alias("elapsed"), "message")


@query("wn25_since_summary", f"""
WITH m AS {_LOG}, w AS (SELECT *, max(CASE WHEN is_summary THEN seq END) OVER p AS last, min(CASE WHEN role = 'user' THEN seq END) OVER p AS first_user FROM m WINDOW p AS (PARTITION BY conv_id))
SELECT conv_id, seq FROM w WHERE last IS NULL OR seq >= last OR seq = first_user""")
def _(t, spark):
    return S.since_summary(_log(t)).select("conv_id", "seq")


# Requests that open and close: 'purchase' opens one, 'click' closes the nearest open one, so a depth counts what is open.
@query("wn05_paired_requests", """
WITH RECURSIVE m AS (SELECT user_id AS task_id, event_id AS seq, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT task_id, i, CASE WHEN event_type = 'purchase' THEN [seq] ELSE []::BIGINT[] END AS open, NULL::BIGINT AS closed, NULL::BIGINT AS by_ FROM m WHERE i = 1
  UNION ALL SELECT m.task_id, m.i, CASE WHEN event_type = 'purchase' THEN list_append(open, m.seq) WHEN event_type = 'click' AND len(open) > 0 THEN open[:len(open) - 1] ELSE open END,
    CASE WHEN event_type = 'click' AND len(open) > 0 THEN open[len(open)] END, CASE WHEN event_type = 'click' AND len(open) > 0 THEN m.seq END FROM f JOIN m ON m.task_id = f.task_id AND m.i = f.i + 1)
SELECT m.seq, '{"a":' || m.seq || CASE WHEN f.by_ IS NULL THEN '' ELSE ',"b":' || f.by_ END || '}' AS text FROM m LEFT JOIN f ON f.task_id = m.task_id AND f.closed = m.seq WHERE event_type = 'purchase'""")
def _(t, spark):
    kind = F.when(F.col("event_type") == "purchase", "api_req_started").when(F.col("event_type") == "click", "api_req_finished").otherwise("text")
    body = F.when(F.col("event_type") == "purchase", F.format_string('{"a":%d}', "event_id")).otherwise(F.format_string('{"b":%d}', "event_id"))
    m = t("events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.lit("say").alias("type"), F.lit(None).cast("string").alias("ask"), kind.alias("say"), body.alias("text"))
    # One message alone is returned as it is.
    return S.paired_requests(m).filter("say = 'api_req_started'").select("seq", "text")


@query("wn06_folded_commands", """
WITH m AS (SELECT user_id AS task_id, event_id AS seq, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS command FROM events),
o AS (SELECT task_id, command, string_agg('o' || seq, chr(10) ORDER BY seq) AS body, max(seq) AS last FROM m WHERE event_type = 'click' AND command IS NOT NULL GROUP BY 1, 2)
SELECT m.seq, CASE WHEN event_type = 'purchase' THEN 'c' || m.seq || coalesce(chr(10) || 'Output:' || body, '') ELSE 't' || m.seq END AS text FROM m LEFT JOIN o ON o.task_id = m.task_id AND o.command = m.command WHERE event_type <> 'click'""")
def _(t, spark):
    kind = F.col("event_type")
    m = t("events").select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.when(kind == "purchase", "ask").otherwise("say").alias("type"), F.when(kind == "purchase", "command").alias("ask"),
        F.when(kind == "click", "command_output").when(kind != "purchase", "text").alias("say"), F.concat(F.when(kind == "purchase", "c").when(kind == "click", "o").otherwise("t"), F.col("event_id").cast("string")).alias("text"),
    )
    return S.folded_commands(m).select("seq", "text")


@query("wn23_timeline", """
WITH m AS (SELECT user_id AS task_id, event_id AS seq, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT seq, i AS "index" FROM m WHERE i > 0 AND event_type = 'purchase'""")
def _(t, spark):
    kind = F.col("event_type")
    m = t("events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.lit("say").alias("type"), F.lit(None).cast("string").alias("ask"), F.when(kind == "purchase", "tool").otherwise("text").alias("say"), F.lit("x").alias("text"))
    return S.timeline(m, ["tool"]).select("seq", F.col("index").cast("long").alias("index"))


@query("fl09_properties", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'event' ELSE l_linestatus END AS mode, CASE WHEN l_quantity > 25 THEN l_returnflag ELSE '-' END AS flag FROM lineitem""")
def _(t, spark):
    base = F.create_map(F.lit("mode"), F.col("l_linestatus"), F.lit("flag"), F.col("l_returnflag"))
    event = F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit("mode"), F.lit("event"))).otherwise(F.create_map(F.lit("n"), F.lit("1")))
    merged = R.merged_properties(base, event, ["flag"], F.col("l_quantity") > 25)
    return t("lineitem").select("l_orderkey", "l_linenumber", merged.alias("m")).select("l_orderkey", "l_linenumber", F.col("m.mode").alias("mode"), F.coalesce("m.flag", F.lit("-")).alias("flag"))


@query("fl12_payloads", "SELECT event_id, event_type <> 'view' AND event_id % 3 = 0 AS valid FROM events")
def _(t, spark):
    payload = F.when(F.col("event_type") != "view", F.create_map(F.when(F.col("event_id") % 3 == 0, "a").otherwise("c"), F.lit(None).cast("string"), F.lit("b"), F.lit("x")))
    return t("events").select("event_id", R.valid_payload(payload, ["a", "b"]).alias("valid"))


@query("fl13_snippets", "SELECT event_id, NOT (event_type = 'view' AND epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts) > 300000000) AND event_id % 7 <> 0 AS valid FROM events")
def _(t, spark):
    content = F.when(F.col("event_id") % 7 == 0, " \n").otherwise("x y")
    return t("events").select("event_id", R.valid_snippet(content, F.col("event_type") == "view", F.col("ts"), datetime(2024, 1, 20)).alias("valid"))


@query("fl14_sampled", "SELECT count(*) AS n FROM orders")
def _(t, spark):
    # A rate above 1 is clamped: every row.
    return R.sampled(t("orders"), 7.5, 3).agg(F.count(F.lit(1)).alias("n"))


@query("fl15_levels", "SELECT event_id, CASE event_type WHEN 'view' THEN 'info' WHEN 'purchase' THEN 'error' ELSE 'none' END AS level FROM events")
def _(t, spark):
    line = F.concat(F.lit("at "), F.when(F.col("event_type") == "view", "notice warn").when(F.col("event_type") == "purchase", "fail notice").otherwise("-"))
    return t("events").select("event_id", F.coalesce(X.highlighted_levels(line, {"warn": "warn", "error": "fail", "info": "notice"}), F.lit("none")).alias("level"))


@query("bg08_priority_fill", """
WITH RECURSIVE r AS (SELECT o_custkey AS k, o_orderkey, (o_totalprice / 1000)::BIGINT AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS i FROM orders),
f AS (SELECT k, o_orderkey, i, CASE WHEN n + 10 <= 500 THEN 490 - n ELSE 500 END AS room, n + 10 <= 500 AS taken FROM r WHERE i = 1
  UNION ALL SELECT r.k, r.o_orderkey, r.i, CASE WHEN r.n + 10 <= f.room THEN f.room - r.n - 10 ELSE f.room END, r.n + 10 <= f.room FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1)
SELECT o_orderkey FROM f WHERE taken""")
def _(t, spark):
    o = t("orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") / 1000).cast("long").alias("n"))
    return B.greedy_fill(o, "o_custkey", ["o_orderpriority", "o_orderkey"], "n", 500, overhead=10).select("o_orderkey")


@query("bg10_read_within", """
WITH l AS (SELECT conv_id, turn AS pos, text AS line, ceil(length(text) / 4.0)::BIGINT AS n FROM conversations),
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS spent FROM l)
SELECT conv_id, count(*) FILTER (spent <= 120) AS line_count, coalesce(max(spent) FILTER (spent <= 120), 0)::BIGINT AS token_count, count(*) FILTER (spent > 120) = 0 AS complete,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (spent <= 120), '')) AS digest FROM s GROUP BY 1""")
def _(t, spark):
    lines = t("conversations").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("line"))
    out = B.read_within(lines, "conv_id", B.estimated_tokens(F.col("line")), 120)
    return out.select("conv_id", "line_count", "token_count", "complete", F.sha2("content", 256).alias("digest"))


@query("sc13_upserted", "SELECT vec_id AS id, 'old' AS state FROM embeddings WHERE vec_id % 4 <> 0 UNION ALL SELECT vec_id, 'new' FROM embeddings WHERE vec_id % 4 = 0")
def _(t, spark):
    points = t("embeddings").select(F.col("vec_id").alias("id"), F.lit("old").alias("state"), *[F.lit(None).cast("string").alias(c) for c in ("filePath", "codeChunk", "startLine", "endLine")])
    new = points.filter("id % 4 = 0").withColumn("state", F.lit("new"))
    return V.upserted(points, new).select("id", "state")


@query("sc14_without_files", "SELECT page_id FROM pages WHERE page_id % 5 <> 0")
def _(t, spark):
    path = F.format_string("dir/file%d.txt", F.col("page_id"))
    points = t("pages").select("page_id", F.concat(F.lit("/root/"), path).alias("filePath"))
    gone = t("pages").filter("page_id % 5 = 0").select(F.concat(F.lit("./"), path).alias("filePath"))
    return V.without_files(points, gone, "/root").select("page_id")


@query("vs06_preferred_branch", """
SELECT p_partkey, coalesce(max(CASE WHEN b = 'own' THEN 'own' END), max(b)) AS branch FROM
(SELECT p_partkey, 'own' AS b FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'main' FROM part WHERE p_size % 3 = 0 AND p_brand <> (SELECT min(p_brand) FROM part)) GROUP BY 1""")
def _(t, spark):
    p = t("part").select("p_partkey", "p_size", F.col("p_brand").alias("filePath"), F.col("p_partkey").alias("startLine"), F.col("p_partkey").alias("endLine"))
    rows = p.filter("p_size % 2 = 0").withColumn("branch", F.lit("own")).unionByName(p.filter("p_size % 3 = 0").withColumn("branch", F.lit("main")))
    excluded = t("part").agg(F.min("p_brand").alias("filePath"))
    return V.preferred_branch(rows, "own", "main", excluded).select(F.col("startLine").alias("p_partkey"), "branch")


@query("vs13_within_size", "SELECT p_partkey FROM part WHERE p_size <= 30 AND p_partkey % 3 <> 0")
def _(t, spark):
    name = F.concat(F.lit("a.b/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".bin").when(F.col("p_partkey") % 3 == 1, ".PY").otherwise(".ts"))
    return V.within_size(t("part").select("p_partkey", name.alias("path"), F.col("p_size").alias("length")), (".py", ".ts"), 30).select("p_partkey")


@query("so04_git_changes", """
SELECT 'p' || p_partkey AS path, CASE p_partkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'modify' WHEN 2 THEN 'delete' ELSE 'delete' END AS change FROM part UNION ALL SELECT 'q' || p_partkey, 'add' FROM part WHERE p_partkey % 4 = 3""")
def _(t, spark):
    k, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    code = F.when(k == 0, "A").when(k == 1, "M").when(k == 2, "D").otherwise("R087")
    line = F.concat_ws("\t", code, F.concat(F.lit("p"), n), F.when(k == 3, F.concat(F.lit("q"), n)))
    return R.git_changes(t("part").select(line.alias("line")))


@query("tx14_postprocessed", """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '-' WHEN p_size % 4 = 1 THEN p_name WHEN p_size % 4 = 2 THEN p_name ELSE '-' END AS suggestion FROM part""")
def _(t, spark):
    k = F.col("p_size") % 4
    made = F.when(k == 0, " \n ").when(k == 1, F.concat(F.lit(" "), "p_name")).when(k == 2, F.concat(F.lit("```py\n"), "p_name", F.lit("\n```"))).otherwise(F.col("p_name"))
    prefix = F.when(k == 3, F.concat(F.lit("x = "), "p_name")).otherwise(F.lit("x = "))
    return t("part").select("p_partkey", F.coalesce(X.postprocessed(prefix, made, F.lit("")), F.lit("-")).alias("suggestion"))


@query("xs10_skip_completion", "SELECT p_partkey, p_size % 3 = 0 OR p_size % 3 = 1 AS skip FROM part")
def _(t, spark):
    prefix = F.concat(F.lit("a\n"), F.when(F.col("p_size") % 3 == 0, "x = 1; ").when(F.col("p_size") % 3 == 1, "wor").otherwise("x = "))
    return t("part").select("p_partkey", X.skip_completion(F.lit("c"), prefix, {"py": []}).alias("skip"))


@query("xs15_grouped", "SELECT p_brand, array_to_string(list_sort(list(p_name)), '|') AS results FROM part GROUP BY 1")
def _(t, spark):
    return X.grouped(t("part"), "p_brand", "p_name").select("p_brand", F.array_join("results", "|").alias("results"))


@query("xs17_rate_limit", "SELECT event_id, least(100.0::DOUBLE, greatest(0.0::DOUBLE, value * 3 - 50)) AS percent, round(value * 1000)::BIGINT AS reset_ms FROM events")
def _(t, spark):
    limit = X.rate_limit(F.col("value") * 3 - 50, F.col("value"), F.lit(60))
    return t("events").select("event_id", limit.alias("r")).select("event_id", "r.percent", "r.reset_ms")


@query("xs18_without_overlap", "SELECT p_partkey, substring(p_type, (1 + length(split_part(p_type, ' ', 1)))::INT) AS rest FROM part")
def _(t, spark):
    first = F.split_part("p_type", F.lit(" "), F.lit(1))
    return t("part").select("p_partkey", T.without_overlap(F.concat(F.lit("x\n"), first), F.col("p_type")).alias("rest"))


@query("xs21_lock_files", "SELECT p_partkey, p_size % 5 IN (0, 3) AS locked FROM part")
def _(t, spark):
    k = F.col("p_size") % 5
    name = F.when(k == 0, "/package-lock.json").when(k == 1, "/locker.py").when(k == 2, "/package.json").when(k == 3, "/.yarn/cache/x.zip").otherwise("/xCargo.lock")
    return t("part").select("p_partkey", X.is_lock_file(F.concat(F.lit("a/b"), F.col("p_partkey").cast("string"), name)).alias("locked"))


@query("sf09_first_line", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN string_split(replace(text, ' ', chr(10)), chr(10))[1] ELSE replace(text, ' ', chr(10)) END AS line FROM conversations")
def _(t, spark):
    made = F.replace(F.col("text"), F.lit(" "), F.lit("\n"))
    prefix = F.when(F.col("turn") % 2 == 0, "a\nif x:").otherwise("a\n   ")
    return t("conversations").select("conv_id", "turn", T.first_line_if_only(made, prefix).alias("line"))


@query("sf16_api_price", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN -1 ELSE round(p_retailprice * 1000000, 2) END AS price FROM part")
def _(t, spark):
    text = F.when(F.col("p_size") % 6 == 0, "0").when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string"))
    return t("part").select("p_partkey", F.coalesce(F.round(T.api_price(text), 2), F.lit(-1.0)).alias("price"))


@query("sf17_semver", "SELECT p_partkey, p_size || '.' || (p_partkey % 10) || '.0' AS version FROM part")
def _(t, spark):
    version = T.semver(F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit("-beta.1")))
    return t("part").select("p_partkey", F.array_join(version.cast("array<string>"), ".").alias("version"))


@query("sf21_range", """
WITH l AS (SELECT conv_id, turn, string_split(replace(text, ' ', chr(10)), chr(10)) AS l FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN substring(l[1], 2, 2) ELSE substring(l[1], 2) || chr(10) || l[2] || chr(10) || left(l[3], 1) END AS part FROM l WHERE len(l) >= 3""")
def _(t, spark):
    text = F.replace(F.col("text"), F.lit(" "), F.lit("\n"))
    even = F.col("turn") % 2 == 0
    part = T.text_range(text, F.lit(0), F.lit(1), F.when(even, 0).otherwise(2), F.when(even, 3).otherwise(1))
    return t("conversations").filter(F.size(F.split(text, "\n")) >= 3).select("conv_id", "turn", part.alias("part"))


@query("sf27_content_length", "SELECT conv_id, turn, greatest(1, length(text) + length(role) + 100 * (turn % 3))::INT AS n FROM conversations")
def _(t, spark):
    images = F.array_repeat(F.lit("i"), (F.col("turn") % 3).cast("int"))
    return t("conversations").select("conv_id", "turn", T.content_length(F.col("text"), F.lit(None).cast("string"), images, F.col("role")).alias("n"))


@query("sf28_canonical", """SELECT p_partkey, '{"a":"' || p_brand || '","z":"' || p_size || '"}' AS params FROM part""")
def _(t, spark):
    return t("part").select("p_partkey", T.canonical_map(F.create_map(F.lit("z"), F.col("p_size").cast("string"), F.lit("a"), F.col("p_brand"))).alias("params"))


@query("st04_latest_state", "SELECT user_id, arg_max(event_type, ts) AS event_type, (epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000)::BIGINT AS elapsed_ms FROM events GROUP BY 1")
def _(t, spark):
    return J.latest_state(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", ["event_type"])


@query("st06_published", "SELECT event_id FROM events WHERE event_type <> 'view'")
def _(t, spark):
    e = t("events").select("event_id", F.col("event_type").alias("eventName"), F.lit(False).alias("partial"), F.lit(None).cast("string").alias("say"))
    return J.published(e, ["view"]).select("event_id")


@query("st07_parsed", "SELECT event_id AS id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 9 <> 0")
def _(t, spark):
    line = F.when(F.col("event_id") % 9 == 0, "{oops").otherwise(F.format_string('{"id":%d,"k":%s}', F.col("event_id"), F.get_json_object("props", "$.k")))
    return J.parsed(t("events").select(line.alias("value")), "id long, k long")
