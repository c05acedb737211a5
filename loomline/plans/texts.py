"""Queries over the driver's tables for text functions, search and similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import editing as E
from loomline.operators import search as X
from loomline.operators import sequences as S
from loomline.plans.registry import query


@query("sf01_normalized", r"""
SELECT doc_id, sha256(trim(regexp_replace(replace(translate(text, '“”‘’–—' || chr(160), '""''''-- '), '…', '...'), '[\s\x{FEFF}\x{2000}-\x{200A}]+', ' ', 'g'))) AS digest FROM documents""")
def _(t, spark):
    return t("documents").select("doc_id", F.sha2(T.normalized(F.col("text")), 256).alias("digest"))


@query("sf02_unescaped", """
SELECT page_id, sha256(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&#91;', '['), '&#93;', ']'), '&lsqb;', '['), '&rsqb;', ']'), '&amp;', '&')) AS digest FROM pages""")
def _(t, spark):
    return t("pages").select("page_id", F.sha2(T.unescaped_html(F.col("html")), 256).alias("digest"))


@query("sf03_escaped", """
SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS digest FROM pages""")
def _(t, spark):
    return t("pages").select("page_id", F.sha2(T.escaped_html(F.col("html")), 256).alias("digest"))


@query("sf05_line_numbers", """
WITH l AS (SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM documents WHERE text <> '')
SELECT doc_id, sha256(array_to_string(list_transform(l, lambda x, i: lpad(i::VARCHAR, length(len(l)::VARCHAR)::INT, ' ') || ' | ' || x), chr(10)) || chr(10)) AS digest FROM l""")
def _(t, spark):
    return t("documents").filter("text <> ''").select("doc_id", F.sha2(T.numbered_lines(F.col("text")), 256).alias("digest"))


@query("sf08_line_count", "SELECT doc_id, (CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END)::BIGINT AS n FROM documents")
def _(t, spark):
    return t("documents").select("doc_id", T.line_count(F.col("text")).cast("long").alias("n"))


@query("sf10_token_counts", """
WITH v AS (SELECT o_orderkey, round(o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 1 WHEN 2 THEN 1000 ELSE 10000 END)::BIGINT AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 1000000 THEN CASE WHEN floor(n / 1000.0::DOUBLE + 0.5) >= 1000 THEN '1.0M' ELSE floor(n / 1000.0::DOUBLE + 0.5)::BIGINT::VARCHAR || 'k' END
  WHEN n < 1000000000 THEN CASE WHEN floor(n / 100000.0::DOUBLE + 0.5) / 10 >= 1000 THEN '1.0B' ELSE printf('%.1fM', floor(n / 100000.0::DOUBLE + 0.5) / 10) END ELSE printf('%.1fB', n / 1000000000.0::DOUBLE) END AS label FROM v""")
def _(t, spark):
    k = F.col("o_orderkey") % 4
    n = F.round(F.col("o_totalprice") * F.when(k == 0, 0.001).when(k == 1, 1).when(k == 2, 1000).otherwise(10000)).cast("long")
    return t("orders").select("o_orderkey", T.token_count(n).alias("label"))


@query("sf11_duration", "SELECT o_orderkey, (s // 3600)::VARCHAR || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS label FROM (SELECT o_orderkey, floor(o_totalprice * 100 / 1000)::BIGINT AS s FROM orders)")
def _(t, spark):
    return t("orders").select("o_orderkey", T.duration(F.col("o_totalprice") * 100).alias("label"))


@query("sf12_success_rate", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '0%' ELSE floor((p_size % 7 - p_partkey % (p_size % 7 + 1)) * 100.0::DOUBLE / (p_size % 7) + 0.5)::BIGINT::VARCHAR || '%' END AS label FROM part")
def _(t, spark):
    attempts = F.col("p_size") % 7
    return t("part").select("p_partkey", T.success_rate(attempts, F.col("p_partkey") % (attempts + 1)).alias("label"))


@query("sf13_cost", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 OR l_discount > 0.05 THEN printf('%.2f', l_discount) ELSE printf('%.4f', l_discount) END AS label FROM lineitem")
def _(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", T.cost(F.col("l_discount")).alias("label"))


_NOW = 1_720_000_000_000


@query("sf14_relative_time", f"""
WITH s AS (SELECT event_id, floor(({_NOW} - epoch_ms(ts) * 1.0::DOUBLE) / 1000)::BIGINT AS s FROM (SELECT event_id, ts - to_days((event_id % 900)::INT) AS ts FROM events)),
u AS (SELECT event_id, s, CASE WHEN s >= 31536000 THEN 'year' WHEN s >= 2592000 THEN 'month' WHEN s >= 604800 THEN 'week' WHEN s >= 86400 THEN 'day' WHEN s >= 3600 THEN 'hour' WHEN s >= 60 THEN 'minute' END AS u FROM s),
n AS (SELECT *, s // CASE u WHEN 'year' THEN 31536000 WHEN 'month' THEN 2592000 WHEN 'week' THEN 604800 WHEN 'day' THEN 86400 WHEN 'hour' THEN 3600 ELSE 60 END AS n FROM u)
SELECT event_id, CASE WHEN u IS NULL THEN CASE WHEN s > 30 THEN s || ' seconds ago' ELSE 'just now' END WHEN n = 1 THEN '1 ' || u || ' ago' ELSE n || ' ' || u || 's ago' END AS label FROM n""")
def _(t, spark):
    ts = F.unix_millis((F.col("ts") - F.make_dt_interval(F.col("event_id") % 900)).cast("timestamp"))
    return t("events").select("event_id", T.relative_time(ts, _NOW).alias("label"))


@query("sf15_initials", "SELECT n_name, array_to_string(list_transform(string_split(lower(n_name), '_'), lambda x: upper(left(x, 1))), '') AS label FROM nation")
def _(t, spark):
    return t("nation").select("n_name", T.initials(F.lower("n_name")).alias("label"))


@query("sf19_line_hash", "SELECT item_id, sha1(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest FROM benchmark")
def _(t, spark):
    return t("benchmark").select("item_id", T.line_hash(F.col("text")).alias("digest"))


@query("sf20_file_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t, spark):
    return t("documents").select("doc_id", T.file_hash(F.col("text")).alias("digest"))


@query("sf23_json_field", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.none'), 'none') AS none FROM events")
def _(t, spark):
    return t("events").select("event_id", T.json_field(F.col("props"), "k", "long", -1).alias("k"), T.json_field(F.col("props"), "none", "string", "none").alias("none"))


@query("sf24_tags", "SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS inner FROM pages")
def _(t, spark):
    return t("pages").select("page_id", F.explode(T.tag_contents(F.col("html"), "p")).alias("inner"))


@query("sf25_git_url", r"SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '(\.git)?/*$', '') AS clean, coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '(\.git)?/*$', ''), '[/:]([^/:]+)$', 1), ''), '-') AS name FROM pages")
def _(t, spark):
    return t("pages").select("page_id", T.clean_git_url(F.col("url")).alias("clean"), F.coalesce(T.repository_name(F.col("url")), F.lit("-")).alias("name"))


@query("sf26_symbols", r"SELECT item_id, len(list_distinct(list_filter(regexp_split_to_array(text, '[\s.,/#!$%^&*;:{}=\-_`~()\[\]]'), lambda x: x <> '')))::BIGINT AS n FROM benchmark")
def _(t, spark):
    return t("benchmark").select("item_id", F.size(T.symbols(F.col("text"))).cast("long").alias("n"))


@query("tx01_grep", r"""
WITH l AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
h AS (SELECT *, regexp_matches(line, 'License|token') AS hit FROM l),
n AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h),
g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 1 THEN 1 ELSE 0 END AS gap FROM n WHERE near),
b AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM g WHERE doc_id IN (SELECT DISTINCT doc_id FROM g ORDER BY 1 LIMIT 300))
SELECT doc_id, min(pos)::BIGINT AS start, max(pos)::BIGINT AS "end", count(*) FILTER (hit) AS matches, sha256(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM b GROUP BY doc_id, block""")
def _(t, spark):
    blocks = X.grep(t("documents").select("doc_id", F.split("text", "\n").alias("l")), "doc_id", "l", "License|token")
    return blocks.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "matches", F.sha2("text", 256).alias("digest"))


@query("tx02_fuzzy_find", """
WITH m AS (SELECT DISTINCT p_name, 6 - length(regexp_extract(lower(p_name), 'e.*?i.*?g', 0)) AS score FROM part WHERE regexp_matches(lower(p_name), 'e.*?i.*?g'))
SELECT p_name, score::INT AS score FROM m ORDER BY score DESC, length(p_name), p_name LIMIT 20""")
def _(t, spark):
    return X.fuzzy_find(t("part").select("p_name").distinct(), "p_name", "EIg").select("p_name", "score")


@query("tx04_symbol_similarity", r"""
WITH s AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(text, '[\s.,/#!$%^&*;:{}=\-_`~()\[\]]'), lambda x: x <> '')) AS a FROM benchmark),
q AS (SELECT a AS b FROM s WHERE item_id = 0)
SELECT item_id, round(coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 8) AS score FROM s, q""")
def _(t, spark):
    q = t("benchmark").filter("item_id = 0").first()["text"]
    return X.symbol_similarity(t("benchmark"), q, "text").select("item_id", F.round("score", 8).alias("score"))


@query("tx05_edit_similarity", "SELECT p_partkey, round(1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)), 8) AS score FROM part")
def _(t, spark):
    return t("part").select("p_partkey", F.round(X.edit_similarity(F.col("p_name"), F.col("p_type")), 8).alias("score"))


@query("tx09_repeated_lines", "SELECT a.p_partkey, b.p_partkey AS other FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE length(a.p_name) > 4 AND length(b.p_name) > 4 AND levenshtein(a.p_name, b.p_name)::DOUBLE / length(b.p_name) < 0.1")
def _(t, spark):
    return S.repeated_pairs(t("part"), ["p_brand", "p_size"], "p_partkey", "p_name")


@query("tx11_extreme_repetition")
def _(t, spark):
    return t("documents").select("doc_id", E.extreme_repetitions(F.replace("text", F.lit(" "), F.lit("\n"))).alias("extreme"))


@query("tx12_phrase_repeats", r"""
WITH b AS (SELECT doc_id, text, regexp_replace(text, '\W+$', '') AS bare FROM documents)
SELECT doc_id, length(text) >= 90 AND length(bare) >= 30 AND (length(text) - length(replace(text, right(bare, 30), ''))) / 30 >= 3 AS repeats FROM b""")
def _(t, spark):
    return t("documents").select("doc_id", X.phrase_repeats(F.col("text")).alias("repeats"))


@query("tx13_duplicates")
def _(t, spark):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t("conversations").withColumn("before", F.coalesce(F.lag("text").over(w), F.lit(""))).withColumn("after", F.coalesce(F.lead("text").over(w), F.lit("")))
    return c.select("conv_id", "turn", X.is_duplicate(F.col("before"), F.col("text"), F.col("after")).alias("duplicate"))


@query("tx18_suggestion_key", "SELECT event_id, event_type || '|' || coalesce(json_extract_string(props, '$.none'), '') || '|' || user_id::VARCHAR AS key FROM events")
def _(t, spark):
    return t("events").select("event_id", T.suggestion_key(F.col("event_type"), F.get_json_object("props", "$.none"), F.col("user_id").cast("string")).alias("key"))


@query("xs01_catalog_page", "SELECT p_partkey, round(p_retailprice + p_size, 4) AS total_price FROM part WHERE p_size <= 40 AND (contains(lower(p_name), '1') OR contains(lower(p_type), '1') OR contains(lower(p_brand), '1'))")
def _(t, spark):
    models = t("part").withColumn("old", F.col("p_size") > 40)
    return X.catalog_page(models, "1", ["p_name", "p_type", "p_brand"], ["p_retailprice", "p_size"], [F.asc("p_name"), F.asc("p_partkey")], "old").select("p_partkey", F.round("total_price", 4).alias("total_price"))


@query("xs02_problems", """
WITH d AS (SELECT l_suppkey AS file, l_linenumber AS line, l_quantity::INT % 4 AS severity, l_orderkey FROM lineitem WHERE l_quantity::INT % 4 IN (0, 1))
SELECT *, (SELECT count(*) - 50 FROM d) AS omitted FROM d ORDER BY severity, line, file, l_orderkey LIMIT 50""")
def _(t, spark):
    d = t("lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_quantity").cast("int") % 4).alias("severity"), "l_orderkey")
    return X.problems(d, [0, 1], 50, tie=["file", "l_orderkey"])


@query("xs11_glossary", r"SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(text, '\b[A-Za-z_][A-Za-z0-9_]{3,}\b')) AS term FROM benchmark) WHERE term NOT IN ('that', 'with') ORDER BY length(term) DESC, term LIMIT 28")
def _(t, spark):
    return X.glossary(t("benchmark"), "text", ["that", "with"], limit=30)
