"""Queries over the driver's tables for edits, diffs, terminal text and shell lines. Inputs are made so that SQL knows what an edit must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import editing as E
from loomline.operators import sequences as S
from loomline.plans.registry import query

# A turn's words as lines; the third line is what edits change.
_TURNS = "(SELECT conv_id, turn, replace(text, ' ', chr(10)) AS t, string_split(replace(text, ' ', chr(10)), chr(10)) AS l FROM conversations WHERE len(string_split(replace(text, ' ', chr(10)), chr(10))) >= 4)"


def _turns(t):
    text = F.replace(F.col("text"), F.lit(" "), F.lit("\n"))
    return t("conversations").select("conv_id", "turn", text.alias("t"), F.split(text, "\n").alias("l")).filter(F.size("l") >= 4)


def _line(i):
    return F.get(F.col("l"), F.lit(i - 1))


def _with_third(x):
    return F.array_join(F.concat(F.slice("l", 1, 2), F.array(x), F.slice("l", F.lit(4), F.size("l"))), "\n")


@query("tx06_best_window", f"""
SELECT conv_id, turn, list_max(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN l[i] = l[2] THEN i END), lambda i: i IS NOT NULL AND i <= 2)) - 1 AS line FROM {_TURNS}""")
def _(t, spark):
    # Only the first three lines are looked at, so the middle is the second one, which equals itself.
    found = E.windows(F.col("t"), _line(2), F.lit(0), F.lit(3))
    return _turns(t).filter(F.length(_line(2)) > 0).select("conv_id", "turn", found["line"].cast("long").alias("line"))


@query("tx07_edited", f"SELECT conv_id, turn, sha256(array_to_string(l[1:2], chr(10)) || chr(10) || 'NEW 1' || chr(10) || 'NEW 2' || chr(10) || array_to_string(l[4:], chr(10))) AS digest FROM {_TURNS}")
def _(t, spark):
    diff = F.concat(F.lit("<<<<<<< SEARCH\n:start_line:3\n-------\n"), _line(3), F.lit("\n=======\nNEW 1\nNEW 2\n>>>>>>> REPLACE\n"))
    rows = _turns(t).filter(F.length(_line(3)) > 0)
    return rows.select("conv_id", "turn", F.sha2(E.edited(F.col("t"), diff), 256).alias("digest"))


@query("xs22_edited_files", f"SELECT conv_id, turn, sha256(CASE WHEN turn % 2 = 0 THEN t ELSE array_to_string(l[1:2], chr(10)) || chr(10) || 'NEW' || chr(10) || array_to_string(l[4:], chr(10)) END) AS digest FROM {_TURNS}")
def _(t, spark):
    rows = _turns(t).filter(F.length(_line(3)) > 0).withColumn("path", F.struct("conv_id", "turn"))
    diff = F.concat(F.lit("<<<<<<< SEARCH\n:start_line:3\n-------\n"), _line(3), F.lit("\n=======\nNEW\n>>>>>>> REPLACE\n"))
    diffs = rows.filter("turn % 2 = 1").select("path", F.lit(1).alias("n"), diff.alias("diff"))
    return E.edited_files(rows, diffs, "path", "t", "n").select("conv_id", "turn", F.sha2("t", 256).alias("digest"))


@query("tx08_sought", f"""
SELECT conv_id, turn, list_min(list_filter(list_transform(range(1, len(l)), lambda i: CASE WHEN l[i] = l[3] AND l[i + 1] = l[4] THEN i END), lambda i: i IS NOT NULL)) - 1 AS line FROM {_TURNS}""")
def _(t, spark):
    pattern = F.concat(_line(3), F.lit("\n"), _line(4))
    return _turns(t).select("conv_id", "turn", E.sought(F.col("t"), pattern).cast("long").alias("line"))


@query("tx10_subsequence", "SELECT p_partkey, p_type AS common FROM part")
def _(t, spark):
    # The same text with characters of another alphabet between: all of it is common.
    spread = F.regexp_replace("p_type", "(.)", "#$1")
    return t("part").select("p_partkey", E.subsequences(F.col("p_type"), spread).alias("common"))


@query("tx15_line_diff", f"SELECT conv_id, turn, (len(l) - 1)::BIGINT AS same, 1::BIGINT AS old, 2::BIGINT AS new FROM {_TURNS}")
def _(t, spark):
    rows = _turns(t).filter(F.length(_line(3)) > 0).withColumn("d", E.line_diffs(F.col("t"), _with_third(F.lit("#1\n#2"))))
    n = lambda k: F.size(F.filter("d", lambda x: x["kind"] == k)).cast("long").alias(k)
    return rows.select("conv_id", "turn", n("same"), n("old"), n("new"))


@query("tx16_char_diff", "SELECT p_partkey, [0, length(p_type), length(p_type) + 3]::VARCHAR AS places FROM part")
def _(t, spark):
    d = E.char_diffs(F.col("p_type"), F.concat(F.col("p_type"), F.lit("###")))
    end = lambda x: x["new"] + F.length(x["chars"])
    return t("part").select("p_partkey", d.alias("d")).select("p_partkey", F.format_string("[%d, %d, %d]", F.col("d")[0]["new"], end(F.col("d")[0]), end(F.col("d")[1])).alias("places"))


@query("tx17_stream_diff", f"SELECT conv_id, turn, sha256(array_to_string(list_transform(l, lambda x: '=' || x), chr(10)) || chr(10) || '+#####') AS digest FROM {_TURNS}")
def _(t, spark):
    d = E.stream_diffs(F.col("t"), F.concat(F.col("t"), F.lit("\n#####")))
    shown = F.transform("d", lambda x: F.concat(F.when(x["kind"] == "same", "=").when(x["kind"] == "new", "+").otherwise("-"), x["line"]))
    return _turns(t).withColumn("d", d).select("conv_id", "turn", F.sha2(F.array_join(shown, "\n"), 256).alias("digest"))


@query("sf06_carriage_returns", "SELECT p_partkey, CASE WHEN length(p_name) >= length(p_brand) THEN p_name ELSE p_name || substring(p_brand, length(p_name) + 1) END AS shown FROM part")
def _(t, spark):
    return t("part").select("p_partkey", E.terminal_text(F.concat("p_brand", F.lit("\r"), "p_name")).alias("shown"))


@query("sf07_backspaces", "SELECT p_partkey, left(p_name, length(p_name) - 2) || 'x' AS shown FROM part")
def _(t, spark):
    return t("part").select("p_partkey", E.terminal_text(F.concat("p_name", F.lit("\b\bx"))).alias("shown"))


@query("sf18_commands", """SELECT p_partkey, 'echo "' || p_type || ' && x"|ls ' || p_brand || '|rm a|cd b' AS commands FROM part""")
def _(t, spark):
    line = F.concat(F.lit('echo "'), "p_type", F.lit(' && x" && ls '), "p_brand", F.lit("; rm a | cd b"))
    return t("part").select("p_partkey", F.array_join(E.commands(line), "|").alias("commands"))


@query("sf22_merged_json", """SELECT p_partkey, '{"a":[' || p_size || ',7],"b":{"c":1,"d":' || p_size || '},"e":"' || p_brand || '"}' AS merged FROM part""")
def _(t, spark):
    a, b = F.format_string('{"a":[%d],"b":{"c":1},"e":0}', "p_size"), F.format_string('{"a":[7],"b":{"d":%d},"e":"%s"}', "p_size", "p_brand")
    return t("part").select("p_partkey", E.merged_json(a, b).alias("merged"))


@query("fl11_seen_files", "SELECT p_partkey FROM part WHERE p_size % 3 <> 0 OR p_partkey % 5 = 0")
def _(t, spark):
    path = F.concat(F.when(F.col("p_size") % 3 == 0, "build/").otherwise("src/"), F.when(F.col("p_partkey") % 5 == 0, "keep").otherwise("file"), F.lit(".txt"))
    return E.seen_files(t("part").select("p_partkey", path.alias("path")), "path", ["build/*", "!build/keep.txt"]).select("p_partkey")


@query("xs12_cache_points", """
WITH m AS (SELECT conv_id, row_number() OVER w - 1 AS i, role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT conv_id, n, max(CASE WHEN role = 'user' THEN i END) AS u, arg_max(upto, CASE WHEN role = 'user' THEN i END) AS covered FROM m GROUP BY 1, 2)
SELECT conv_id, CASE WHEN n > 1 AND u IS NOT NULL AND covered >= 300 THEN u ELSE -1 END AS point FROM u""")
def _(t, spark):
    m = t("conversations").withColumn("n", F.length("text"))
    points = E.cache_points_of(m, "conv_id", "turn", "n", "role", 300, 4)
    return points.select("conv_id", F.coalesce(F.get("points", F.lit(0)).cast("long"), F.lit(-1)).alias("point"))


@query("xs20_completion_kinds", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'insert' ELSE 'repeat' END AS kind FROM part")
def _(t, spark):
    current = F.when(F.col("p_size") % 2 == 0, "").otherwise(")")
    return t("part").select("p_partkey", E.completion_kinds(current, F.lit("call(x)")).alias("kind"))


@query("wn15_cut_at_suffix", "SELECT item_id, left(text, 40) AS head FROM benchmark WHERE length(text) >= 120 AND instr(text, substring(text, 41, 21)) = 41 AND NOT contains(substring(ltrim(substring(text, 41)), 1, 30), left(text, 20)) AND substring(text, 41, 1) <> ' '")
def _(t, spark):
    b = t("benchmark").filter((F.length("text") >= 120) & (F.instr("text", F.substring("text", 41, 21)) == 41) & (F.substring("text", 41, 1) != " "))
    b = b.filter(~F.contains(F.substring("text", 41, 30), F.left("text", F.lit(20))))
    # Other windows of the suffix may only occur at or after its start. The SQL's ltrim takes spaces alone: a suffix that starts with a newline keeps it.
    return b.select("item_id", T.cut_at_suffix(F.col("text"), F.substring("text", 41, 1000), blank=" ").alias("head"))


@query("wn15_cut_at_stops", "SELECT item_id, CASE WHEN contains(left(text, length(text) - 1), ' a') THEN left(text, instr(text, ' a') - 1) ELSE left(text, length(text) - 1) || replace(right(text, 1), ' a', '') END AS head FROM benchmark WHERE length(text) > 4")
def _(t, spark):
    return t("benchmark").filter(F.length("text") > 4).select("item_id", T.cut_at_stops(F.col("text"), [" a"]).alias("head"))


@query("sf04_highlighted", "SELECT p_partkey, '<span>' || left(p_type, 2) || '</span>' || substring(p_type, 3) AS shown FROM part")
def _(t, spark):
    return t("part").select("p_partkey", T.highlighted(F.col("p_type"), F.array(F.lit(0), F.lit(1))).alias("shown"))


@query("vs09_section_chunks")
def _(t, spark):
    turn = F.col("turn")
    line = F.when(turn % 3 == 1, F.concat(F.lit("# "), "role")).otherwise(F.col("text"))
    lines = t("conversations").select("conv_id", turn.alias("pos"), line.alias("line"))
    return E.chunked_sections(lines, S.markdown_sections(lines, "conv_id"), "conv_id")
