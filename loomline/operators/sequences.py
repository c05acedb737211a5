"""Operators over ordered rows: windows, islands, folds. All take an explicit order column."""

from __future__ import annotations

import json
from collections.abc import Iterable
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import trimmed
from loomline.session import kept

OUTPUT_MARK = "Output:"


def lines_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """A row per line: key, pos from 0, line."""
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


# Operators over a text's own lines work on the array of them, in the row that holds it: nothing is exploded, shuffled or collected again.
# `lines` is the name of an array column. What a lambda captures may be evaluated for each element, so neighbours, places and limits are zipped to
# the elements instead of looked up from inside.


def joined_lines(lines: Column) -> Column:
    """WN14: lines with newlines between."""
    return F.array_join(lines, "\n")


def with_runs(rows: DataFrame, lines: str, out: str = "_runs") -> DataFrame:
    """Runs of equal neighbours of an array column, as structs: line, begin, end (exclusive), last (whether it is the last run)."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))))
    pairs = F.zip_with(lines, before, lambda x, y: F.struct(x.alias("line"), (~x.eqNullSafe(y)).alias("opens")))
    heads = F.filter(F.transform(pairs, lambda p, i: F.struct(p["line"].alias("line"), i.alias("begin"), p["opens"].alias("opens"))), lambda h: h["opens"])
    rows = rows.withColumn("_heads", heads)
    n = F.size("_heads")
    ends = F.concat(F.transform(F.slice("_heads", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda h: F.struct(h["begin"].alias("end"), F.lit(False).alias("last"))), F.array_repeat(F.struct(F.size(lines).alias("end"), F.lit(True).alias("last")), F.least(n, F.lit(1))))
    return rows.withColumn(out, F.zip_with("_heads", ends, lambda h, e: F.struct(h["line"].alias("line"), h["begin"].alias("begin"), e["end"].alias("end"), e["last"].alias("last")))).drop("_heads")


def time_to_next(messages: DataFrame, by: str, ts: str, order: str) -> DataFrame:
    """WN1: milliseconds to the next message, not below zero, NULL on the last; and that as a share of the greatest of its key."""
    w, every = Window.partitionBy(by).orderBy(order), Window.partitionBy(by)
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    gap = F.greatest(F.lit(0), ms(F.lead(ts).over(w)) - ms(F.col(ts)))
    gap = F.when(F.lead(ts).over(w).isNotNull(), gap)
    return messages.withColumn("gap", gap).withColumn("share", F.try_divide(F.col("gap").cast("double"), F.max("gap").over(every)))


def debounce_delay(samples: DataFrame, by: str, order: str, value: str, size: int = 10, low: int = 150, high: int = 1000) -> DataFrame:
    """WN2: the rounded mean of the last `size` samples, within bounds; NULL until there are as many."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(size - 1), 0)
    mean = F.floor(F.avg(value).over(w) + 0.5)
    return samples.withColumn("delay", F.when(F.count(F.lit(1)).over(w) == size, F.least(F.lit(high), F.greatest(F.lit(low), mean))).cast("long"))


def islands(rows: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
    """Runs of equal neighbours: _island numbers them per key, _run counts from 1 inside."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = rows.withColumn("_v", value)
    marked = marked.withColumn("_new", (~F.lag("_v").over(w).eqNullSafe(F.col("_v")) | (F.row_number().over(w) == 1)).cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("_run", F.row_number().over(Window.partitionBy(*by, "_island").orderBy(order))).drop("_v", "_new")


def repetition_limit(calls: DataFrame, by: str, order: str, call: Column, limit: int = 3, exempt: Column | None = None) -> DataFrame:
    """WN3: blocks the call after `limit` identical ones, then begins to count anew; 0 is no limit. Exempt calls are no part of a run."""
    counted = calls.filter(~exempt) if exempt is not None else calls
    out = islands(counted, [by], order, call).withColumn("blocked", F.lit(limit > 0) & (F.col("_run") % (limit + 1) == 0) if limit > 0 else F.lit(False)).drop("_island", "_run")
    return out if exempt is None else out.unionByName(calls.filter(exempt).withColumn("blocked", F.lit(False)))


def logged_once(messages: DataFrame, by: list[str], order: str, payload: str) -> DataFrame:
    """WN4: messages that differ from the last one of their key."""
    w = Window.partitionBy(*by).orderBy(order)
    return messages.withColumn("_same", F.lag(payload).over(w).eqNullSafe(F.col(payload)) & (F.row_number().over(w) > 1)).filter(~F.col("_same")).drop("_same")


def encode_runs(text: str | None) -> str | None:
    """WN7 on one text: its repeated lines as one and a note, where that is shorter. Inside a text the note is compared with all copies, at its end with
    all but one."""
    if text is None:
        return None
    *ended, last = text.split("\n")
    runs = [(line, sum(1 for _ in copies)) for line, copies in groupby([x + "\n" for x in ended] + [last] * (last != ""))]
    out = []
    for i, (line, n) in enumerate(runs):
        note = f"<previous line repeated {n - 1} additional times>\n" if n > 1 else ""
        out.append(line + note if note and len(note) < len(line) * (n - (i == len(runs) - 1)) else line * n)
    return "".join(out)


def run_length_encoded(text: Column) -> Column:
    """WN7 as a column, in Arrow batches: a fold over lines is cheaper there than in nested lambdas."""
    return F.udf(encode_runs, "string", useArrow=True)(text)


def before_first(lines: str, stop) -> Column:
    """The lines before the first one for which stop(line, place) holds."""
    at = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(stop(x, i), i)), lambda i: i.isNotNull()))
    return F.slice(lines, F.lit(1), F.coalesce(at, F.size(lines)))


def stop_at_repeats(rows: DataFrame, lines: str, most: int = 3, out: str = "kept") -> DataFrame:
    """WN8: (pos, line) up to the `most`-th equal line in a row; of repeats only the first."""
    rows = with_runs(rows, lines)
    long = F.transform("_runs", lambda r: F.when(r["end"] - r["begin"] >= most, r["begin"]))
    cut = F.coalesce(F.array_min(long), F.size(lines))
    marked = F.zip_with("_runs", F.array_repeat(cut, F.size("_runs")), lambda r, c: F.struct(r["begin"].alias("pos"), r["line"].alias("line"), (r["begin"] <= c).alias("stays")))
    return rows.withColumn(out, F.transform(F.filter(marked, lambda m: m["stays"]), lambda m: F.struct(m["pos"].alias("pos"), m["line"].alias("line")))).drop("_runs")


def stop_at_blank(lines: str) -> Column:
    """WN9: the lines up to the first blank one after the first."""
    return before_first(lines, lambda x, i: (i > 0) & (trimmed(x) == ""))


def taken_while(lines: DataFrame, key: str, stop: Column) -> DataFrame:
    """Lines before the first one that `stop` holds for."""
    before = F.max(F.coalesce(stop, F.lit(False))).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_stop", before).filter(~F.col("_stop")).drop("_stop")


def stop_at_lines(lines: DataFrame, key: str, stops: Iterable[str], exact: bool = False) -> DataFrame:
    """WN10: up to a stop line: equal to one, or holding one outside quotes and not inside a longer word."""
    hit = F.lit(False)
    for s in stops:
        at = F.instr("line", s)
        before = F.when(at > 1, F.substring("line", at - 1, F.lit(1))).otherwise("")
        after = F.substring("line", at + len(s), F.lit(1))
        hit = hit | ((trimmed(F.col("line")) == s) if exact else (at > 0) & ~before.rlike("[\"'`\\w]") & ~after.rlike("[\"'`\\w]"))
    return taken_while(lines, key, hit)


def lines_repeat(a: Column, b: Column) -> Column:
    """TX9: both longer than four characters, and fewer edits than a tenth of the second's length."""
    x, y = trimmed(a), trimmed(b)
    return (F.length(x) > 4) & (F.length(y) > 4) & (F.levenshtein(x, y) / F.length(y) < 0.1)


def repeated_pairs(rows: DataFrame, by: list[str], key: str, line: str, other: str = "other") -> DataFrame:
    """TX9: (key, other) of rows of one group whose lines repeat, the lesser key first. Different lines of a group are compared once, however many
    rows hold them, and rows are paired by equality with what was found."""
    group = [F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]
    own = [f"_b{i}" for i in range(len(by))]
    held = rows.select(*group, F.col(line).alias("_x"), F.col(key))
    one = held.filter(F.length("_x") > 4).select(*own, "_x").distinct()
    close = one.join(one.withColumnRenamed("_x", "_y"), own).filter(lines_repeat(F.col("_x"), F.col("_y")))
    first = held.join(close, [*own, "_x"])
    return first.join(held.withColumnsRenamed({"_x": "_y", key: other}), [*own, "_y"]).filter(F.col(key) < F.col(other)).select(key, other)


def stop_at_similar(lines: DataFrame, key: str, line: str) -> DataFrame:
    """WN11: up to a line like the given one; lines that only close a bracket must be equal to it and be preceded by none such."""
    text = trimmed(F.col("line"))
    closing = F.lit(line.strip()).rlike(r"^[\])}]+[;,]?$")
    return taken_while(lines, key, F.when(closing, F.lit(False)).otherwise((text == line.strip()) | lines_repeat(F.col("line"), F.lit(line))))


def without_path_lines(lines: DataFrame, path: str, comment: str = "//") -> DataFrame:
    """WN12: no comments that only name the path, and no empty comments."""
    text = trimmed(F.col("line"))
    return lines.filter(~text.isin(f"{comment} Path: {path}", f"{comment} {path}") & (text != comment))


def without_prefixes(lines: DataFrame, key: str, prefixes: Iterable[str] = ("<COMPLETION>",)) -> DataFrame:
    """WN13: strips a prefix from leading lines for as long as lines have one."""
    has, cut = F.lit(False), F.col("line")
    for p in prefixes:
        own = F.startswith("line", F.lit(p))
        has, cut = has | own, F.when(own, F.substring("line", len(p) + 1, 1 << 30)).otherwise(cut)
    leading = F.min(F.when(~has, F.col("pos"))).over(Window.partitionBy(key))
    return lines.withColumn("line", F.when(F.coalesce(F.col("pos") < leading, F.lit(True)), cut).otherwise(F.col("line")))


def lines_of_chunks(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """WN17: the lines of a text that came in chunks."""
    whole = chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("text"))
    return lines_of(whole, key, "text")


def markdown_sections(lines: DataFrame, key: str) -> DataFrame:
    """WN18: headers with their last line: up to the next header or the end. ATX headers, and setext ones by their underline."""
    w = Window.partitionBy(key).orderBy("pos")
    under = F.lead("line").over(w)
    atx = F.col("line").rlike(r"^#{1,6}\s+\S")
    setext = (trimmed(F.col("line")) != "") & ~atx & under.rlike(r"^(={3,}|-{3,})\s*$")
    level = F.when(atx, F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))).when(setext, F.when(F.startswith(under, F.lit("=")), 1).otherwise(2))
    title = F.when(atx, trimmed(F.regexp_replace("line", r"^#{1,6}\s+", ""))).otherwise(trimmed(F.col("line")))
    heads = lines.withColumn("level", level).withColumn("title", title).withColumn("_n", F.max("pos").over(Window.partitionBy(key))).filter("level is not null")
    return heads.select(key, "title", "level", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(w) - 1, F.col("_n")).alias("end"))


def section_outline(sections: DataFrame, least: int = 4) -> DataFrame:
    """WN19: sections of some lines as "start--end | ## title"."""
    return sections.filter(F.col("end") - F.col("start") + 1 >= least).withColumn("outline", F.format_string("%d--%d | %s %s", F.col("start") + 1, F.col("end") + 1, F.expr("repeat('#', level)"), F.col("title")))


def diff_line_numbers(lines: DataFrame, key: str) -> DataFrame:
    """WN20: kind, old and new number of each line of a unified diff; a gap before each further hunk."""
    head = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_h", F.sum(F.col("line").rlike(head).cast("int")).over(w)).filter("_h > 0")
    start = lambda i: F.first(F.regexp_extract("line", head, i).try_cast("int")).over(Window.partitionBy(key, "_h").orderBy("pos"))
    first = F.substring("line", 1, 1)
    kind = F.when(F.col("line").rlike(head), "hunk").when(first == "+", "addition").when(first == "-", "deletion").when(first == "\\", "note").otherwise("context")
    rows = rows.withColumn("kind", kind).withColumn("_o", start(1)).withColumn("_n", start(2))
    inside = Window.partitionBy(key, "_h").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda *k: F.coalesce(F.sum(F.col("kind").isin(*k).cast("int")).over(inside), F.lit(0))
    return rows.select(
        key, "pos", F.when((F.col("kind") == "hunk") & (F.col("_h") > 1), "gap").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("kind").isin("context", "deletion"), F.col("_o") + count("context", "deletion")).alias("old"),
        F.when(F.col("kind").isin("context", "addition"), F.col("_n") + count("context", "addition")).alias("new"), F.substring("line", 2, 1 << 30).alias("text"),
    ).filter("kind not in ('hunk', 'note')")


def log_elapsed(lines: DataFrame, key: str, pattern: str = r"\[(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?Z?)") -> DataFrame:
    """WN21: seconds since the first timestamp of the log, and the line without its stamp and bracketed tags."""
    ts = F.regexp_extract("line", pattern, 1).try_cast("timestamp")
    rows = lines.withColumn("_ts", ts)
    first = F.first("_ts", ignorenulls=True).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("elapsed", (F.unix_millis("_ts") - F.unix_millis(first)) / 1000.0).withColumn("message", F.regexp_replace("line", r"^(?:\[[^\]]*\]\s*)+", "")).drop("_ts")


def counted(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a number from 1, without gaps, in the order in which they lie: each partition is numbered alone, after what the ones before it
    hold, of which there is one number per partition.

    Rows and sizes are read from one stored copy: a sort that is run for each of them may cut its partitions at other places.
    """
    rows = kept(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1)  # the lower bits count inside the partition
    return rows.join(F.broadcast(before), "_part").withColumn(name, place + 1 + F.col("_before")).drop("_part", "_at", "_before")


def numbered(rows: DataFrame, order: list[str], by: str | None = None) -> DataFrame:
    """WN22: each row's index in the whole order, kept when rows are grouped; numbered per key where one is given."""
    if by:
        return rows.withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    return counted(rows.orderBy(*order), "index").withColumn("index", F.col("index") - 1)


def rewound(messages: DataFrame, by: str, cutoffs: DataFrame, inclusive: bool = False) -> DataFrame:
    """WN24: the history before a timestamp; if no message has it and earlier ones exist, before the first user message at or after it.

    messages: by, seq, ts, role. cutoffs: by, cutoff.
    """
    m = messages.join(cutoffs, by)
    every = Window.partitionBy(by)
    exact = F.max((F.col("ts") == F.col("cutoff")).cast("int")).over(every) == 1
    earlier = F.max((F.col("ts") < F.col("cutoff")).cast("int")).over(every) == 1
    user = F.min(F.when((F.col("role") == "user") & (F.col("ts") >= F.col("cutoff")), F.col("ts"))).over(every)
    at = F.when(~exact & earlier & user.isNotNull(), user).otherwise(F.col("cutoff"))
    return m.withColumn("_at", at).filter(F.col("ts") <= F.col("_at") if inclusive else F.col("ts") < F.col("_at")).drop("_at", "cutoff")


def since_summary(messages: DataFrame, by: str = "conv_id", order: str = "seq") -> DataFrame:
    """WN25: messages from the last summary on, after the first user message where that one isn't among them; all where there is no summary."""
    every = Window.partitionBy(by)
    last = F.max(F.when(F.col("isSummary"), F.col(order))).over(every)
    first_user = F.min(F.when(F.col("role") == "user", F.col(order))).over(every)
    rows = messages.withColumn("_last", last).withColumn("_user", first_user)
    return rows.filter(F.col("_last").isNull() | (F.col(order) >= F.col("_last")) | (F.col(order) == F.col("_user"))).drop("_last", "_user")


# Folds over the messages of one task: their state has no bound that a window could express.


def _folded(messages: DataFrame, fold, by: str) -> DataFrame:
    schema = messages.schema

    def run(t: pd.DataFrame) -> pd.DataFrame:
        rows = t.sort_values("seq").to_dict("records")
        return pd.DataFrame(fold(rows), columns=schema.names)

    return messages.groupBy(by).applyInPandas(run, schema)


def _parsed(text) -> dict:
    try:
        got = json.loads(text) if isinstance(text, str) and text else {}
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def fold_requests(rows: list[dict]) -> list[dict]:
    """WN5 on one task. A lone message is returned as it is."""
    if len(rows) < 2:
        return rows
    out, open_ = [], []
    for r in rows:
        if r["type"] == "say" and r["say"] == "api_req_started":
            open_.append(len(out))
            out.append(dict(r))
        elif r["type"] == "say" and r["say"] == "api_req_finished":
            if open_:
                at = open_.pop()
                out[at]["text"] = json.dumps({**_parsed(out[at]["text"]), **_parsed(r["text"])}, separators=(",", ":"), ensure_ascii=False)
        else:
            out.append(r)
    return out


def paired_requests(messages: DataFrame, by: str = "task_id") -> DataFrame:
    """WN5: each finished request merged into the nearest open one before it, the finish's keys winning; finishes without a start go."""
    return _folded(messages, fold_requests, by)


def _is_output(r: dict) -> bool:
    return r["ask"] == "command_output" or r["say"] == "command_output"


def fold_commands(rows: list[dict]) -> list[dict]:
    """WN6 on one task: one walk, in which each command and each server request gathers what follows up to the next of its kind."""
    merged: dict[int, str] = {}
    ends = {kind: _next_places([r["type"] == "ask" and r["ask"] == kind for r in rows]) for kind in ("command", "use_mcp_server")}
    skip_to = 0
    for i, r in enumerate(rows):
        if i < skip_to or r["type"] != "ask" or r["ask"] not in ends:
            continue
        after = range(i + 1, ends[r["ask"]][i])
        if r["ask"] == "use_mcp_server":
            if answers := [rows[k]["text"] or "" for k in after if rows[k]["say"] == "mcp_server_response"]:
                merged[i] = json.dumps({**_parsed(r["text"]), "response": "\n".join(answers)}, separators=(",", ":"), ensure_ascii=False)
            continue
        outputs = [k for k in after if _is_output(rows[k])]
        body, last = "", None
        for kind, said in ((rows[k]["type"], rows[k]["text"] or "") for k in outputs):
            # The same output asked and said in turn counts once.
            if said and not (last and last[0] != kind and last[1] == said):
                body += ("\n" if last and body else "") + said
            last = (kind, said)
        merged[i] = (r["text"] or "") + (f"\n{OUTPUT_MARK}{body}" if outputs else "")
        # What lies between a command and its last output is passed over.
        skip_to = outputs[-1] + 1 if outputs else skip_to
    gone = lambda r: _is_output(r) or r["say"] == "mcp_server_response"
    return [{**r, "text": merged.get(i, r["text"])} for i, r in enumerate(rows) if not gone(r)]


def _next_places(flags: list[bool]) -> list[int]:
    """For each place the next one, after it, whose flag is set; else the end."""
    out, at = [0] * len(flags), len(flags)
    for i in range(len(flags) - 1, -1, -1):
        out[i] = at
        at = i if flags[i] else at
    return out


def folded_commands(messages: DataFrame, by: str = "task_id") -> DataFrame:
    """WN6: commands with their outputs, server requests with their responses. Merged by position, so equal timestamps do no harm."""
    return _folded(messages, fold_commands, by)


def timeline(messages: DataFrame, shown: Iterable[str], by: str = "task_id") -> DataFrame:
    """WN23: the log without its first message, folded, kept kinds only, each with the index it had."""
    w = Window.partitionBy(by).orderBy("seq")
    rows = messages.withColumn("index", F.row_number().over(w) - 1).filter("index > 0")
    folded = paired_requests(folded_commands(rows, by), by)
    return folded.filter(F.coalesce("ask", "say").isin(list(shown)))


def history_scd(entries: DataFrame, by: list[str], order: str, carried: list[str]) -> DataFrame:
    """XS8: each new entry makes the one before it stale and carries the latest known dates on."""
    w = Window.partitionBy(*by).orderBy(order)
    out = entries.withColumn("state", F.when(F.lead(order).over(w).isNull(), "active").otherwise("stale"))
    for c in carried:
        out = out.withColumn(c, F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out


def merged_logs(old: DataFrame, new: DataFrame, key: str = "ts", by: list[str] | None = None) -> DataFrame:
    """XS4: rows of both logs by their key, the incoming ones winning, in order; a log of each `by`, where it is given."""
    keys = [*(by or []), key]
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    columns = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_p").alias("_r")).select(*keys, "_r.*").orderBy(*keys)


def recent(items: DataFrame, by: str, ts: str, now: Column, most: int = 100, days: int = 7, tie: str = "id") -> DataFrame:
    """XS5: per workspace the rows of the last days if there are `most` such, else the newest `most`."""
    every = Window.partitionBy(by)
    fresh = F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS")
    rows = items.withColumn("_n", F.count_if(fresh).over(every)).withColumn("_r", F.row_number().over(every.orderBy(F.desc(ts), F.desc(tie)))).withColumn("_f", fresh)
    return rows.filter(F.when(F.col("_n") >= most, F.col("_f")).otherwise(F.col("_r") <= most)).drop("_n", "_r", "_f")


def top_of_recent(visits: DataFrame, key: str, ts: str, files: int = 3, each: int = 3, current: str | None = None) -> DataFrame:
    """XS9: the latest visits of the files visited last, the current file left out."""
    rows = visits.filter(F.col(key) != current) if current is not None else visits
    latest = rows.groupBy(key).agg(F.max(ts).alias("_m")).orderBy(F.desc("_m"), key).limit(files)
    ranked = rows.join(latest, key).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts))))
    return ranked.filter(F.col("_r") <= each).drop("_r", "_m")


def last_users(messages: DataFrame, by: str, order: str, most: int = 2) -> DataFrame:
    """XS13: the last user messages of each conversation."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return messages.filter("role = 'user'").withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def dedented(lines: str) -> Column:
    """XS19: lines less the least indentation of those that aren't blank."""
    indents = F.transform(lines, lambda x: F.when(trimmed(x) != "", F.length(F.regexp_extract(x, r"^([ \t]*)", 1))))
    least = F.coalesce(F.array_min(F.filter(indents, lambda n: n.isNotNull())), F.lit(0))
    # zip_with carries the least indentation to each line, so that it is found once.
    return F.zip_with(lines, F.array_repeat(least, F.size(lines)), lambda x, n: F.substring(x, n + 1, F.length(x)))
