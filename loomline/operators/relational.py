"""Scans, filters, joins, set operations, sorting and paging over evaluation runs, catalogs and histories.

`now` is always a parameter. Sides of joins carry no broadcast hints: adaptive execution broadcasts what turns out small.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from loomline.functions.text import semver

TIMEFRAME_DAYS = {"24h": 1, "7d": 7, "30d": 30, "90d": 90}


# Scans


def with_metrics(rows: DataFrame, metrics: DataFrame, key: str, metrics_key: str, newest_first: str | None = None) -> DataFrame:
    """SC1, JN2: rows with their optional 1:1 metrics, newest first if asked."""
    out = rows.join(metrics, rows[key] == metrics[metrics_key], "left")
    return out.orderBy(F.desc(newest_first)) if newest_first else out


def find_one(rows: DataFrame, **keys) -> DataFrame:
    """SC2, SC3: the row of a (composite) key; an error if there is none."""
    found = rows
    for k, v in keys.items():
        found = found.filter(F.col(k) == v)
    found = found.limit(1)
    if found.isEmpty():
        raise LookupError(f"no row with {keys}")
    return found


def tasks_of(tasks: DataFrame, metrics: DataFrame, run_col: str, run_id, key: str, metrics_key: str, order: str) -> DataFrame:
    """SC4: a run's tasks with metrics, by ascending id."""
    return with_metrics(tasks.filter(F.col(run_col) == run_id), metrics, key, metrics_key).orderBy(order)


def failed_files(tasks: DataFrame, passed: Column, parts: list[str], suffix: str = ".log") -> DataFrame:
    """SC19: export paths of failed tasks (passed is false; unknown is not failed)."""
    return tasks.filter(~passed).withColumn("path", F.concat(F.concat_ws("/", *parts), F.lit(suffix)))


# Filters


def in_timeframe(rows: DataFrame, ts: str, timeframe: str, now: datetime) -> DataFrame:
    """FL1: rows at or after now less the timeframe; "all" keeps every row."""
    if timeframe == "all":
        return rows
    return rows.filter(F.col(ts) >= F.lit(now) - F.expr(f"INTERVAL {TIMEFRAME_DAYS[timeframe]} DAYS"))


def in_list(rows: DataFrame, value: Column, wanted: Iterable) -> DataFrame:
    """FL2, FL3: an empty list keeps every row; otherwise NULL fails."""
    wanted = list(wanted)
    return rows.filter(value.isin(wanted)) if wanted else rows


def incomplete(rows: DataFrame, col: str, keep: str) -> DataFrame:
    """FL4, FL16: keys of rows without a value."""
    return rows.filter(F.col(col).isNull()).select(keep)


def older_than(rows: DataFrame, ts: str, now: datetime, days: int = 30) -> DataFrame:
    """FL5: strictly older."""
    return rows.filter(F.col(ts) < F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))


def catalog_filter(items: DataFrame, type_: str | None = None, search: str = "", tags: Iterable[str] = (), separately: bool = False, installed: DataFrame | None = None, is_installed: bool | None = None, key: str = "id") -> DataFrame:
    """FL6, FL7: type, case-insensitive substring of name and description (joined, or each on its own), any tag, installed or not."""
    out = items
    if type_ is not None:
        out = out.filter(F.col("type") == type_)
    if search:
        low, name, about = search.lower(), F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
        out = out.filter(name.contains(low) | about.contains(low) if separately else F.concat_ws(" ", name, about).contains(low))
    if tags := list(tags):
        out = out.filter(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False)))
    if installed is not None and is_installed is not None:
        out = out.join(installed.select(key).distinct(), key, "left_semi" if is_installed else "left_anti")
    return out


def subscribed(events: DataFrame, name: str, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """FL8: an include list, an exclude list, or neither."""
    include, exclude = list(include), list(exclude)
    if include:
        return events.filter(F.col(name).isin(include))
    return events.filter(~F.col(name).isin(exclude)) if exclude else events


def task_status(passed: Column, started: Column, finished: Column) -> Column:
    """FL10: failed, passed, in_progress or not_started."""
    return F.when(passed.isNotNull() & ~passed, "failed").when(passed, "passed").when(started.isNotNull() & finished.isNull(), "in_progress").otherwise("not_started")


def merged_properties(base: Column, event: Column, private: Iterable[str] = (), allow: Column | None = None) -> Column:
    """FL9: property maps merged, the event's winning; private keys pass only where `allow` holds."""
    keep = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(event), k))
    merged = F.map_concat(keep, event)
    hidden = list(private)
    if not hidden:
        return merged
    public = F.map_filter(merged, lambda k, _: ~k.isin(hidden))
    return F.when(allow, merged).otherwise(public) if allow is not None else public


def valid_payload(payload: Column, keys: Iterable[str] = ("filePath", "codeChunk", "startLine", "endLine")) -> Column:
    """FL12: all keys are present; their values may be null. payload: a map."""
    out = payload.isNotNull()
    for k in keys:
        out = out & F.array_contains(F.map_keys(payload), k)
    return F.coalesce(out, F.lit(False))


def valid_snippet(content: Column, is_clipboard: Column, copied: Column, now: datetime) -> Column:
    """FL13: not blank, and not a clipboard entry of more than five minutes."""
    age = F.lit(now).cast("timestamp").cast("double") - copied.cast("timestamp").cast("double")
    return (F.regexp_replace(content, r"\s", "") != "") & ~(is_clipboard & (age > 300))


def sampled(rows: DataFrame, rate: float, seed: int) -> DataFrame:
    """FL14: a random share, its rate clamped to 0..1."""
    return rows.sample(min(1.0, max(0.0, rate)), seed)


# Joins


def hidden_by_parent(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """JN4: messages but those whose condenseParent is an existing summary or whose truncationParent is an existing marker."""
    summaries = messages.filter("isSummary and condenseId is not null").select(F.col(conv).alias("_c"), F.col("condenseId").alias("_i")).distinct()
    markers = messages.filter("isTruncationMarker and truncationId is not null").select(F.col(conv).alias("_c"), F.col("truncationId").alias("_i")).distinct()
    for parent, ids in (("condenseParent", summaries), ("truncationParent", markers)):
        messages = messages.join(ids, (F.col(conv) == F.col("_c")) & (F.col(parent) == F.col("_i")), "left_anti")
    return messages


def cleared_orphans(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """JN5: parents that no longer exist become NULL."""
    for parent, flag, ident in (("condenseParent", "isSummary", "condenseId"), ("truncationParent", "isTruncationMarker", "truncationId")):
        ids = messages.filter(f"{flag} and {ident} is not null").select(F.col(conv).alias("_c"), F.col(ident).alias("_i")).distinct()
        columns = messages.columns
        messages = messages.join(ids, (F.col(conv) == F.col("_c")) & (F.col(parent) == F.col("_i")), "left").withColumn(parent, F.when(F.col("_i").isNotNull(), F.col(parent))).select(columns)
    return messages


def released(messages: DataFrame, valid: Column, conv: str = "conv_id") -> DataFrame:
    """JN6: invalid summaries go; their children lose their parent."""
    bad = messages.filter(F.col("isSummary") & ~valid).select(F.col(conv).alias("_c"), F.col("condenseId").alias("_i")).distinct()
    columns = messages.columns
    kept = messages.filter(~(F.coalesce("isSummary", F.lit(False)) & ~valid))
    return kept.join(bad, (F.col(conv) == F.col("_c")) & (F.col("condenseParent") == F.col("_i")), "left").withColumn("condenseParent", F.when(F.col("_i").isNull(), F.col("condenseParent"))).select(columns)


def changed_files(files: DataFrame, cache: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """JN7: files whose digest is unknown or different."""
    old = cache.select(F.col(path).alias("_p"), F.col(digest).alias("_h"))
    return files.join(old, (F.col(path) == F.col("_p")) & F.col(digest).eqNullSafe(F.col("_h")), "left_anti")


def missing_files(cache: DataFrame, seen: DataFrame, path: str = "path") -> DataFrame:
    """JN8, SO2: cached paths that were not seen. Files too large to be read are not in `seen`, so they count as gone."""
    return cache.join(seen.select(path).distinct(), path, "left_anti")


def manifest_diff(old: DataFrame, new: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """JN9: path and action: upsert, skip or delete."""
    a, b = old.select(path, F.col(digest).alias("_old")), new.select(path, F.col(digest).alias("_new"), F.lit(True).alias("_is"))
    action = F.when(F.col("_is").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "skip").otherwise("upsert")
    return a.join(b, path, "full_outer").select(path, action.alias("action"))


def without_hidden(items: DataFrame, hidden: DataFrame, type_: str, key: str = "id") -> DataFrame:
    """JN10: items of one type that are hidden go; other types stay."""
    ids = hidden.select(F.col(key).alias("_h")).distinct()
    return items.join(ids, (F.col(key) == F.col("_h")) & (F.col("type") == type_), "left_anti")


def as_of(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """JN11, XS7: each left row with the right row's value of the latest time at or before its own.

    Both sides are merged in one window per key, so the cost is a sort, not a range join. Right columns must not be null in `right_ts`.
    """
    marked = left.select(F.col(by).alias("_by"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(None).cast(right.schema[right_ts].dataType).alias("_at"))
    other = right.filter(F.col(right_ts).isNotNull()).select(F.col(by).alias("_by"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast(marked.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"), F.col(right_ts).alias("_at"))
    before = Window.partitionBy("_by").orderBy("_ts", "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_side") == 0, F.struct("_value", "_at")), ignorenulls=True).over(before)
    return marked.unionByName(other).withColumn("_last", last).filter("_side = 1").select("_row.*", F.col("_last._value").alias(value), F.col("_last._at").alias(f"{value}_at"))


def as_of_version(queries: DataFrame, settings: DataFrame, query_version: str = "version", setting_version: str = "since", value: str = "value") -> DataFrame:
    """JN11: each query with the setting of the highest version not above its own; pre-release suffixes are ignored.

    Distinct versions, of which there are few, are merged with the settings in one window and joined back by equality: no pairs are tried.
    """
    versions = queries.select(F.col(query_version).alias("_q")).distinct().select("_q", F.lit(0).alias("_k"), semver(F.col("_q")).alias("_v"))
    known = settings.select(F.lit(0).alias("_k"), semver(F.col(setting_version)).alias("_s"), F.struct(F.col(setting_version).alias("since"), F.col(value).alias("value")).alias("_value"))
    hit = as_of(versions, known, "_k", "_v", "_s", "_value").select("_q", F.col("_value.value").alias(value), F.col("_value.since").alias("matched"))
    return queries.join(hit, F.col(query_version).eqNullSafe(F.col("_q")), "left").drop("_q")


def longest_prefix(queries: DataFrame, prefixes: DataFrame, text: str, prefix: str = "prefix") -> DataFrame:
    """JN12, JN15: the longest prefix of each text, ignoring case; `*` matches all texts with length 1; NULL if none. Repeated rows stay.

    Each distinct text is exploded into those of its beginnings whose lengths occur among the prefixes; these are joined by equality, and the best
    one per text is joined back.
    """
    p = prefixes.select(F.col(prefix).alias("_prefix"), F.lower(F.trim(prefix)).alias("_key")).distinct()
    sizes = p.filter("_key <> '*'").agg(F.sort_array(F.collect_set(F.length("_key"))).alias("_sizes"))
    low = F.lower(F.trim("_text"))
    q = queries.select(F.col(text).alias("_text")).filter("_text is not null").distinct().crossJoin(F.broadcast(sizes))  # one row
    q = q.select("_text", F.explode(F.array_append(F.transform(F.filter("_sizes", lambda n: n <= F.length(low)), lambda n: F.substring(low, F.lit(1), n)), F.lit("*"))).alias("_key"))
    best = F.max(F.struct(F.when(F.col("_key") == "*", 1).otherwise(F.length("_key")).alias("n"), F.col("_key") != "*", F.col("_prefix").alias("p")))
    hit = q.join(p, "_key").groupBy("_text").agg(best.alias("_best"))
    return queries.join(hit, F.col(text) == F.col("_text"), "left").select(*queries.columns, F.col("_best.p").alias("matched"), F.col("_best.n").alias("matched_length"))


def approval(commands: DataFrame, allowed: DataFrame, denied: DataFrame, text: str) -> DataFrame:
    """JN13: approve if the allowed prefix is strictly longer than the denied one; deny if only denied or not shorter; else ask."""
    a = longest_prefix(commands, allowed, text).withColumnsRenamed({"matched": "allowed", "matched_length": "allowed_length"})
    both = longest_prefix(a, denied, text).withColumnsRenamed({"matched": "denied", "matched_length": "denied_length"})
    decision = F.when(F.col("allowed").isNotNull() & (F.col("denied").isNull() | (F.col("allowed_length") > F.col("denied_length"))), "approve").when(F.col("denied").isNotNull(), "deny").otherwise("ask")
    return both.withColumn("decision", decision)


def suggestion(requests: DataFrame, history: DataFrame) -> DataFrame:
    """JN14: the latest suggestion that fits: same prefix and suffix; typed part of it; or its prefix was shortened from the end.

    requests: req, prefix, suffix. history: seq, prefix, suffix, text. A suggestion fits a request if the request's prefix begins what the
    suggestion's prefix and text make together, and what is left of that is the answer. So each is exploded into those of its beginnings
    whose lengths occur among requests, the latest per beginning is kept, and requests are joined by equality.
    """
    sizes = requests.agg(F.collect_set(F.length("prefix")).alias("_sizes"))
    known = history.select("seq", "suffix", "text", F.length("prefix").alias("_own"), F.concat("prefix", "text").alias("_whole")).crossJoin(F.broadcast(sizes))  # one row
    fits = F.filter("_sizes", lambda n: (n == F.col("_own")) | ((F.col("text") != "") & (n > 0) & (n <= F.length("_whole"))))
    each = known.select("seq", "suffix", "_own", "_whole", F.explode(fits).alias("_n")).withColumn("prefix", F.substring("_whole", F.lit(1), F.col("_n")))
    kind = F.when(F.col("_n") == F.col("_own"), "exact").when(F.col("_n") > F.col("_own"), "typing").otherwise("deletion")
    rest = F.substring("_whole", F.col("_n") + 1, F.length("_whole"))
    latest = each.groupBy("suffix", "prefix").agg(F.max_by(F.struct(kind.alias("kind"), rest.alias("suggestion")), "seq").alias("_hit"))
    return requests.join(latest, ["suffix", "prefix"]).select("req", "_hit.kind", "_hit.suggestion")


def tool_result_check(uses: DataFrame, results: DataFrame, conv: str = "conv_id") -> DataFrame:
    """JN16: per tool id: ok, missing (a use without result), invalid (a result without use) or duplicate (several results)."""
    u = uses.select(conv, F.col("tool_use_id").alias("id")).distinct().withColumn("_u", F.lit(True))
    r = results.groupBy(conv, F.col("tool_use_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("_u").isNull(), "invalid").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return u.join(r, [conv, "id"], "full_outer").select(conv, "id", state.alias("state"))


def tool_use_before(results: DataFrame, uses: DataFrame, span: int = 3, conv: str = "conv_id") -> DataFrame:
    """JN17: for each kept tool result the latest tool use of its id within `span` earlier messages; NULL if there is none."""
    u = uses.select(F.col(conv).alias("_c"), F.col("tool_use_id").alias("_id"), F.col("seq").alias("use_seq"))
    j = results.join(u, (F.col(conv) == F.col("_c")) & (F.col("tool_use_id") == F.col("_id")) & F.col("use_seq").between(F.col("seq") - span, F.col("seq") - 1), "left")
    return j.groupBy(conv, "seq", "tool_use_id").agg(F.max("use_seq").alias("use_seq"))


def merged_ranges(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """JN18: overlapping ranges of a key as one: gaps and islands over a running maximum."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reached.isNull() | (F.col(start) > reached), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*by, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")


def range_intersections(a: DataFrame, b: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """JN19: the common part of overlapping ranges of one key. Positions may be numbers or (line, character) structs.

    Numbers are dealt into bins as wide as the mean range, so a key's ranges meet only those near them; a pair is made in the bin where the
    later one starts. Structs are joined on the key alone.
    """
    other = b.select(F.col(by).alias("_by"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    overlap = (F.col(by) == F.col("_by")) & (F.col(start) <= F.col("_e")) & (F.col("_s") <= F.col(end))
    common = [F.col(by), F.greatest(start, "_s").alias("start"), F.least(end, "_e").alias("end")]
    if not isinstance(a.schema[start].dataType, NumericType):
        return a.join(other, overlap).select(*common)
    sizes = [x.agg(F.sum(F.greatest(F.col(e) - F.col(s), F.lit(0)).cast("double")), F.count(F.lit(1))).first() for x, s, e in ((a, start, end), (other, "_s", "_e"))]
    width = max(1.0, sum(x[0] or 0.0 for x in sizes) / max(1, sum(x[1] for x in sizes)))
    bin_ = lambda c: F.floor(F.col(c) / F.lit(width))
    bins = lambda s, e: F.explode(F.sequence(bin_(s), F.greatest(bin_(s), bin_(e))))
    left = a.select(by, start, end, bins(start, end).alias("_bin"))
    right = other.select("_by", "_s", "_e", bins("_s", "_e").alias("_at"))
    return left.join(right, overlap & (F.col("_bin") == F.col("_at")) & (F.col("_bin") == F.greatest(bin_(start), bin_("_s")))).select(*common)


def enriched(rows: DataFrame, dimension: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """JN20: own values, else those of the dimension."""
    columns = list(columns)
    d = dimension.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(d, F.col(key) == F.col("_k"), "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])


# Sets, sorting, paging


def concatenated(*tables: DataFrame) -> DataFrame:
    """SO1, VS5: all rows of all tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def symbol_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """SO3: sizes of the intersection and union of two arrays."""
    return F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))


def git_changes(lines: DataFrame, line: str = "line") -> DataFrame:
    """SO4: name-status lines as (path, change): renames delete the old path and add the new one, copies add."""
    p = F.split(line, "\t")
    code = F.substring(p[0], 1, 1)
    one = lambda path, change: F.array(F.struct(path.alias("path"), F.lit(change).alias("change")))
    made = F.when(code == "A", one(p[1], "add")).when(code == "M", one(p[1], "modify")).when(code == "D", one(p[1], "delete")).when(code == "R", F.concat(one(p[1], "delete"), one(F.get(p, F.lit(2)), "add"))).when(code == "C", one(F.get(p, F.lit(2)), "add"))
    return lines.select(F.explode(made).alias("c")).select("c.*")


def sorted_runs(runs: DataFrame, key: str, descending: bool = True, tie: str = "id") -> DataFrame:
    """SL1: by a column or by percent = passed / (passed + failed), 0 where nothing ran; NULL metrics count as 0."""
    of = F.coalesce(F.try_divide(F.col("passed") * 100.0, F.col("passed") + F.col("failed")), F.lit(0.0)) if key == "percent" else F.coalesce(F.col(key), F.lit(0)) if dict(runs.dtypes)[key] != "string" else F.lower(F.col(key))
    return runs.withColumn("sort_key", of).orderBy(F.desc("sort_key") if descending else F.asc("sort_key"), tie)


def history_page(items: DataFrame, order: list[Column], page: int, size: int = 10, where: Column | None = None) -> DataFrame:
    """SL2: a page of matching rows, the page index clamped to the last; with page_index, page_count and total.

    Pages are cut after a global rank, which numbers rows per partition of a range sort rather than in one window.
    """
    rows = items.filter(where) if where is not None else items
    total = rows.count()
    pages = -(-total // size)
    at = max(0, min(page, pages - 1))
    picked = rows.orderBy(*order).offset(at * size).limit(size)
    return picked.withColumns({"page_index": F.lit(at), "page_count": F.lit(pages), "total": F.lit(total).cast("long")})


def leaderboard(runs: DataFrame, finished: Column, valid: Column) -> DataFrame:
    """SL3: finished, valid runs with a whole-percent score (NULL if nothing ran), most passed first."""
    return runs.filter(finished & valid).withColumn("score", F.round(F.try_divide(F.col("passed") * 100.0, F.col("passed") + F.col("failed")))).orderBy(F.desc("passed"))


def axis_domain(rows: DataFrame, value: str, step: int = 5) -> DataFrame:
    """SL4: axis bounds: the least and greatest value rounded outwards to a step."""
    return rows.agg((F.floor(F.min(value) / step) * step).cast("long").alias("low"), (F.ceil(F.max(value) / step) * step).cast("long").alias("high"))


def preferred_first(items: DataFrame, preferred: list[str], key: str) -> DataFrame:
    """SL6: preferred ids by their index, the rest by name."""
    index = F.when(F.col(key).isin(preferred), F.array_position(F.array(*map(F.lit, preferred)), F.col(key))) if preferred else F.lit(None).cast("long")
    return items.withColumn("preferred", index).orderBy(F.col("preferred").isNull(), "preferred", key)


def newest(rows: DataFrame, ts: str, most: int = 100, tie: str = "id") -> DataFrame:
    """SL7, SL5: the newest rows, oldest first: what a bounded queue still holds."""
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(most).orderBy(ts, tie)
