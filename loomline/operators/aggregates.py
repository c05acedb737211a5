"""Aggregations over runs, tool usage, token logs and task trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.session import kept

TOKEN_SUMS = ("tokens_in", "tokens_out", "tokens_context", "cache_writes", "cache_reads", "cost", "duration")


def run_totals(tasks: DataFrame, metrics: DataFrame, run_col: str, metrics_key: str, key: str, sums: tuple[str, ...] = TOKEN_SUMS, passed: str = "passed") -> DataFrame:
    """AG1, JN1: sums of a run's metrics; a task without a verdict counts as failed."""
    return tasks.join(metrics, tasks[key] == metrics[metrics_key]).groupBy(run_col).agg(*[F.sum(c).alias(c) for c in sums], F.count_if(F.col(passed)).alias("passed"), F.count_if(~F.coalesce(F.col(passed), F.lit(False))).alias("failed"))


def language_scores(tasks: DataFrame, run_col: str, language: str, passed: str, languages: list[str]) -> DataFrame:
    """AG2, JN21: per run the share of passed tasks in each language; tasks without a verdict count in the denominator, missing languages as 0."""
    score = F.sum(F.coalesce(F.col(passed).cast("int"), F.lit(0))).cast("double") / F.count(F.lit(1))
    return tasks.groupBy(run_col).pivot(language, languages).agg(score).na.fill(0.0, languages)


def merged_usage(rows: DataFrame, by: list[str], usage: str = "tool_usage", how: str = "sum") -> DataFrame:
    """AG3 (sum), AG4 (max): maps of tool to (attempts, failures), merged per key, as rows."""
    f = {"sum": F.sum, "max": F.max}[how]
    return rows.select(*by, F.explode(usage).alias("tool", "_u")).groupBy(*by, "tool").agg(f("_u.attempts").alias("attempts"), f("_u.failures").alias("failures"))


def usage_map(rows: DataFrame, by: list[str]) -> DataFrame:
    """AG3: rows of tools back to one map per key, tools in order."""
    entry = F.struct("tool", F.struct("attempts", "failures").alias("usage"))
    return rows.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tool_usage"))


def run_stats(tasks: DataFrame, run_col: str, passed: str, finished: Column) -> DataFrame:
    """AG5: strict counts: only a false verdict fails; the rate is NULL where nothing is completed."""
    done = F.count_if(F.col(passed).isNotNull())
    return tasks.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(passed)).alias("passed"), F.count_if(~F.col(passed)).alias("failed"), done.alias("completed"),
        (F.count(F.lit(1)) - done).alias("remaining"), F.try_divide(F.count_if(F.col(passed)) * 100.0, done).alias("pass_rate"), F.count_if(finished).alias("finished"),
    )


def token_usage(messages: DataFrame, by: str = "task_id") -> DataFrame:
    """AG6, AG7: totals of a message log. Bad JSON is skipped; cache totals stay NULL until a number is seen; context is the last that is known."""
    request = (F.col("type") == "say") & (F.col("say") == "api_req_started")
    condense = (F.col("type") == "say") & (F.col("say") == "condense_context")
    num = lambda f: F.when(request, F.get_json_object("text", f"$.{f}").try_cast("double"))
    valid = F.try_parse_json("text").isNotNull()
    tin, tout = num("tokensIn"), num("tokensOut")
    size = F.when(request & valid, F.coalesce(tin, F.lit(0.0)) + F.coalesce(tout, F.lit(0.0))).when(condense, F.coalesce(F.col("contextCondense.newContextTokens").cast("double"), F.lit(0.0)))
    cost = F.when(request, num("cost")).when(condense, F.col("contextCondense.cost"))
    whole = lambda c: F.sum(c).cast("long")
    return messages.groupBy(by).agg(
        F.coalesce(whole(tin), F.lit(0)).alias("tokens_in"), F.coalesce(whole(tout), F.lit(0)).alias("tokens_out"), whole(num("cacheWrites")).alias("cache_writes"), whole(num("cacheReads")).alias("cache_reads"),
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"), F.coalesce(F.max_by(F.when(size > 0, size), F.when(size > 0, F.col("seq"))).cast("long"), F.lit(0)).alias("context_tokens"),
    )


def tree_cost(spark: SparkSession, view: str, id_: str, parent: str, cost: str, roots: str, few: int = 250_000) -> DataFrame:
    """AG8: per root its own cost and that of all descendants. A node reached by two paths counts twice; a path stops where it would repeat a node.

    There is no bound on levels or rows. Where ids are unique, each node has one parent, and sums are made for all nodes at once: leaves are summed
    into their parents until few rows or few leaves are left, and the rest by doubling, where rounds grow with the logarithm of the depth and each
    costs as much as there are rows. Other tables are followed path by path.
    """
    summed = dict(spark.sql(f"SELECT sum({cost}) AS s FROM {view}").dtypes)["s"]
    rows = kept(spark.sql(f"SELECT {id_} AS id, nullif({parent}, {id_}) AS up, CAST({cost} AS {summed}) AS cost, coalesce({roots}, false) AS root FROM {view}"))
    n, ids, blank = rows.agg(F.count(F.lit(1)), F.count_distinct("id"), F.count_if(F.col("id").isNull())).first()
    if n != ids + blank or blank > 1:
        return _path_costs(rows, summed)
    zero = F.lit(0).cast(summed)
    start = rows.withColumn("up", F.when(F.col("id").isNotNull(), F.col("up"))).withColumns({"below": zero, "nodes": F.lit(1).cast("long"), "known": F.col("cost").isNotNull().cast("long")})
    start, done = _raked(start, n, few, summed)
    state, heads = _doubled(start, summed)
    if heads is not None:
        state = _with_cycles(start, heads, summed)
    for one in done:
        state = state.select(one.columns).unionByName(one)
    own = F.coalesce("cost", zero)
    return state.filter("root").select(F.col("id").alias("root"), F.col("cost").alias("own"), F.col("below").alias("children"), F.when(F.col("known") > 0, own + F.col("below")).cast(summed).alias("total"), "nodes")


def _passed_up(rows: DataFrame, summed: str) -> DataFrame:
    """Per node that rows point at what they and all summed below them hold, and how many they are."""
    return rows.filter("up IS NOT NULL").groupBy(F.col("up").alias("_id")).agg(
        F.sum(F.coalesce("cost", F.lit(0).cast(summed)) + F.col("below")).cast(summed).alias("_below"), F.sum("nodes").alias("_nodes"), F.sum("known").alias("_known"), F.count(F.lit(1)).alias("_live"),
    )


def _more(summed: str) -> list[Column]:
    return [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).cast(summed if c == "below" else "long").alias(c) for c in ("below", "nodes", "known")]


def _raked(state: DataFrame, n: int, few: int, summed: str) -> tuple[DataFrame, list[DataFrame]]:
    """Sums leaves into their parents and sets them aside, round by round; returns what is left of the n rows, and the finished ones.

    A round is made where more than few rows are left and a quarter of them are leaves, so all rounds together cost as much as four over all rows.
    """
    done = []
    if n <= few:
        return state, done
    children = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("_id")).agg(F.count(F.lit(1)).alias("_open"))
    state = kept(state.join(children, F.col("id") == F.col("_id"), "left").select(*state.columns, F.coalesce("_open", F.lit(0)).alias("open")))
    while n > few:
        leaves = state.filter("open = 0")
        ready = leaves.count()
        if 4 * ready < n:
            break
        done.append(leaves.select("id", "cost", "root", "below", "nodes", "known"))
        state = kept(state.filter("open > 0").join(_passed_up(leaves, summed), F.col("id") == F.col("_id"), "left").select("id", "up", "cost", "root", *_more(summed), (F.col("open") - F.coalesce("_live", F.lit(0))).alias("open")))
        n -= ready
    return state.drop("open"), done


def _doubled(state: DataFrame, summed: str) -> tuple[DataFrame, DataFrame | None]:
    """Sums of all below each node, and the nodes on cycles if there are any; the sums of nodes on cycles are of no use then.

    After k rounds a node holds the sums of its descendants less than 2^k levels down and points 2^k levels up. As long as a path ends, some node
    on it loses its pointer or is no longer pointed at, so when neither number changes, all that is left points at the nodes of cycles.
    """
    seen = None
    while True:
        pointed = kept(_passed_up(state, summed))
        now = tuple(pointed.agg(F.count(F.lit(1)), F.coalesce(F.sum("_live"), F.lit(0))).first())
        if not now[0]:
            return state, None
        if now == seen:
            return state, pointed.select("_id")
        seen = now
        higher = state.select(F.col("id").alias("_up"), F.col("up").alias("_next"))
        state = kept(state.join(pointed, F.col("id") == F.col("_id"), "left").join(higher, F.col("up") == F.col("_up"), "left").select("id", F.col("_next").alias("up"), "cost", "root", *_more(summed)))


def _with_cycles(start: DataFrame, heads: DataFrame, summed: str) -> DataFrame:
    """Sums where some nodes are on cycles: each of those has all of its cycle, and what hangs on it, below it."""
    marked = kept(start.join(heads, F.col("id") == F.col("_id"), "left"))
    state, _ = _doubled(marked.withColumn("up", F.when(F.col("_id").isNull(), F.col("up"))).drop("_id"), summed)
    ring = kept(marked.filter("_id IS NOT NULL").select("id", "up", F.col("id").alias("least")))
    for _ in range(ring.count().bit_length()):
        ring = kept(ring.join(ring.select(F.col("id").alias("_up"), F.col("up").alias("_next"), F.col("least").alias("_least")), F.col("up") == F.col("_up")).select("id", F.col("_next").alias("up"), F.least("least", "_least").alias("least")))
    zero = F.lit(0).cast(summed)
    held = state.join(ring.select(F.col("id").alias("_id"), "least"), F.col("id") == F.col("_id"), "left")
    whole = held.filter("_id IS NOT NULL").groupBy(F.col("least").alias("_ring")).agg(F.sum(F.coalesce("cost", zero) + F.col("below")).cast(summed).alias("_all"), F.sum("nodes").alias("_nodes"), F.sum("known").alias("_known"))
    below = F.coalesce(F.col("_all") - F.coalesce("cost", zero), F.col("below")).cast(summed).alias("below")
    return held.join(whole, F.col("least") == F.col("_ring"), "left").select("id", "cost", "root", below, F.coalesce("_nodes", "nodes").alias("nodes"), F.coalesce("_known", "known").alias("known"))


def _path_costs(rows: DataFrame, summed: str) -> DataFrame:
    """Level by level, a row for each path; a level's rows are summed and forgotten."""
    below = rows.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("cost").alias("_cost"))
    level, first, sums = kept(rows.filter("root").select(F.col("id").alias("root"), "id", "cost", F.array("id").alias("path"))), True, []
    while not level.isEmpty():
        sums.append(kept(level.groupBy("root").agg(F.sum("cost").cast(summed).alias("cost"), F.count(F.lit(1)).alias("nodes")).withColumn("first", F.lit(first))))
        step = level.join(below, F.col("_up") == F.col("id")).filter(~F.array_contains("path", F.col("_id")))
        level, first = kept(step.select("root", F.col("_id").alias("id"), F.col("_cost").alias("cost"), F.array_append("path", F.col("_id")).alias("path"))), False
    every = sums[0] if sums else rows.sparkSession.createDataFrame([], f"root {dict(rows.dtypes)['id']}, cost {summed}, nodes long, first boolean")
    for one in sums[1:]:
        every = every.unionByName(one)
    of = lambda c: F.sum(F.when(c, F.col("cost"))).cast(summed)
    return every.groupBy("root").agg(of(F.col("first")).alias("own"), F.coalesce(of(~F.col("first")), F.lit(0).cast(summed)).alias("children"), of(F.lit(True)).alias("total"), F.sum("nodes").alias("nodes"))


def storage_stats(items: DataFrame, by: str, ts: str, size: str) -> DataFrame:
    """AG9: per type the count, first and last time, total size."""
    return items.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("oldest"), F.max(ts).alias("newest"), F.sum(size).alias("size"))


def category_accuracy(rows: DataFrame, category: str, outcome: str, unknown: str = "unknown") -> DataFrame:
    """AG10: per category the pass rate, and the accuracy over all whose outcome is known."""
    known = F.col(outcome) != unknown
    per = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(outcome) == "pass").alias("passed"), F.try_divide(F.count_if(F.col(outcome) == "pass").cast("double"), F.count(F.lit(1))).alias("rate"))
    overall = rows.agg(F.try_divide(F.count_if(F.col(outcome) == "pass").cast("double"), F.count_if(known)).alias("accuracy"))
    return per.crossJoin(F.broadcast(overall))  # one row


def latency_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    """AG11: mean, extremes and the upper median: the element at floor(n / 2) of the sorted values.

    The median is found by rank, in a window per key that spills, not by collecting the values of a key.
    """
    own = Window.partitionBy(by)
    ranked = rows.filter(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(own.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
    return ranked.groupBy(by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2), F.col(value))).alias("median"))


def shares(rows: DataFrame, by: str) -> DataFrame:
    """AG12: how often each value occurs, and its percentage of all."""
    counts = rows.groupBy(by).count()
    total = counts.agg(F.sum("count").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(by, F.col("count").alias("n"), (F.col("count") * 100.0 / F.col("_t")).alias("percent"))  # one row


def options(rows: DataFrame, value: str) -> DataFrame:
    """AG13, XS16: distinct values in order."""
    return rows.select(value).filter(F.col(value).isNotNull()).distinct().orderBy(value)


def tool_columns(usage: DataFrame) -> DataFrame:
    """AG14: tools by total attempts, most first. usage: tool, attempts."""
    return usage.groupBy("tool").agg(F.sum("attempts").alias("attempts")).orderBy(F.desc("attempts"), "tool")


def grouped_tools(usage: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """AG15: listed tools under their group's name, others under their own. groups: tool, group."""
    return usage.join(groups, "tool", "left").groupBy(*by, F.coalesce("group", "tool").alias("name")).agg(F.sum("attempts").alias("attempts"), F.sum("failures").alias("failures"))


def usage_in_window(events: DataFrame, by: str, ts: str, now: Column, seconds: int, kind: str, count: str) -> DataFrame:
    """AG16: tokens and requests of the trailing window, its lower bound included."""
    inside = (F.col(ts) >= now - F.expr(f"INTERVAL {seconds} SECONDS")) & (F.col(ts) <= now)
    return events.filter(inside).groupBy(by).agg(F.sum(F.when(F.col(kind) == "tokens", F.col(count)).otherwise(0)).alias("tokens"), F.sum(F.when(F.col(kind) == "requests", F.col(count)).otherwise(0)).alias("requests"))


def elapsed(tasks: DataFrame, by: str, started: str, finished: str) -> DataFrame:
    """AG17: from the first start to the last finish, not below zero, in seconds."""
    start = F.min(started)
    return tasks.groupBy(by).agg((F.unix_timestamp(F.greatest(F.max(finished), start).cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))).alias("seconds"))


def purgeable(tasks: DataFrame, completed: DataFrame, key: str, class_: Column, ts: str, retention: dict[str, int | None], now: Column) -> DataFrame:
    """AG19: tasks whose age in whole days exceeds their class's retention; incomplete tasks have a class of their own; NULL keeps for ever."""
    done = completed.select(F.col(key).alias("_k")).distinct().withColumn("_done", F.lit(True))
    rows = tasks.join(done, F.col(key) == F.col("_k"), "left")
    kind = F.when(F.col("_done").isNull() & (class_ == "default"), "incomplete").otherwise(class_)
    days = F.lit(None).cast("int")
    for name, n in retention.items():
        days = F.when(kind == name, F.lit(n).cast("int")).otherwise(days)
    age = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp"))) / 86400)
    return rows.select(*tasks.columns, kind.alias("class"), age.alias("age_days"), days.alias("retention")).filter("age_days > retention")


def first_of_each(rows: DataFrame, by: list[str], order: str, blank: str | None = None) -> DataFrame:
    """AG20: the first row of each key in order; rows with a blank key all stay."""
    keep = F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1
    if blank:
        keep = keep | F.coalesce(F.trim(blank) == "", F.lit(True))
    return rows.withColumn("_keep", keep).filter("_keep").drop("_keep")


def api_cost(tokens_in: Column, tokens_out: Column, cache_writes: Column, cache_reads: Column, prices: dict[str, float], cached_in_input: bool = False) -> Column:
    """AG21: dollars at prices per million tokens. Where the input count includes cached tokens, only the rest is charged as input."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    writes, reads = zero(cache_writes), zero(cache_reads)
    fresh = F.greatest(F.lit(0), zero(tokens_in) - writes - reads) if cached_in_input else zero(tokens_in)
    return (fresh * prices.get("input", 0.0) + zero(tokens_out) * prices.get("output", 0.0) + writes * prices.get("cache_writes", 0.0) + reads * prices.get("cache_reads", 0.0)) / 1e6


def task_summary(messages: DataFrame, by: str = "task_id") -> DataFrame:
    """AG22: token usage with the time of the last message that isn't a question whether to resume."""
    resume = F.coalesce(F.col("ask").isin("resume_task", "resume_completed_task"), F.lit(False))
    last = messages.groupBy(by).agg(F.max_by(F.when(~resume, F.col("ts")), F.when(~resume, F.col("seq"))).alias("ts"))
    return token_usage(messages, by).join(last, by)


def tool_counters(calls: DataFrame, by: list[str], failed: Column) -> DataFrame:
    """AG23: attempts and failures."""
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(failed).alias("failures"))


def changes(snapshots: DataFrame, by: str, order: str, values: list[str]) -> DataFrame:
    """AG24, ST8: snapshots that differ from the one before in any value; the first always does. Maps compare by their sorted entries."""
    w = Window.partitionBy(by).orderBy(order)
    kinds = dict(snapshots.dtypes)
    of = lambda c: F.array_sort(F.map_entries(c)) if kinds[c].startswith("map") else F.col(c)
    same = F.lit(True)
    for c in values:
        same = same & F.lag(of(c)).over(w).eqNullSafe(of(c))
    return snapshots.withColumn("_same", same & (F.row_number().over(w) > 1)).filter(~F.col("_same")).drop("_same")


def task_metrics(tasks: DataFrame, stored: DataFrame, streamed: DataFrame, key: str, values: list[str], finished: str = "finished_at", started: str = "started_at") -> DataFrame:
    """AG25: stored metrics of a finished task if any is above zero, else streamed ones; a missing duration comes from the times."""
    s = stored.select(F.col(key).alias("_s"), *[F.col(v).alias(f"s_{v}") for v in values])
    t = streamed.select(F.col(key).alias("_t"), *[F.col(v).alias(f"t_{v}") for v in values])
    rows = tasks.join(s, F.col(key) == F.col("_s"), "left").join(t, F.col(key) == F.col("_t"), "left")
    use = F.col(finished).isNotNull() & F.coalesce(F.greatest(*[F.col(f"s_{v}") for v in values], F.lit(0)) > 0, F.lit(False))
    out = {v: F.when(use, F.col(f"s_{v}")).otherwise(F.col(f"t_{v}")) for v in values}
    if "duration" in out:
        spent = (F.unix_timestamp(F.col(finished).cast("timestamp")) - F.unix_timestamp(F.col(started).cast("timestamp"))) * 1000
        out["duration"] = F.coalesce(F.nullif(out["duration"], F.lit(0)), spent)
    return rows.select(*tasks.columns, *[c.alias(v) for v, c in out.items()])
