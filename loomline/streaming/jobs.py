"""Structured Streaming jobs. Each takes and returns a streaming DataFrame, or a batch one for tests of the same logic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomline.session import kept


def file_stream(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", per_batch: int = 1) -> DataFrame:
    """SC17: a stream of the files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(kind).load(folder)


def parsed(lines: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """ST7, SC17: records from JSON lines; malformed ones go."""
    return lines.select(F.from_json(text, schema).alias("r"), F.col(text).alias("_raw")).filter(F.col("r").isNotNull() & F.try_parse_json("_raw").isNotNull()).select("r.*")


def published(events: DataFrame, ignored: list[str], says: list[str] | None = None) -> DataFrame:
    """ST6: events that are passed on: no ignored names, no partial messages, only listed says."""
    out = events.filter(~F.col("eventName").isin(ignored) & ~F.coalesce("partial", F.lit(False)))
    return out.filter(F.col("say").isNull() | F.col("say").isin(says)) if says is not None else out


def without_repeats(events: DataFrame, keys: list[str], ts: str, delay: str = "1 minute") -> DataFrame:
    """ST6: each payload once within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def debounced(events: DataFrame, path: str, ts: str, change: str, gap: str = "500 milliseconds", delay: str = "1 minute", per_path: bool = False) -> DataFrame:
    """ST1: bursts of changes that are closed by a pause of `gap` or more, with the last change of each path. One timer serves all paths; per_path
    gives each its own. Streams with one timer close bursts in one task; batches find them in parallel."""
    if not events.isStreaming and not per_path:
        return _bursts(events, path, ts, change, gap)
    kind = events if not events.isStreaming else events.withWatermark(ts, delay)
    # Streams don't take a session window alone, nor beside a key that the optimizer sees to be constant.
    one = F.coalesce(F.length(F.col(path).cast("string")) * 0, F.lit(0))
    # Session windows join what is a whole gap apart, too.
    keys = [F.session_window(ts, f"{gap} -1 microseconds").alias("w"), (F.col(path) if per_path else one).alias("k")]
    last = F.max_by(F.col(change), F.col(ts))
    if per_path:
        return kind.groupBy(*keys).agg(last.alias("change"), F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), F.col("k").alias("path"), "change", "events")
    burst = kind.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col(ts).alias("t"), F.col(change).alias("c")))).alias("_e"))
    # Sorted by path and time, a path's last change is the one before another path.
    last = F.filter("_e", lambda x, i: ~F.get("_e", i + 1)["p"].eqNullSafe(x["p"]) | (i == F.size("_e") - 1))
    return burst.select(F.col("w.start").alias("start"), F.size("_e").alias("events"), F.explode(last).alias("x")).select("start", "events", F.col("x.p").alias("path"), F.col("x.c").alias("change"))


def _bursts(events: DataFrame, path: str, ts: str, change: str, gap: str) -> DataFrame:
    """ST1 on a batch: events are counted in bins as wide as the gap. A bin lies in one burst, and opens it unless the bin just before ends less
    than a gap before its first event. Bins look for the last opening in their day; of days there is one row each, put in order in one task.
    """
    width = F.expr(f"INTERVAL '{gap}'")
    rows = events.filter(F.col(ts).isNotNull()).select(F.window(ts, gap)["start"].alias("_bin"), F.col(path).alias("path"), F.col(ts).alias("_t"), F.col(change).alias("_c"))
    bins = kept(rows.groupBy("_bin").agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.count(F.lit(1)).alias("_n")))
    before = bins.select((F.col("_bin") + width).alias("_bin"), F.col("_to").alias("_ended"))
    opens = F.col("_ended").isNull() | (F.col("_from") >= F.col("_ended") + width)
    bins = bins.join(before, "_bin", "left").select("_bin", "_n", F.when(opens, F.col("_from")).alias("_opened"), F.window("_bin", "1 day")["start"].alias("_day"))
    days = bins.groupBy("_day").agg(F.max("_opened").alias("_top"))
    days = days.select("_day", F.max("_top").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    own = F.max("_opened").over(Window.partitionBy("_day").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = kept(bins.withColumn("_own", own).join(days, "_day").select("_bin", "_n", F.coalesce("_own", "_carried").alias("start")))
    sizes = bins.groupBy("start").agg(F.sum("_n").alias("events"))
    last = F.max(F.when(F.col("_c").isNotNull(), F.struct("_t", "_c"))).alias("_last")
    return rows.join(bins.select("_bin", "start"), "_bin").groupBy("start", "path").agg(last).join(sizes, "start").select("start", "events", "path", F.col("_last._c").alias("change"))


def usage_windows(events: DataFrame, ts: str, by: str, kind: str, count: str, size: str = "1 hour", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """ST2: tokens and requests in sliding windows."""
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    return rows.groupBy(F.window(ts, size, slide).alias("w"), by).agg(F.sum(F.when(F.col(kind) == "tokens", F.col(count)).otherwise(0)).alias("tokens"), F.sum(F.when(F.col(kind) == "requests", F.col(count)).otherwise(0)).alias("requests")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "tokens", "requests")


def latest_state(events: DataFrame, by: str, ts: str, values: list[str]) -> DataFrame:
    """ST4: the last values of each task, and the time since its first event; for update mode."""
    return events.groupBy(by).agg(*[F.max_by(v, ts).alias(v) for v in values], (F.unix_millis(F.max(ts)) - F.unix_millis(F.min(ts))).alias("elapsed_ms"))


class Cooldown(StatefulProcessor):
    """ST3: per key passes an event on unless one was within the cooldown; state expires by itself."""

    def __init__(self, cooldown_ms: int):
        self.cooldown_ms = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts long", ttlDurationMs=86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        frame = pd.concat(list(rows)).sort_values("ts")
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for ts in frame["ts"]:
            if last is None or ts - last >= self.cooldown_ms:
                out.append((key[0], int(ts)))
                last = int(ts)
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["key", "ts"])

    def close(self) -> None:
        pass


def cooled_down(events: DataFrame, key: str, ts_ms: str, cooldown_ms: int) -> DataFrame:
    """ST3: key and ts of events that are passed on."""
    rows = events.select(F.col(key).alias("key"), F.col(ts_ms).alias("ts"))
    return rows.groupBy("key").transformWithStateInPandas(Cooldown(cooldown_ms), f"key {rows.schema['key'].dataType.simpleString()}, ts long", "append", "processingTime")


def upserting(table: str, key: str, order: str, counters: str | None = None, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """ST5, VS12: for foreachBatch: a table's rows of the batch's keys replaced by the latest of each; a map of cumulative counters keeps its greatest values.

    The table is partitioned by the key's hash in `parts` folders; a batch reads and rewrites those of its own keys only. A batch that is run
    again gives the same table, as the latest rows and the greatest counters stay what they are.
    """
    from pyspark.sql import Window

    from loomline.operators.aggregates import merged_usage, usage_map

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).persist()
        touched = [r["_part"] for r in placed.select("_part").distinct().collect()]  # `parts` rows at most
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        both = placed.unionByName(spark.read.schema(placed.schema).parquet(table).filter(F.col("_part").isin(touched))) if known else placed
        top = both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
        if counters:
            merged = usage_map(merged_usage(both, [key], counters, "max"), [key]).withColumnRenamed("tool_usage", "_u")
            top = top.join(merged, key, "left").withColumn(counters, F.coalesce("_u", counters)).drop("_u").select(both.columns)
        top.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(table)
        placed.unpersist()

    return write


def dwelt(shown: DataFrame, by: str, ts: str, key: str, least_ms: int = 300) -> DataFrame:
    """ST10, batch: keys shown for a while before the next one, each counted once, at its first such time."""
    from pyspark.sql import Window

    stay = F.unix_millis(F.lead(ts).over(Window.partitionBy(by).orderBy(ts)).cast("timestamp")) - F.unix_millis(F.col(ts).cast("timestamp"))
    return shown.withColumn("_s", stay).filter(F.col("_s") >= least_ms).groupBy(by, key).agg(F.min(ts).alias("first_seen"))


class Dwell(StatefulProcessor):
    """ST10: per viewer, emits a key once it has been on show for a while; a timer fires for the one that is on show."""

    def __init__(self, least_ms: int):
        self.least_ms = least_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "key string, since long")
        self.seen = handle.getMapState("seen", "key string", "at long")

    def _leave(self, viewer, until: int) -> list[tuple]:
        if not self.current.exists():
            return []
        key, since = self.current.get()
        if until - since < self.least_ms or self.seen.containsKey((key,)):
            return []
        self.seen.updateValue((key,), (since,))
        return [(viewer, key, since)]

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803, ANN001
        out = []
        for shown, ts in pd.concat(list(rows)).sort_values("ts")[["shown", "ts"]].itertuples(index=False):
            out += self._leave(key[0], int(ts))
            self.current.update((shown, int(ts)))
            self.handle.registerTimer(int(ts) + self.least_ms)
        yield pd.DataFrame(out, columns=["viewer", "shown", "since"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803, ANN001
        yield pd.DataFrame(self._leave(key[0], expiredTimerInfo.getExpiryTimeInMs()), columns=["viewer", "shown", "since"])

    def close(self) -> None:
        pass


def dwelling(shown: DataFrame, viewer: str, key: str, ts: str, least_ms: int = 300, delay: str = "0 seconds") -> DataFrame:
    """ST10, stream: viewer, shown, since."""
    rows = shown.withWatermark(ts, delay).select(F.col(viewer).cast("string").alias("viewer"), F.col(key).cast("string").alias("shown"), F.unix_millis(ts).alias("ts"), F.col(ts).alias("event_time"))
    return rows.groupBy("viewer").transformWithStateInPandas(Dwell(least_ms), "viewer string, shown string, since long", "append", "eventTime")


def queue_to_flush(items: DataFrame, task: str, blob: str, ts: str, threshold: int) -> DataFrame:
    """ST9: the latest entry of each task and blob, of tasks that have at least `threshold` of them."""
    from pyspark.sql import Window

    last = items.withColumn("_r", F.row_number().over(Window.partitionBy(task, blob).orderBy(F.desc(ts)))).filter("_r = 1").drop("_r")
    return last.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(task))).filter(F.col("_n") >= threshold).drop("_n")


def after_flush(items: DataFrame, flushed: DataFrame, task: str, ts: str) -> DataFrame:
    """ST9: entries later than what was flushed of their task. flushed: task, until."""
    return items.join(flushed, task, "left").filter(F.col("until").isNull() | (F.col(ts) > F.col("until"))).drop("until")


def funnel(events: DataFrame, by: str, kind: str) -> DataFrame:
    """ST11: accepted suggestions as a share of those returned, and of those returned or found in the cache; NULL where there are none."""
    n = lambda k: F.count_if(F.col(kind) == k)
    return events.groupBy(by).agg(n("accepted").alias("accepted"), n("returned").alias("returned"), n("cached").alias("cached"), F.try_divide(n("accepted").cast("double"), n("returned")).alias("accept_rate"), F.try_divide(n("accepted").cast("double"), n("returned") + n("cached")).alias("shown_rate"))


def alive(beats: DataFrame, by: str, ts: str, now: Column, expiry_s: int = 10) -> DataFrame:
    """ST12: those whose last heartbeat has not expired."""
    return beats.groupBy(by).agg(F.max(ts).alias("last")).filter(F.col("last") > now - F.expr(f"INTERVAL {expiry_s} SECONDS"))
