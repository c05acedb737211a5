"""Budgets: truncation and selection of ordered rows by tokens, characters and lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def estimated_tokens(text: Column) -> Column:
    """BG15, offline: a token for four characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def truncated(messages: DataFrame, fraction: float, truncation_id: str, by: str = "conv_id") -> DataFrame:
    """BG1: tags the oldest visible messages after the first, an even number of them, and puts a marker before the first that stays.

    The marker takes position seq - 0.5 and a timestamp one below that of the message it precedes (NULL if none follows).
    """
    every = Window.partitionBy(by)
    visible = F.col("truncationParent").isNull() & ~F.coalesce("isTruncationMarker", F.lit(False))
    rows = messages.withColumn("_v", visible).withColumn("_r", F.sum(F.col("_v").cast("int")).over(every.orderBy("seq"))).withColumn("_n", F.sum(F.col("_v").cast("int")).over(every))
    raw = F.floor((F.col("_n") - 1) * fraction)
    rows = rows.withColumn("_k", F.greatest(F.lit(0), raw - raw % 2))
    tagged = rows.withColumn("truncationParent", F.when(F.col("_v") & F.col("_r").between(2, F.col("_k") + 1), truncation_id).otherwise(F.col("truncationParent"))).withColumn("position", F.col("seq").cast("double"))
    kept = tagged.filter("_k > 0").groupBy(by).agg(F.first("_k").alias("_k"), F.min(F.when(F.col("_v") & (F.col("_r") == F.col("_k") + 2), F.struct("seq", "ts"))).alias("_f"), F.max("seq").alias("_l"))
    text = F.format_string("[Sliding window truncation: %d messages hidden to reduce context]", F.col("_k"))
    own = {by: F.col(by), "seq": F.lit(None).cast("long"), "position": F.coalesce(F.col("_f.seq") - F.lit(0.5), F.col("_l") + F.lit(0.5)), "ts": F.col("_f.ts") - 1, "role": F.lit("user"), "content": text, "isTruncationMarker": F.lit(True), "truncationId": F.lit(truncation_id)}
    columns = [*messages.columns, "position"]
    kinds = {f.name: f.dataType for f in messages.schema.fields} | {"position": "double"}
    marker = kept.select(*[own.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in columns])
    return tagged.select(columns).unionByName(marker)


def must_manage(total: Column, last: Column, window: Column, reserved: Column, auto: Column, percent: Column, profile: Column | None = None) -> Column:
    """BG2: over 90 % of the window less what is reserved, or, where condensing is on, at or above its percentage. A profile's valid value (5..100) goes first."""
    used = total + last
    over = used > window * 0.9 - reserved
    limit = F.when(profile.between(5, 100), profile).otherwise(percent) if profile is not None else percent
    return over | (auto & (100.0 * used / window >= limit))


def managed(messages: DataFrame, state: DataFrame, truncation_id: str, by: str = "conv_id", tokens: str = "tokens") -> DataFrame:
    """BG3, without a model that could condense: truncates half of the conversations that must be managed, and counts what stays visible.

    state: by, manage (boolean).
    """
    due = state.filter("manage").select(by)
    cut = truncated(messages.join(due, by, "left_semi"), 0.5, truncation_id, by)
    rest = messages.join(due, by, "left_anti").withColumn("position", F.col("seq").cast("double"))
    both = cut.unionByName(rest)
    visible = F.col("truncationParent").isNull()
    return both.withColumn("visible_tokens", F.sum(F.when(visible, F.coalesce(tokens, F.lit(0)))).over(Window.partitionBy(by)))


def newest_within(messages: DataFrame, by: str, order: str, tokens: Column, budget: Column | int, always: Column | None = None) -> DataFrame:
    """BG4: drops the oldest until the rest fits; what `always` marks is counted first and stays."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    fixed = always if always is not None else F.lit(False)
    every = Window.partitionBy(by)
    rows = messages.withColumn("_t", tokens).withColumn("_a", fixed)
    base = F.sum(F.when(F.col("_a"), F.col("_t")).otherwise(0)).over(every)
    run = F.sum(F.when(F.col("_a"), 0).otherwise(F.col("_t"))).over(every.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_ok", F.col("_a") | (base + run <= limit)).filter("_ok").drop("_t", "_a", "_ok")


def pruned_lines(lines: str, budget: int, keep: str = "last") -> Column:
    """BG5, BG10: of an array column the last or first lines within a budget of estimated tokens that also pays for the newlines between them."""
    costs = F.transform(lines, lambda x: estimated_tokens(x) + 1)
    start = F.struct(F.lit(-1).cast("long").alias("spent"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        # Costs are not negative, so once the budget is passed, nothing more is counted.
        spent = acc["spent"] + F.coalesce(x, F.lit(0).cast("long"))
        return F.struct(spent.alias("spent"), (acc["n"] + (spent <= budget).cast("int")).alias("n"))

    n = F.aggregate(F.reverse(costs) if keep == "last" else costs, start, step)["n"]
    return F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)) if keep == "last" else F.lit(1), n)


def read_within(lines: DataFrame, key: str, tokens: Column, budget: int) -> DataFrame:
    """BG10: per text its first lines within a budget, how many, and whether that is all of it."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_s", F.sum(tokens).over(w))
    ok = F.col("_s") <= budget
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(key).agg(text.alias("content"), F.count_if(ok).alias("line_count"), F.coalesce(F.max(F.when(ok, F.col("_s"))), F.lit(0)).alias("token_count"), (F.count_if(~ok) == 0).alias("complete"))


def _walked(rows: DataFrame, by: str, order: list[str], size: str, begin: Callable[[], Callable[[int], int]], out: str) -> DataFrame:
    """Rows with what a walk over each key's rows, in order, says of each one's size: keys are sorted runs, state is that of one key."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, step = None, False, None
        for batch in batches:
            made = []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not seen or k != key:
                    key, seen, step = k, True, begin()
                made.append(step(n or 0))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(made, pa.int64())], schema=pa.schema([pa.field("_row", batch.schema.field(2).type), pa.field("_made", pa.int64())]))

    laid = rows.repartition(F.col(by)).sortWithinPartitions(by, *order).select(F.col(by).alias("_k"), F.col(size).cast("long").alias("_n"), F.struct(*rows.columns).alias("_row"))
    schema = StructType([laid.schema["_row"], StructField("_made", LongType())])
    return laid.mapInArrow(walk, schema).select("_row.*", F.col("_made").alias(out))


def greedy_fill(rows: DataFrame, by: str, order: list[str], tokens: str, budget: int, overhead: int = 0) -> DataFrame:
    """BG7, BG8: takes rows in order as long as each fits what is left, passing over those that don't. A walk over sorted rows, in any number per key."""

    def begin() -> Callable[[int], int]:
        left = budget

        def step(n: int) -> int:
            nonlocal left
            fits = n + overhead <= left
            left -= (n + overhead) * fits
            return int(fits)

        return step

    return _walked(rows, by, order, tokens, begin, "_taken").filter("_taken = 1").drop("_taken")


def next_fit(rows: DataFrame, by: str, order: str, size: Column, limit: int = 100_000, most: int = 8_191) -> DataFrame:
    """BG11: batches filled in order: an item that does not fit opens the next; items above `most` go. Ids are kept, so results join by id.

    A walk over each key's rows in order; a key is walked in one task: give one per file or shard.
    """

    def begin() -> Callable[[int], int]:
        held = batch = 0

        def step(n: int) -> int:
            nonlocal held, batch
            if held + n > limit:
                held, batch = n, batch + 1
            else:
                held += n
            return batch

        return step

    items = rows.withColumn("_t", size).filter(F.col("_t") <= most)
    return _walked(items, by, [order], "_t", begin, "batch").drop("_t")


def batches_of(rows: DataFrame, by: str, order: str, size: int = 60) -> DataFrame:
    """BG12: batch numbers of a fixed size, per key."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size))


def opened_file_scores(files: DataFrame, by: str, order: str, content: str, considered: int = 10, used: int = 5, least: int = 10) -> DataFrame:
    """BG9: of the files opened last the best by recency (a factor of 1.15 a place) and small size on a log scale, 60 to 40."""
    w = Window.partitionBy(by)
    rows = files.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).filter(F.col("_i") < considered)
    size = F.ln(F.greatest(F.length(content), F.lit(least)).cast("double"))
    rows = rows.withColumn("_s", size).withColumn("_lo", F.min("_s").over(w)).withColumn("_hi", F.max("_s").over(w))
    small = F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise(1 - F.try_divide(F.col("_s") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    scored = rows.withColumn("score", 0.6 * F.pow(F.lit(1.15), -F.col("_i")) + 0.4 * small)
    return scored.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "_i"))).filter(F.col("_r") <= used).drop("_i", "_s", "_lo", "_hi", "_r")


def truncated_output(text: Column, line_limit: int = 0, char_limit: int = 0) -> Column:
    """BG13: 20 % from the start and 80 % from the end, with a note between; characters go before lines; 0 is no limit."""
    out, n = text, F.length(text)
    if line_limit:
        head = line_limit // 5
        tail = line_limit - head
        lines = F.split(text, "\n")
        count = F.size(lines)
        start = F.array_join(F.slice(lines, 1, head), "\n") if head else F.lit("")
        end = F.array_join(F.slice(lines, F.greatest(count - tail + 1, F.lit(1)), F.lit(tail)), "\n")
        made = F.concat(F.concat(start, F.lit("\n")) if head else F.lit(""), F.lit("\n[..."), (count - line_limit).cast("string"), F.lit(" lines omitted...]\n\n"), end)
        out = F.when(count > line_limit, made).otherwise(out)
    if char_limit:
        head = char_limit // 5
        made = F.concat(F.substring(text, 1, head), F.lit("\n[..."), (n - char_limit).cast("string"), F.lit(" characters omitted...]\n"), F.substring(text, n - (char_limit - head) + 1, F.lit(char_limit)))
        out = F.when(n > char_limit, made).otherwise(out)
    return out


def truncated_line(line: Column, most: int = 500) -> Column:
    """BG14."""
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit(" [truncated...]"))).otherwise(line)


def wait_seconds(events: DataFrame, by: str, ts: str, limit: int) -> DataFrame:
    """ST13: whole seconds to wait so that requests are `limit` seconds apart; never more than that. Times count in milliseconds, to which they are rounded."""
    millis = lambda c: F.round(F.unix_micros(c.cast("timestamp")).cast("decimal(19,0)") / 1000).cast("long")
    past = millis(F.col(ts)) - millis(F.lag(ts).over(Window.partitionBy(by).orderBy(ts)))
    wait = F.ceil(F.least(F.lit(float(limit)), F.greatest(F.lit(0.0), (limit * 1000 - past) / 1000)))
    return events.withColumn("wait", F.coalesce(wait, F.lit(0)))
