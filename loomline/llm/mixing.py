"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources, by code point and null last, carry weights; each may take up to `cap` times its size, and what a capped source can't
take is reshared by weight among the others. The sum of targets is cut into equal blocks of words. Blocks go to sources, then
inside a source to its shards, to whoever has the highest quotient votes / (2 * blocks + 1). A shard's documents lie on a ring in
seeded order, its blocks end to end around it from a seeded start; so every block has the same number of words, a quota beyond the
ring's length goes round again, and no document is taken more than `cap` times.

Scale: texts are counted where they are read; only (id, source, size, hash) is shuffled. A source is dealt by hash into shards
of about `shard_words` words, `max_shards` at most, so a source with a third of all rows is spread; running sums are made inside
a shard. Apportionment works on divisors, not block by block, on one row per source or per shard. The table of sources is handled in
one task: it has a row per source.

Defined results: null text has size 0; null source is a source of its own; rows that repeat are taken on their own; where all sizes
are 0 nothing is taken; same rows and seed give the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.shared import WORD_PATTERN, blank_null, checkpointed, documents

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 17
MAX_SHARDS = 4096
SEED = 20240


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats for each party by highest quotient votes / (2 * seats + 1), ties to the earlier party; `most` bounds a party's seats."""
    votes = np.asarray(votes, float)
    most = np.full(len(votes), seats, np.int64) if most is None else np.asarray(most, np.int64)
    seats = int(min(seats, most[votes > 0].sum()))
    got = np.zeros(len(votes), np.int64)
    if not seats:
        return got
    # A price at which at most that many seats are sold: every quotient above it has won.
    low, high = 0.0, 2.0 * votes.max() + 1.0
    for _ in range(200):
        price = (low + high) / 2
        if price in (low, high):
            break
        sold = np.minimum(np.maximum(np.ceil((votes / price - 1) / 2), 0), most).sum()
        low, high = (price, high) if sold > seats else (low, price)
    got = np.minimum(np.maximum(np.ceil((votes / high - 1) / 2), 0), most).astype(np.int64)
    while (left := seats - int(got.sum())) > 0:
        quotients = np.where((got < most) & (votes > 0), votes / (2 * got + 1), -1.0)
        best = np.argsort(-quotients, kind="stable")[:left]
        best = best[quotients[best] >= quotients.max() * (1 - 1e-12)]  # of equal quotients, those that are next in turn
        got[best] += 1
    return got


def targets_of(sizes: np.ndarray, weights: np.ndarray, cap: float) -> np.ndarray:
    """Shares of the total by weight; none above cap times its size, the excess reshared by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, capped = np.zeros(len(sizes)), np.zeros(len(sizes), bool)
    while not capped.all():
        left = sizes.sum() - out[capped].sum()
        out[~capped] = left * weights[~capped] / weights[~capped].sum()
        over = ~capped & (out > cap * sizes)
        if not over.any():
            break
        out[over], capped = cap * sizes[over], capped | over
    return out


def _planned(weights: tuple, cap: float, block_words: int, shard_words: int, max_shards: int):
    def plan(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat([pd.DataFrame({"source": [], "source_size": []}), *frames])
        rows = sorted(zip(t["source"], t["source_size"], strict=True), key=lambda r: (r[0] is None, r[0] or ""))
        if not rows:
            return
        sizes = np.array([r[1] for r in rows], np.int64)
        target = targets_of(sizes, np.resize(np.array(weights, float), len(rows)), cap)
        least = target[target > 0].min() if (target > 0).any() else 0
        block = int(max(1, min(block_words, least // 200)))
        seats = sainte_lague(target, round(sizes.sum() / block))
        shards = np.clip(-(-sizes // shard_words), 1, max_shards)
        yield pd.DataFrame({"source": [r[0] for r in rows], "source_size": sizes, "target": target, "blocks": seats, "shards": shards, "block": block})

    return plan


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = WEIGHTS, cap: float = CAP, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, max_shards: int = MAX_SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row: doc_id, source, size, source_size, target, taken, and where its extra words lie: passes (whole), and up to two runs of words."""
    size = F.regexp_count(blank_null(text_col), F.lit(WORD_PATTERN)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    sized = checkpointed(sized.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = checkpointed(totals.coalesce(1).mapInPandas(_planned(weights, cap, block_words, shard_words, max_shards), "source string, source_size long, target double, blocks long, shards long, block long"))
    dealt = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select("doc_id", sized["source"], "size", "_h", "source_size", "target", "blocks", "block", F.pmod("_h", "shards").alias("shard"), F.coalesce(F.concat(F.lit("s"), sized["source"]), F.lit("n")).alias("_s"))
    shards = dealt.groupBy("_s", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"), F.first("block").alias("block"))

    def quotas(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("shard")
        block = int(t["block"].iloc[0])
        won = sainte_lague(t["words"].to_numpy(), int(t["blocks"].iloc[0]), np.floor(cap * t["words"].to_numpy() / block).astype(np.int64))
        return pd.DataFrame({"_s": t["_s"], "shard": t["shard"], "words": t["words"], "quota": won * block})

    won = shards.groupBy("_s").applyInPandas(quotas, "_s string, shard long, words long, quota long")
    ring = Window.partitionBy("_s", "shard").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = dealt.withColumn("_end", F.sum("size").over(ring)).join(won, ["_s", "shard"])
    words = F.greatest("words", F.lit(1))
    laid = laid.withColumn("passes", F.floor(F.col("quota") / words)).withColumn("_rest", F.col("quota") - F.col("passes") * F.col("words"))
    start = F.pmod(F.xxhash64(F.lit(seed), "_s", "shard"), F.greatest(F.lit(1), F.ceil(words / F.col("block")))) * F.col("block")
    laid = laid.withColumn("_from", start).withColumn("_to", F.col("_from") + F.col("_rest")).withColumn("_begin", F.col("_end") - F.col("size"))
    # The run [_from, _to) on the ring, which may wrap around: as runs of this document's own words.
    clip = lambda x: F.least(F.greatest(x - F.col("_begin"), F.lit(0)), F.col("size")).cast("long")
    runs = F.array(F.struct(clip(F.lit(0)).alias("start"), clip(F.col("_to") - F.col("words")).alias("end")), F.struct(clip(F.col("_from")).alias("start"), clip(F.least("_to", "words")).alias("end")))
    runs = F.filter(runs, lambda r: r["end"] > r["start"])
    laid = laid.select("doc_id", "source", "size", "source_size", "target", F.col("passes").cast("long").alias("passes"), runs.alias("runs"))
    extra = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return laid.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + extra).alias("taken"), "source", "passes", "runs")


_WORD = re.compile(WORD_PATTERN)


def _cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Each text from its word `start` to the one before its word `end`."""
    out = []
    for text, start, end in zip(texts, starts, ends, strict=True):
        spans = islice(_WORD.finditer(text), int(start), int(end))
        first = last = next(spans)
        for last in spans:
            pass
        out.append(text[first.start() : last.end()])
    return pd.Series(out, dtype=object)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each whole pass over a document, and one for each run of its words.

    A run's text is the document's text from its first to its last word; n_chars, where there is one, is counted anew.
    Rows of the same id, source and size share what their mix gives, each in turn. Rows travel as one struct, whatever their columns' names.
    """
    plan = checkpointed(mix_sources(docs, **options).select(F.col("doc_id").alias("_id"), F.col("size").alias("_of"), "passes", "runs", "taken"))
    own = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_own"), F.regexp_count(blank_null("text"), F.lit(WORD_PATTERN)).cast("long").alias("_size"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_size") == F.col("_of"))
    if not plan.groupBy("_id", "_of").count().filter("count > 1").isEmpty():
        plan = plan.withColumn("_at", F.row_number().over(Window.partitionBy("_id", "_of").orderBy(F.hash("runs"), "passes")))
        own = own.withColumn("_nth", F.row_number().over(Window.partitionBy("_own", "_size").orderBy(F.xxhash64("_doc.text"))))
        same = same & (F.col("_nth") == F.col("_at"))
    joined = own.join(plan.filter("taken > 0"), same).select("_doc", "passes", "runs")
    whole = F.transform(F.sequence(F.lit(1).cast("long"), F.col("passes")), lambda _: F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end")))
    parts = F.concat(F.when(F.col("passes") > 0, whole).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")), "runs")
    rows = joined.select("_doc", F.explode(parts).alias("_run"))
    text = F.pandas_udf(_cut, "string")(F.col("_doc.text"), F.col("_run.start"), F.col("_run.end"))
    part = rows.filter("_run.start >= 0").select("_doc", text.alias("_text"))
    changed = F.col("_doc").withField("text", F.col("_text"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("_text").cast(docs.schema["n_chars"].dataType))
    return rows.filter("_run.start < 0").select("_doc.*").unionByName(part.select(changed.alias("_doc")).select("_doc.*"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
