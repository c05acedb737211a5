"""Exact dedup by deterministic block naming.

A text without its white space is cut into fixed-size blocks. Blocks are sorted and numbered by their rank, so that equal blocks,
and only they, share an integer name. Then names of adjacent blocks are paired, the pairs are sorted and named in turn, and so
on until each document has one name. Two documents of equal depth and name are equal to the last character: no hash decides.

Scale: a text is shuffled once, as blocks dealt into many small classes by hash; inside its class a block is ranked by sorting, and
rank and class make one integer. A block that may hold more than a partition's share of all rows would make its class hot:
such blocks, of which there can only be a few per partition, are named beforehand and matched by a broadcast table, and their
text isn't shuffled at all. Which blocks those are is estimated on sampled rows; this only decides how a name is found, not
which rows get one. A level has half the rows of the one before it.

Defined results: null text counts as empty; empty texts are equal to one another; rows that repeat a doc_id each get a row;
a null doc_id is kept, and stays only if no other row of its length has an id; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.shared import SPACES, blank_null, checkpointed, documents, few, partitions, sweep

BLOCK_CHARS = 2048
CLASS_ROWS = 1000
HOT_SAMPLE = 0.05
#: Copies of a row that are put out at once.
SLICE_ROWS = 1 << 16


def blocks_of(rows: DataFrame, block_chars: int) -> DataFrame:
    """Rows of _key and _text as (_key, _n, _pos, _block): n blocks each, one at least."""
    n = F.greatest(F.lit(1), F.ceil(F.length("_text") / F.lit(block_chars)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.substring("_text", i * block_chars + 1, F.lit(block_chars)))
    return rows.select("_key", "_text", n.alias("_n")).select("_key", "_n", F.posexplode(cut).alias("_pos", "_block"))


def hot_names(rows: DataFrame, keys: list[str], total: float, share: int) -> DataFrame:
    """Negative names of the key values that hold more than 1/share of `total` rows: fewer than `share` of them."""
    heavy = rows.groupBy(*keys).count().filter(F.col("count") * share > total).select(*keys)
    return checkpointed(heavy.select(*keys, (-F.row_number().over(Window.orderBy(*keys))).cast("long").alias("_hot")))


def named(rows: DataFrame, keys: list[str], hot: DataFrame, total: float) -> DataFrame:
    """`rows` with `keys` replaced by _name, an integer that equal keys share and no others have."""
    classes = max(partitions(rows), int(total // CLASS_ROWS))
    is_hot = F.col("_hot").isNotNull()
    rest = [c for c in rows.columns if c not in keys]
    dealt = rows.join(F.broadcast(hot), keys, "left").select(
        *rest, "_hot", *[F.when(~is_hot, F.col(k)).alias(k) for k in keys],
        F.when(is_hot, classes + F.pmod(F.xxhash64(*rest), F.lit(classes))).otherwise(F.pmod(F.xxhash64(*keys), F.lit(classes))).alias("_class"),
    )
    rank = F.dense_rank().over(Window.partitionBy("_class").orderBy(*keys)).cast("long")
    return dealt.select(*rest, F.coalesce("_hot", rank * classes + F.col("_class")).alias("_name"))


def identities(rows: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Of rows (_key, _text): (_key, _copies, _depth, _name), where equal texts, and only they, share depth and name.

    _copies counts the rows of that key; rows of equal key must have equal text. A key's rows may come as several such counts.
    """
    if block_chars < 1:
        raise ValueError("block_chars must be positive")
    share = max(8, partitions(rows))
    blocks = blocks_of(rows, block_chars)
    sampled = blocks_of(rows.sample(HOT_SAMPLE, seed=17), block_chars)
    in_sample = sampled.count()
    level = checkpointed(named(blocks, ["_block"], hot_names(sampled, ["_block"], in_sample, share), in_sample / HOT_SAMPLE).withColumn("_copies", F.lit(1).cast("long")))
    done, depth = [], 0
    while True:
        done.append(level.filter("_n = 1").select("_key", "_copies", F.lit(depth).alias("_depth"), "_name"))
        rest = level.filter("_n > 1")
        even = F.col("_pos").bitwiseAND(1) == 0
        # max and sum, not first: equal keys give the same names again, once per copy.
        pairs = rest.groupBy("_key", F.shiftright("_pos", 1).alias("_pos")).agg(
            F.max("_n").alias("_n"), F.sum(F.when(even, F.col("_copies"))).alias("_copies"),
            F.max(F.when(even, F.col("_name"))).alias("_a"), F.max(F.when(~even, F.col("_name"))).alias("_b"),
        )
        pairs = checkpointed(pairs.select("_key", F.shiftright(F.col("_n") + 1, 1).alias("_n"), "_pos", "_copies", "_a", F.coalesce("_b", F.lit(0)).alias("_b")))
        total = pairs.count()
        if not total:
            break
        pairs = few(pairs, total)
        level = checkpointed(few(named(pairs, ["_a", "_b"], hot_names(pairs, ["_a", "_b"], total, share), total), total))
        sweep(rows.sparkSession)
        depth += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars, copies (rows alike in id, length and content).

    The row with the most code points in its original text stays, then the smallest id. Should rows repeat id and text, all of
    them carry that keep_id and exactly one is kept.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), blank_null(text_col).alias("_raw"))
    plain = base.select("doc_id", F.length("_raw").cast("long").alias("n_chars"), F.translate("_raw", SPACES, "").alias("_text"))
    # A row is known by its id, length and digest: rows alike in all three have one text, so they can share an identity.
    keyed = plain.select(F.struct("doc_id", "n_chars", F.unhex(F.sha2("_text", 256)).alias("sha")).alias("_key"), "_text")
    rows = checkpointed(identities(keyed, block_chars).groupBy("_key", "_depth", "_name").agg(F.sum("_copies").alias("_copies")).select("_key.*", "_depth", "_name", "_copies"))
    best = F.max_by(F.struct("doc_id"), F.struct("n_chars", F.col("doc_id").isNotNull(), -F.col("doc_id")))
    # Stored before they are joined: a join in the stage of its aggregate could not be split where one group is hot.
    groups = checkpointed(rows.groupBy("_depth", "_name").agg(F.sum("_copies").alias("group_size"), best["doc_id"].alias("keep_id"), F.max("n_chars").alias("_most")))
    joined = rows.join(groups, ["_depth", "_name"])
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("_most"))
    # A row stands for all of its copies: they are counted out in slices, and where there are many slices, by many tasks.
    slices = joined.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / slice_rows))))
    if not rows.filter(F.col("_copies") > slice_rows).isEmpty():
        slices = slices.repartition(partitions(rows), "doc_id", "_name", "_slice")
    last = F.least(F.lit(slice_rows), F.col("_copies") - F.col("_slice") * slice_rows).cast("int")
    every = slices.withColumn("_i", F.explode(F.sequence(F.lit(1), last)))
    return every.select("doc_id", "keep_id", "group_size", (wins & (F.col("_slice") == 0) & (F.col("_i") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_chars", F.col("_copies").alias("copies"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("copies")


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS plain
  FROM documents),
g AS (SELECT plain, count(*)::BIGINT AS group_size, arg_min(doc_id, (-n_chars, doc_id)) AS keep_id FROM n GROUP BY plain)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.plain) AS text_sha256, n.n_chars
FROM n JOIN g USING (plain)
"""
