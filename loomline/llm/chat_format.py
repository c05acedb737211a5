"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted. Adjacent turns of one role are merged by array aggregation into blocks: a role and
the texts under it, found where the sorted array, laid against itself shifted by one, changes its role. Blocks are rendered to pieces.
The template is

    ### {role}: {text}[<join/>{text of the next turn of the same role}...]</turn>\\n

Texts are escaped so that no control string can occur inside them, and unescape() gives every text back exactly.
A piece is a string with a flag; the concatenated pieces are the formatted text, the flagged ones its loss mask.

Scale: one shuffle, on the conversation; all later work is linear in the conversation's length, as neighbours are zipped, a block
is a slice of the array, and pieces are joined once. The result of a conversation is one row, so its turns must meet in one task.

Defined results: null text and null role count as empty; turns with equal numbers are ordered by role, then text; repeated rows
are turns of their own; null turn numbers come first; null conversation ids form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, COLON, JOIN, END = "### ", ": ", "<join/>", "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """Reversible: backslashes are doubled, and one backslash breaks each control string after its first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, broken in (("##", "#\\#"), ("</turn>", "<\\/turn>"), (JOIN, "<\\join/>")):
        out = F.replace(out, F.lit(plain), F.lit(broken))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(COLON), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = ASSISTANT) -> DataFrame:
    """One row per conversation: conv_id, formatted, pieces (array of piece, loss), blocks (array of role, texts), n_blocks."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("_t"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
    roles = F.transform("_turns", lambda t: t["role"])
    shifted = F.concat(F.array(F.lit(None).cast("string")), F.slice(roles, F.lit(1), F.size("_turns") - 1))
    heads = F.filter(F.transform(F.zip_with(roles, shifted, lambda x, y: F.when(~x.eqNullSafe(y), x)), lambda x, i: F.struct(i.alias("begin"), x.alias("role"))), lambda h: h["role"].isNotNull())
    got = got.withColumn("_heads", heads)
    ends = F.concat(F.transform(F.slice("_heads", F.lit(2), F.size("_heads")), lambda h: h["begin"]), F.array(F.size("_turns")))
    spans = F.zip_with("_heads", ends, lambda h, e: F.struct(h["role"].alias("role"), h["begin"].alias("begin"), (e - h["begin"]).alias("n")))
    merged = F.transform(spans, lambda r: F.struct(r["role"].alias("role"), F.transform(F.slice(F.col("_turns"), r["begin"] + 1, r["n"]), lambda t: t["text"]).alias("texts")))
    piece = lambda text, loss: F.struct(text.alias("piece"), loss.alias("loss"))

    def render(block: Column) -> Column:
        loss = block["role"] == loss_role
        head = F.concat(F.lit(HEAD), escape_role(block["role"]), F.lit(COLON))
        texts = F.transform(block["texts"], lambda t, i: F.array(piece(F.when(i == 0, "").otherwise(JOIN), F.lit(False)), piece(escape(t), loss)))
        return F.concat(F.array(piece(head, F.lit(False))), F.flatten(texts), F.array(piece(F.lit(END), F.lit(False))))

    made = got.select("conv_id", merged.alias("blocks"))
    made = made.select("conv_id", "blocks", F.flatten(F.transform("blocks", render)).alias("pieces"))
    return made.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "pieces", "blocks", F.size("blocks").cast("long").alias("n_blocks"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    blocks = F.split(formatted, END)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        colon = F.instr(block, COLON)
        role = unescape(block.substr(F.lit(len(HEAD) + 1), colon - len(HEAD) - 1))
        body = block.substr(colon + len(COLON), F.length(block))
        return F.transform(F.split(body, JOIN), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat_format(table.unionByName(extra))
    back = made.select("conv_id", "formatted", "pieces", "n_blocks", read_back(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["piece"])), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


OP4_SQL = r"""
WITH rows0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (
  SELECT *, coalesce(role <> lag(role) OVER w, TRUE) AS opens,
    replace(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), '<join/>', '<\join/>') AS esc
  FROM rows0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(esc) + CASE WHEN opens THEN length(role) + 14 ELSE 7 END)::BIGINT AS formatted_chars,
  count(*) FILTER (opens)::BIGINT AS n_blocks
FROM r GROUP BY conv_id
"""
