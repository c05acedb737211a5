"""The corpus pipeline: toxicity, exact dedup, near dedup, source mixing and packing, each on what the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again as the next one's docs. All but the last
return the columns of documents. Decisions are joined back on all that tells rows apart, so repeated rows are kept or dropped as rows. Rows travel as one
struct, so that no column of theirs can clash with one of a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.exact_dedup import exact_dedup
from loomline.llm.mixing import mixed_documents
from loomline.llm.near_dedup import near_dedup
from loomline.llm.packing import pack_documents
from loomline.llm.shared import SPACES, checkpointed, documents, forget, written
from loomline.llm.toxicity import learnt, toxicity


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go, each row by its own score, whatever its id."""
    # Labels are of the documents of sf_dir, of which docs may be a part.
    model = learnt(spark, docs, sf_dir)
    return toxicity(docs, model, row="_row").filter("predicted = 0").select("_row.*")


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest id; of rows that repeat it whole, one."""
    kept = checkpointed(exact_dedup(docs).filter("kept").select(F.struct("doc_id", "n_chars", "text_sha256").alias("_kept"), "copies"))
    text = F.coalesce("text", F.lit(""))
    key = F.struct("doc_id", F.length(text).cast("long").alias("n_chars"), F.sha2(F.translate(text, SPACES, ""), 256).alias("text_sha256"))
    stay = docs.select(F.struct("*").alias("_row"), key.alias("_key")).join(kept, F.col("_key") == F.col("_kept"), "left_semi")
    return (stay if kept.filter("copies > 1").isEmpty() else stay.dropDuplicates(["_key"])).select("_row.*")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of smallest id. Rows without an id stay."""
    gone = near_dedup(docs).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id")).join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources near their target weights: documents that the mix passes over go, those it takes again come again, cut ones are cut."""
    return mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", clean_language),
    ("exact_dedup", unique_texts),
    ("near_dedup", distinct_documents),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: Learnt scores, near duplicates and packing have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    before = []
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        # Its own stage's table is the last that reads the one before.
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
