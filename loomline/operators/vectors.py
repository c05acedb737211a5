"""Vector search and incremental indexing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import path_segments

DEFAULT_MIN_SCORE, DEFAULT_LIMIT = 0.4, 50
# Fixed value: the name space of point ids.
NAMESPACE = "f47ac10b-58cc-4372-a567-0e02b2c3d479"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """NULL for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def under_path(rows: DataFrame, prefix: str | None, path: str = "filePath", by_segment: bool = True) -> DataFrame:
    """Rows below a path: by whole segments, or by the plain string, which also takes siblings whose names begin alike."""
    if not prefix or prefix in (".", "./"):
        return rows
    if not by_segment:
        return rows.filter(F.startswith(path, F.lit(prefix)))
    parts = [p for p in prefix.split("/") if p and p != "."]
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    return rows.filter(F.slice(segments, 1, len(parts)) == F.array(*map(F.lit, parts)))


def search(points: DataFrame, query: list[float], prefix: str | None = None, min_score: float = DEFAULT_MIN_SCORE, limit: int = DEFAULT_LIMIT, vector: str = "vector", id_: str = "id", by_segment: bool = True, marker: str | None = None) -> DataFrame:
    """VS1, VS2: exact cosine top-k at or above a score, best first; the query is a literal, so this is one scan and a top-k merge."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = under_path(points if marker is None else points.filter(F.col(id_) != marker), prefix, by_segment=by_segment)
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    score = F.try_divide(dot(F.col(vector), q), F.sqrt(dot(F.col(vector), F.col(vector))) * norm)
    return rows.withColumn("score", score).filter(F.col("score") >= min_score).orderBy(F.desc("score"), id_).limit(limit)


def search_many(points: DataFrame, queries: DataFrame, limit: int, min_score: float = DEFAULT_MIN_SCORE, vector: str = "vector", id_: str = "id", max_queries: int | None = None) -> DataFrame:
    """VS3, VS1: the best points of each query (query_id, query), with rank and score; of equal scores the smaller id first.

    There is no bound on queries unless one is given. Both sides are packed into blocks; each pair of blocks is one matrix product, and only
    its best of each query are shuffled. Zero vectors match nothing.
    """
    if max_queries is not None and queries.limit(max_queries + 1).count() > max_queries:
        raise ValueError(f"more than {max_queries} queries: split them")
    kinds = {"query": queries.schema["query_id"].dataType.simpleString(), "point": points.schema[id_].dataType.simpleString()}

    def unit(lists: pa.Array) -> np.ndarray:
        m = np.array(lists.to_pylist(), np.float64).reshape(len(lists), -1)
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, size, out=np.full_like(m, np.nan), where=size > 0)

    def blocks(rows: DataFrame, side: str, most: int) -> DataFrame:
        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(batch.column(1).is_valid())
                for at in range(0, len(batch), most):
                    part = batch.slice(at, most)
                    ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([unit(part.column(1)).tobytes()], pa.binary())], names=[f"{side}_ids", side])

        return rows.mapInArrow(pack, f"{side}_ids array<{kinds[side]}>, {side} binary")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                names, ids = batch.column(2)[r].values, batch.column(0)[r].values
                held, wanted = (np.frombuffer(batch.column(c)[r].as_buffer(), np.float64).reshape(len(n), -1) for c, n in ((1, ids), (3, names)))
                of = np.nan_to_num(held @ wanted.T, nan=-2.0)
                # Everything as good as the last of the best: ties are settled among all blocks.
                least = np.partition(of, len(of) - limit, axis=0)[len(of) - limit] if len(of) > limit else np.full(of.shape[1], -1.5)
                row, query = np.nonzero((of >= np.maximum(least, min_score)) & (of > -1.5))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), ids.take(pa.array(row)), pa.array(of[row, query])], names=["query_id", id_, "score"])

    pairs = blocks(points.select(id_, vector), "point", 4096).crossJoin(blocks(queries.select("query_id", "query"), "query", 1024))
    scored = pairs.mapInArrow(score, f"query_id {kinds['query']}, `{id_}` {kinds['point']}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_))
    return scored.withColumn("rank", rank - 1).filter(F.col("rank") < limit).select("query_id", "rank", id_, "score")


def min_score(user: Column, model: Column) -> Column:
    """VS4: the user's threshold, else the model's, else 0.4."""
    return F.coalesce(user, model, F.lit(DEFAULT_MIN_SCORE))


def preferred_branch(rows: DataFrame, branch: str, fallback: str, excluded: DataFrame | None = None) -> DataFrame:
    """VS6: one result per place: the branch's own before the fallback's, of which excluded files are left out."""
    own = rows.filter(F.col("branch") == branch)
    other = rows.filter(F.col("branch") == fallback)
    if excluded is not None:
        other = other.join(excluded.select("filePath").distinct(), "filePath", "left_anti")
    both = own.withColumn("_p", F.lit(1)).unionByName(other.withColumn("_p", F.lit(0)))
    columns = [c for c in rows.columns if c not in ("filePath", "startLine", "endLine")]
    return both.groupBy("filePath", "startLine", "endLine").agg(F.max_by(F.struct(*columns), "_p").alias("_r")).select("filePath", "startLine", "endLine", "_r.*")


def segment_hash(path: Column, start: Column, end: Column, content: Column) -> Column:
    """VS10: sha256 of path, lines, length and the first 100 characters."""
    return F.sha2(F.concat_ws("-", path, start.cast("string"), end.cast("string"), F.length(content).cast("string"), F.substring(content, 1, 100)), 256)


def point_id(digest: Column, namespace: str = NAMESPACE) -> Column:
    """VS11: the version 5 UUID of a name in a name space."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(digest, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(raw, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    part = lambda a, n: F.substring(raw, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def with_segments(points: DataFrame, path: str = "filePath") -> DataFrame:
    """VS15."""
    return points.withColumn("pathSegments", path_segments(F.col(path)))


def upserted(points: DataFrame, new: DataFrame, key: str = "id", required: tuple[str, ...] = ("filePath", "codeChunk", "startLine", "endLine")) -> DataFrame:
    """SC13: the points less those of the new ids, with the new ones; new points must have the required columns, null or not."""
    if any(c not in new.columns for c in required):
        new = new.limit(0)
    return points.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def relative_path(path: Column, root: str) -> Column:
    """A normalized path below a root."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.rstrip("/") + "/"
    return F.regexp_replace(F.when(F.startswith(plain, F.lit(base)), F.substring(plain, len(base) + 1, 1 << 30)).otherwise(plain), r"^(?:\./)+", "")


def without_files(points: DataFrame, paths: DataFrame, root: str, path: str = "filePath") -> DataFrame:
    """SC14: the points of all other files."""
    gone = paths.select(relative_path(F.col(path), root).alias("_p")).distinct()
    return points.join(gone, relative_path(F.col(path), root) == F.col("_p"), "left_anti")


def within_size(files: DataFrame, extensions: tuple[str, ...], most: int = 1 << 20) -> DataFrame:
    """VS13: files up to a size, of a known extension; path and length as the binaryFile source gives them."""
    return files.filter((F.col("length") <= most) & F.concat(F.lit("."), F.lower(F.element_at(F.split("path", r"\."), -1))).isin(list(extensions)))


def index_batch(points: DataFrame, hashes: DataFrame, chunks: DataFrame, embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VS12: one idempotent step of an index: points of the batch's files go, the new ones come, hashes follow. embedded: segmentHash, vector."""
    files = chunks.select(F.col("file_path").alias("filePath")).distinct()
    fresh = chunks.join(embedded, "segmentHash").select(point_id(F.col("segmentHash")).alias("id"), "vector", F.col("file_path").alias("filePath"), F.col("content").alias("codeChunk"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    kept = points.join(files, "filePath", "left_anti")
    known = chunks.select(F.col("file_path").alias("path"), F.col("fileHash").alias("hash")).distinct()
    return upserted(kept, fresh), hashes.join(known.select("path"), "path", "left_anti").unionByName(known)
