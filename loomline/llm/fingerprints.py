"""Document fingerprints: the bottom-k sketch of a text's shingle hashes.

A sketch keeps the k smallest distinct 64-bit hashes of a text's five-word shingles. Sketches of parts merge into the
sketch of their union, and give estimates of resemblance, containment and the number of distinct shingles; all are exact while
no more than k shingles are involved.

Scale: hashing runs on Arrow batches in the map stage. Pairing a document with the one that follows needs one shuffle, by
ranges of doc_id, and of a hash of the text inside an id that many rows share: the first document of each range is also sent to the
range before it, so that no pair spans two tasks. Range bounds, ids that fill a range and first keys are a few rows per partition.

Defined results: null text counts as empty; an empty text has an empty sketch, alike (1.0) only to another empty one; texts of
fewer than five words form one shingle of all their words; rows of equal doc_ids follow one another by a hash of their text; rows with a
null doc_id come first; a single document is its own successor.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.shared import blank_null, documents, partitions
from loomline.llm.words import doc_shingles, in_slices

K = 256


class Sketch:
    """The k smallest distinct hashes, ascending, and whether hashes were left out."""

    def __init__(self, hashes: np.ndarray, k: int = K, full: bool | None = None):
        self.hashes, self.k = hashes[:k], k
        self.full = len(hashes) > k if full is None else full

    @classmethod
    def of(cls, hashes: np.ndarray, k: int = K) -> Sketch:
        return cls(np.unique(hashes.astype(np.uint64)), k)

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both sets together. Of unequal k, the smaller one holds."""
        k = min(self.k, other.k)
        both = np.union1d(self.hashes, other.hashes)
        return Sketch(both, k, self.full or other.full or len(both) > k)

    def distinct(self) -> float:
        """Estimated number of distinct shingles."""
        if not self.full or not len(self.hashes):
            return float(len(self.hashes))
        return (len(self.hashes) - 1) / ((float(self.hashes[-1]) + 1) / 2.0**64)

    def _common(self, other: Sketch) -> tuple[int, int, Sketch]:
        union = self.merge(other)
        both = np.intersect1d(self.hashes, other.hashes, assume_unique=True)
        return int(np.isin(union.hashes, both, assume_unique=True).sum()), len(union.hashes), union

    def resemblance(self, other: Sketch) -> float:
        common, of, _ = self._common(other)
        return common / of if of else 1.0

    def containment(self, other: Sketch) -> float:
        """The estimated share of this set that the other has."""
        common, of, union = self._common(other)
        own = self.distinct()
        return min(1.0, common / of * union.distinct() / own) if own else 1.0

    def dump(self) -> str:
        return f"{self.k}:{int(self.full)}:" + base64.b64encode(self.hashes.astype("<u8").tobytes()).decode()

    @classmethod
    def load(cls, text: str) -> Sketch:
        k, full, data = text.split(":")
        return cls(np.frombuffer(base64.b64decode(data), "<u8"), int(k), full == "1")


def sketches(texts: pa.Array, k: int = K) -> list[Sketch]:
    out: list[Sketch] = []
    for part in in_slices(texts):
        hashes, starts = doc_shingles(part)
        out += [Sketch(hashes[a:b], k) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return out


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double"
TAGGED = pa.schema([("bucket", pa.int32()), ("guest", pa.bool_()), ("doc_id", pa.int64()), ("h", pa.int64()), ("text", pa.string())])


def _emitted(rows: list[tuple], k: int) -> pa.RecordBatch:
    """The result of each row that another follows. rows: bucket, guest, doc_id, h, text, sketch."""
    pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[1] and a[0] == b[0]]
    texts = [a[4][: len(a[4]) - len(a[4]) // 2] + b[4][: len(a[4]) // 2] for a, b in pairs]
    out: list[list] = [[] for _ in range(8)]
    for (a, b), text, edited in zip(pairs, texts, sketches(pa.array(texts, pa.large_string()), k), strict=True):
        made = (a[2], len(a[4]), hashlib.sha256(text.encode()).hexdigest(), a[5].dump(), edited.dump(), a[5].resemblance(edited), a[5].resemblance(b[5]), a[5].distinct())
        for column, value in zip(out, made, strict=True):
            column.append(value)
    kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, ranges_per_partition: int = 4) -> DataFrame:
    """Each row's fingerprint, that of its text with its second half overwritten by the next text's start, and likeness to both."""
    text = blank_null(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    n = partitions(docs)
    ranges = n * ranges_per_partition
    shares = [i / ranges for i in range(1, ranges)]
    bounds = {int(x) for x in (rows.approxQuantile("doc_id", shares, 0.2 / ranges) or [])}
    # Ids of more rows than a range should have, of which there are fewer than ranges, are parted by the hash of the text.
    total = rows.count()
    hot = {r["doc_id"]: -(-r["count"] * ranges // total) for r in rows.groupBy("doc_id").count().filter(F.col("count") * ranges > max(total, ranges)).collect()}
    parts = {x: np.linspace(-(2.0**63), 2.0**63, k + 1)[:-1].astype(np.int64) for x, k in hot.items()}
    nothing = parts.pop(None, np.array([-(2**63)], np.int64))
    edges = np.array(sorted([b for b in bounds if b not in parts] + [x for x, p in parts.items() for _ in p] + [x + 1 for x in parts if x + 1 not in parts and x + 1 not in bounds]), np.int64)

    def bucket_of(ids: pa.Array, h: pa.Array) -> np.ndarray:
        """Ranges in the order of id and hash: those of rows without an id, then the others."""
        plain, hashes = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)
        found = np.searchsorted(edges, plain, "right")
        for x, p in parts.items():
            own = plain == x
            found[own] = np.searchsorted(edges, x, "left") + np.searchsorted(p, hashes[own], "right")
        first = np.searchsorted(nothing, hashes, "right") - 1
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), first, found + len(nothing)).astype(np.int32)

    def firsts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task and bucket: the smallest id, 0 for null, and hash."""
        seen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            ids = pc.fill_null(batch.column(0), 0).to_pylist()
            for b, key in zip(bucket_of(batch.column(0), batch.column(1)).tolist(), zip(ids, batch.column(1).to_pylist(), strict=True), strict=True):
                if b not in seen or key < seen[b]:
                    seen[b] = key
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int32()), *(pa.array([k[i] for k in seen.values()], pa.int64()) for i in (0, 1))], names=["bucket", "id", "h"])

    found = rows.select("doc_id", "h").mapInArrow(firsts, "bucket int, id long, h long").groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("first"))
    # One row per range, of which there are a few times as many as shuffle partitions.
    first = {r["bucket"]: (r["first"]["id"], r["first"]["h"]) for r in found.collect()}
    order = sorted(first)
    before = {b: order[i - 1] for i, b in enumerate(order)}

    def tag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            bucket = bucket_of(batch.column(0), batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(bucket), bool)), *batch.columns], schema=TAGGED)
            also = []
            for i, (b, x, h) in enumerate(zip(bucket.tolist(), pc.fill_null(batch.column(0), 0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if (x, h) == first[b] and b not in sent:
                    sent.add(b)
                    also.append(i)
            if also:
                guests = batch.take(pa.array(also))
                yield pa.RecordBatch.from_arrays([pa.array([before[int(bucket[i])] for i in also], pa.int32()), pa.array(np.ones(len(also), bool)), *guests.columns], schema=TAGGED)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            at = 0
            for part in in_slices(batch.column(4)):
                columns = [batch.column(i).slice(at, len(part)).to_pylist() for i in range(5)]
                at += len(part)
                made = [*last, *zip(*columns, sketches(part, k), strict=True)]
                last = made[-1:]
                yield _emitted(made, k)

    tagged = rows.mapInArrow(tag, "bucket int, guest boolean, doc_id long, h long, text string")
    return tagged.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "h", "text").mapInArrow(compare, OUT)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(documents(spark, sf_dir))
