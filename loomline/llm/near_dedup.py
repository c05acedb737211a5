"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

Each document's distinct five-word shingles are hashed once; the hash range is cut into bins, and a bin's least hash is one
entry of the signature. An empty bin takes the entry of a filled one, found by a probe sequence of its own (optimal
densification). Entries are banded into buckets. Documents of equal sets, told by their size and a 128-bit digest, are one class, and only the classes' first documents
enter buckets. In a bucket each member is paired with one centre only, so pairs grow with members, not with their square; pairs
are confirmed on full sets. Confirmed links are joined to components; buckets whose members then lie in more than one component
get other centres once more. What is left open is compared outright: in each cluster of documents that share open buckets, all that
are not in the largest component are a query set against all, in blocks. So no link is lost that the buckets hold.

Scale: texts are read twice and never shuffled; sets are only made for documents with a candidate. Which ones is told by a Bloom
filter of fixed size, broadcast; beyond its capacity it lets more sets through but loses none. All joins are of shuffled sides,
which adaptive execution splits where one centre or bucket is hot; counts and minima of buckets are taken on the map side first.

Defined results: null and empty texts have no set and are linked with nothing; fewer than five words form one shingle; rows of one
doc_id are one document, linked if any of its texts is; rows with a null doc_id have a null component and are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.bloom import bloom, in_bloom
from loomline.llm.graph import components
from loomline.llm.shared import blank_null, checkpointed, documents, sweep, written
from loomline.llm.words import SHINGLE_WORDS, doc_shingles, in_slices, mixed

BANDS, ROWS = 32, 5
#: Links of the contract: 100 * intersection >= 85 * union.
SIMILARITY = 85
ROUNDS = 2
#: Documents in a block of the last comparison, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Shingles that are compared at once.
WIDE = 4096

_SEED = np.uint64(0xA0761D6478BD642F)


def probes(bins: int, tries: int = 512) -> np.ndarray:
    """For each try and bin, the bin to look into."""
    return (mixed(np.arange(tries * bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _SEED) % np.uint64(bins)).astype(np.int64).reshape(tries, bins)


def signatures(hashes: np.ndarray, starts: np.ndarray, bins: int, looked: np.ndarray) -> np.ndarray:
    """One row per document, one entry per bin; rows without shingles are zero. hashes: ascending in each document."""
    n = len(starts) - 1
    doc = np.repeat(np.arange(n), np.diff(starts))
    cell = doc * bins + (((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    flat, filled = np.zeros(n * bins, np.uint64), np.zeros(n * bins, bool)
    flat[cell[first]], filled[cell[first]] = hashes[first], True
    empty = np.flatnonzero(~filled & np.repeat(np.diff(starts) > 0, bins))
    for look in looked:
        if not len(empty):
            break
        source = empty // bins * bins + look[empty % bins]
        found = filled[source]
        flat[empty[found]] = flat[source[found]]
        empty = empty[~found]
    for at in empty:  # as good as never: the least filled bin
        row = at // bins * bins
        flat[at] = flat[row + np.flatnonzero(filled[row : row + bins])[0]]
    return flat.reshape(n, bins)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for r in range(rows):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, r::rows][:, :bands]
        keys ^= keys >> np.uint64(29)
    return mixed(keys.ravel()).reshape(keys.shape)


def _per_doc_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[starts[1:]] - total[starts[:-1]]


def signed(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (h1, h2), and the keys of its buckets."""
    bins = bands * rows

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = probes(bins)
        for batch in batches:
            at = 0
            for part in in_slices(batch.column(1)):
                hashes, starts = doc_shingles(part, words)
                keys = band_keys(signatures(hashes, starts, bins, looked), bands, rows).view(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))
                h1, h2 = _per_doc_sums(mixed(hashes), starts), _per_doc_sums(mixed(hashes ^ _SEED), starts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(np.diff(starts)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], names=["doc_id", "n_shingles", "h1", "h2", "bands"])
                at += len(part)

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def sets_of(docs: DataFrame, wanted: np.ndarray, words: int) -> DataFrame:
    """doc_id and shingle set, as bytes, of the documents in the filter `wanted`."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            known = batch.filter(batch.column(0).is_valid())
            hit = in_bloom(table, known.column(0).to_numpy(zero_copy_only=False))
            known, at = known.filter(pa.array(hit)), 0
            for part in in_slices(known.column(1)):
                hashes, starts = doc_shingles(part, words)
                sets = [hashes[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([known.column(0).slice(at, len(part)), pa.array(sets, pa.binary())], names=["id", "shingles"])
                at += len(part)

    return docs.mapInArrow(make, "id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= similarity * union, on full sets."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, last, other = [], None, None
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, most = min(len(p), len(q)), max(len(p), len(q))
                both = 0
                if 100 * small >= similarity * most:
                    spot = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    both = int((q[spot] == p).sum())
                hit.append(both > 0 and 100 * both >= similarity * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def _hits(queries: list[np.ndarray], rows: list[np.ndarray], similarity: int) -> np.ndarray:
    """Which query and row have 100 * intersection >= similarity * union: a product of their incidence matrices."""
    sides = (queries, rows)
    values = np.unique(np.concatenate(queries))
    values = values[np.isin(values, np.concatenate(rows))]
    sizes = [np.array([len(x) for x in side], np.int64) for side in sides]
    both = np.zeros((len(queries), len(rows)), np.float32)
    flat = []
    for side, size in zip(sides, sizes, strict=True):
        joined, owner = np.concatenate(side), np.repeat(np.arange(len(side)), size)
        spot = np.minimum(np.searchsorted(values, joined), max(0, len(values) - 1))
        known = values[spot] == joined if len(values) else np.zeros(len(joined), bool)
        order = np.argsort(spot[known], kind="stable")
        flat.append((spot[known][order], owner[known][order]))
    for at in range(0, len(values), WIDE):
        part = []
        for (spot, owner), side in zip(flat, sides, strict=True):
            a, b = np.searchsorted(spot, (at, at + WIDE))
            m = np.zeros((len(side), min(WIDE, len(values) - at)), np.float32)
            m[owner[a:b], spot[a:b] - at] = 1
            part.append(m)
        both += part[0] @ part[1].T
    count = np.rint(both).astype(np.int64)
    return (count > 0) & (100 * count >= similarity * (sizes[0][:, None] + sizes[1][None, :] - count))


def compared(open_: DataFrame, sets: DataFrame, similarity: int, block: int = BLOCK) -> DataFrame:
    """Links between documents of different components that share a bucket, directly or through others: every one that joins two components.

    open_: bucket, id, component. Documents outside their cluster's largest component are compared with all of the cluster, block by block;
    what is shuffled is a document once per block of the other side, and no pair is made before it is known to be a link.
    """
    first = open_.groupBy("bucket").agg(F.min("id").alias("first"))
    clusters = components(open_.join(first, "bucket").select(F.col("id").alias("a"), F.col("first").alias("b")))
    ids = open_.select("id", "component").distinct().join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id")
    docs = checkpointed(ids.join(sets.select("id", F.octet_length("shingles").alias("bytes")), "id"))
    sizes = docs.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    main = F.max_by(F.struct("component", "n", "bytes"), F.struct("n", "component"))
    plan = sizes.groupBy("cluster").agg(main.alias("_m"), F.sum("n").alias("m"), F.sum("bytes").alias("b")).select("cluster", "_m.*", "m", "b").withColumnsRenamed({"component": "main", "bytes": "main_bytes"})
    # Blocks are bounded by documents and by bytes; one very long document fills its own.
    blocks = lambda n, b: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(b / BLOCK_BYTES)).cast("int")
    laid = docs.drop("bytes").join(plan, "cluster").withColumn("nd", blocks(F.col("m"), F.col("b"))).withColumn("nq", blocks(F.col("m") - F.col("n"), F.col("b") - F.col("main_bytes")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = laid.select("cluster", "id", "component", F.lit(False).alias("query"), every("nq").alias("q"), F.pmod(F.xxhash64("id"), "nd").cast("int").alias("d"))
    asked = laid.filter("component <> main").select("cluster", "id", "component", F.lit(True).alias("query"), F.pmod(F.xxhash64("id", F.lit(1)), "nq").cast("int").alias("q"), every("nd").alias("d"))

    def compare(table: pa.Table) -> pa.Table:
        ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
        query = table.column("query").to_numpy(zero_copy_only=False)
        shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        qs, ds = np.flatnonzero(query), np.flatnonzero(~query)
        out: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        if len(qs) and len(ds):
            hit = _hits([shingles[i] for i in qs], [shingles[i] for i in ds], similarity) & (component[qs][:, None] != component[ds][None, :])
            x, y = (side[k] for side, k in zip((qs, ds), np.nonzero(hit), strict=True))
            # One link for two components is enough.
            _, once = np.unique(np.stack([component[x], component[y]]), axis=1, return_index=True)
            out = [ids[x[once]], ids[y[once]]]
        return pa.table({"a": pa.array(out[0]), "b": pa.array(out[1])})

    return rows.unionByName(asked).join(sets, "id").groupBy("cluster", "q", "d").applyInArrow(compare, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS, words: int = SHINGLE_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (least doc_id reachable by links), kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), blank_null(text_col).alias("text"))
    signs = written(signed(texts, bands, rows, words))
    known = signs.filter("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    members = checkpointed(classes.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id")).distinct().transform(_shared))
    # Stored before it is joined: a join in the stage of its aggregate could not be split where one class is hot.
    named = checkpointed(classes.select("h1", "h2", "n_shingles", "rep"))
    same = known.select("doc_id", "h1", "h2", "n_shingles").join(named, ["h1", "h2", "n_shingles"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    sets = written(sets_of(texts, bloom(members.select("id").distinct(), "id"), words))
    # What is linked so far, as stars: each document with the least of its component.
    stars, open_ = None, members
    joined = lambda edges: edges if stars is None else stars.unionByName(edges)
    starred = lambda found: found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    for turn in range(rounds):
        # The least id is each bucket's first centre, the same one in many buckets; then ids in another order.
        order = F.col("id") if not turn else F.xxhash64("id", F.lit(turn))
        centres = open_.groupBy("bucket").agg(F.min_by("id", order).alias("centre"))
        pairs = open_.join(centres, "bucket").filter("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
        found = components(joined(confirmed(pairs, sets, similarity)))
        stars = starred(found)
        placed = members.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
        split = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y and n > 2").select("bucket")
        open_ = checkpointed(placed.join(split, "bucket"))
        sweep(docs.sparkSession)
        if open_.isEmpty():
            break
    else:
        stars = joined(compared(open_, sets, similarity))
    found = components(joined(same))
    placed = signs.select("doc_id", "n_shingles").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _shared(members: DataFrame) -> DataFrame:
    """Without the buckets that hold one document."""
    several = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    return members.join(several, "bucket")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))
