"""Dedup of repeated passages: byte strings of `length` bytes that occur more than once, across and inside documents.

The method is the longest-previous-factor array: in suffix order, the nearest places before and after a place that stand earlier in
the corpus (its previous and next smaller positions) hold its longest earlier match. A place whose factor reaches `length` repeats.
`keep_first` removes those alone, so the earliest copy stays; without it the places they match go too. `lpf` is the array for one text,
against which tests hold the corpus-wide result.

A suffix order of all places of a corpus is out of proportion, as it would shuffle each place. It is made only where copies can be:
1. Each place is owned by an anchor: the least fingerprint of the half-length strings inside its string, the first of equal ones. Equal
   strings own equal anchors at equal distance, so all copies of a string are in one anchor's class. Neighbouring places of one anchor
   form a run. Anchors are counted; those that occur once own nothing that repeats.
2. Runs of repeated anchors are named by a 128-bit digest of all of their bytes and counted: one that occurs twice repeats as a whole.
3. Where an anchor has different runs, one occurrence of each is cut out, and the suffixes of the class's places are sorted by their
   first `length` bytes, equal ones by place. There the previous smaller position of a place with an equal string before it is its
   neighbour, and no match can be longer: bytes decide. Classes are of bounded size and dealt into buckets; in a class of more than
   CLASS_RUNS different runs, places are dealt by the 128-bit digest of their string instead, and counted.

Fingerprints of 64 bits only propose; a shared one costs time but makes no match. Digests have 128 bits.

Scale: fingerprints are numpy sums over slices of 256 KB; texts are read once per step. Those with something to cut out or to remove are
shuffled once for each. Counts are taken on the map side first, so a passage that a third of all rows share is a row per task, and rows that
repeat send their text once per task. Joins are of shuffled sides. Bloom filters of bounded size tell tasks which anchors and texts
matter; beyond their capacity more rows pass and the exact joins drop them.

Defined results: null text counts as empty; texts shorter than `length` lose nothing; rows that repeat are occurrences like any other,
those alike in id and text share one key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.bloom import bloom, in_bloom
from loomline.llm.shared import blank_null, documents, forget, kept_in_worker, written

LENGTH = 200
SLICE = 1 << 18
#: Different runs of a class that is sorted in one task, and of a bucket of classes.
CLASS_RUNS = 4096
BUCKET_RUNS = 4096

_P = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def lpf(text: bytes) -> np.ndarray:
    """For each place of a text the length of its longest match with an earlier place, by previous and next smaller positions in suffix order."""
    n = len(text)
    order = sorted(range(n), key=lambda i: text[i:])
    out = np.zeros(n, np.int64)
    common = lambda a, b: next((k for k in range(n - max(a, b)) if text[a + k] != text[b + k]), n - max(a, b))
    for ranks in (order, order[::-1]):
        stack: list[int] = []
        for p in ranks:
            while stack and stack[-1] > p:
                stack.pop()
            if stack:
                out[p] = max(out[p], common(stack[-1], p))
            stack.append(p)
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept by the process and lengthened when needed."""
    have = kept_in_worker(("powers",), dict)
    if have.get("n", -1) < n:
        n = max(n, SLICE + 4096)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            have[name] = np.cumprod(x, dtype=np.uint64)
        have["n"] = n
    return have["up"], have["down"]


def _spread(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x)
    if n < width:
        return np.zeros(0, np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()[width - 1 : n]
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[: n - width + 1]
    return np.minimum(before, after)


class Runs:
    """The runs of a slice: anchor, text, first place in the slice and in the text, number of places."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int):
        n, half = len(data), length // 2
        up, down = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        parts = _spread((sums[half:] - sums[:-half]) * down[: n - half + 1]) if n >= half else np.zeros(0, np.uint64)
        del sums
        owner = _least(parts, length - half + 1)
        doc = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))[: len(owner)]
        inside = np.arange(len(owner)) + length <= starts[1:][doc]
        begins = np.ones(len(owner), bool)
        # A run ends where its anchor changes: another value, or the same value at a later place as the first one is passed.
        begins[1:] = (owner[1:] != owner[:-1]) | (parts[: max(0, len(owner) - 1)] == owner[1:]) | (doc[1:] != doc[:-1])
        begins &= inside
        self.first = np.flatnonzero(begins)
        stops = np.flatnonzero(begins | ~inside)
        after = np.searchsorted(stops, self.first, "right")
        last = np.append(stops, len(owner))[after] - 1
        self.count = last - self.first + 1
        self.anchor = owner[self.first]
        self.doc = doc[self.first]
        self.at = self.first - starts[:-1][self.doc]


def _slices(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, starts of texts, rows of the batch, and at what place of its text each begins. Long texts come in pieces that share length - 1 bytes."""
    held: list[tuple[memoryview, int, int]] = []
    size = 0
    for row, text in enumerate(batch.column(0)):
        data = memoryview(text.as_buffer())
        for at in range(0, max(1, len(data) - length + 1), SLICE):
            piece = data[at : at + SLICE + length - 1]
            held.append((piece, row, at))
            size += len(piece)
            if size >= SLICE:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[memoryview, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(x[0] for x in held), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x[0]) for x in held])])
    return data, starts, np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text as bytes, and the key that tells texts apart: k1, the id (0 for null), and k2, a hash of id and text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), blank_null(text_col).cast("binary").alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(0).cast("long")).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"))


def factors(runs: list[tuple[bytes, int]], length: int) -> tuple[list[bool], list[bool]]:
    """Of the places of some runs (bytes, number of places), in order: whose previous factor reaches `length`, and which of them are such a factor's source.

    Suffixes are sorted by their first `length` bytes, and equal ones by place. So the previous smaller position of a place with an
    equal string at an earlier one is the neighbour before it, and of one without, no smaller position shares `length` bytes.
    """
    strings = [data[i : i + length] for data, n in runs for i in range(n)]
    later, source = [False] * len(strings), [False] * len(strings)
    order = sorted(range(len(strings)), key=strings.__getitem__)
    before = -1
    for place in order:
        if before >= 0 and strings[before] == strings[place]:
            later[place] = source[before] = True
        before = place
    return later, source


def _stretches(flags: list[bool]) -> list[tuple[int, int]]:
    """First and last index of each stretch of true ones."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.array(flags, np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def repeats(rows: DataFrame, length: int, keep_first: bool, class_runs: int = CLASS_RUNS) -> list[DataFrame]:
    """Of rows k1, k2, text: stored tables of k1, k2, start, end of byte ranges to remove, which may overlap."""
    spark = rows.sparkSession
    send = spark.sparkContext.broadcast

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, _, _ in _slices(batch, length):
                values, counts = np.unique(Runs(data, starts, length).anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(values), pa.array(counts)], names=["a", "n"])

    again = written(rows.select("text").mapInArrow(anchors, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).filter("n > 1").select("a"))
    known = send(bloom(again, "a"))
    forget(again)

    def occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (1, 2))
            for data, starts, of, shifts in _slices(batch, length):
                runs = Runs(data, starts, length)
                hit = np.flatnonzero(in_bloom(known.value, runs.anchor))
                first, count, doc = runs.first[hit], runs.count[hit], runs.doc[hit]
                whole = memoryview(data)
                digest = xxhash.xxh3_128_digest
                names = np.frombuffer(b"".join(digest(whole[a:b]) for a, b in zip(first.tolist(), (first + count + (length - 1)).tolist(), strict=True)), np.int64).reshape(-1, 2)
                columns = [_signed(runs.anchor[hit]), *(pa.array(np.ascontiguousarray(names[:, i])) for i in (0, 1)), pa.array(k1[of[doc]]), pa.array(k2[of[doc]]), pa.array(runs.at[hit] + shifts[doc]), pa.array(count)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "d1", "d2", "k1", "k2", "at", "n"])

    seen = written(rows.select("text", "k1", "k2").mapInArrow(occurrences, "a long, d1 long, d2 long, k1 long, k2 long, at long, n long"))
    known.destroy()
    # Which occurrence stands for its run is only of meaning where the earliest is spared. Values of one aggregate's first rows are of one row.
    place = F.min(F.struct("k1", "k2", "at")) if keep_first else F.struct(F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("at").alias("at"))
    spans = written(seen.groupBy("a", "d1", "d2").agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), place.alias("first")))
    # Whole runs that occur again: all go, but for the first of them if that is spared.
    whole = seen.join(spans.filter("times > 1").select("a", "d1", "d2", "first"), ["a", "d1", "d2"])
    if keep_first:
        whole = whole.filter(F.struct("k1", "k2", "at") != F.col("first"))
    ranges = written(whole.select("k1", "k2", F.col("at").alias("start"), (F.col("at") + F.col("n") + (length - 1)).alias("end")))
    # One occurrence of each run of an anchor that has several runs.
    kinds = spans.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    several = written(spans.join(kinds, "a").select("a", (F.col("kinds") > class_runs).alias("hot"), "first.*", "n"))
    forget(seen, spans)
    cut_out = written(_segments(rows, several, length))
    forget(several)
    buckets = max(1, -(-cut_out.filter("not hot").count() // BUCKET_RUNS))

    def sort(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("a", "k1", "k2", "at")])
        a, k1, k2, at, n = (table.column(c).to_numpy() for c in ("a", "k1", "k2", "at", "n"))
        data = [x.as_buffer().to_pybytes() for x in table.column("data")]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]]).tolist()
        out: list[tuple[int, int, int]] = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            later, source = factors([(data[i], int(n[i])) for i in range(low, high)], length)
            gone = later if keep_first else [x or y for x, y in zip(later, source, strict=True)]
            begin = 0
            for i in range(low, high):
                out += [(i, x, y) for x, y in _stretches(gone[begin : begin + n[i]])]
                begin += int(n[i])
        row, x, y = (np.array([o[c] for o in out], np.int64) for c in range(3))
        return pa.table({"k1": pa.array(k1[row]), "k2": pa.array(k2[row]), "start": pa.array(at[row] + x), "end": pa.array(at[row] + y + length)})

    dealt = cut_out.filter("not hot").drop("hot").groupBy(F.pmod(F.xxhash64("a"), F.lit(buckets)).alias("bucket"))
    found = [ranges, written(dealt.applyInArrow(sort, "k1 long, k2 long, start long, end long"))]
    hot = cut_out.filter("hot")
    if not hot.isEmpty():
        # Places of large classes, each by the digest of its string.
        string = lambda i: F.substring(F.col("data"), i + 1, F.lit(length))
        digests = F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda i: F.struct(i.alias("i"), F.xxhash64(string(i)).alias("d1"), F.xxhash64(F.lit(1), string(i)).alias("d2")))
        each = hot.select("k1", "k2", "at", F.explode(digests).alias("p")).select("p.d1", "p.d2", "k1", "k2", (F.col("at") + F.col("p.i")).alias("place"))
        first = [F.min(F.struct("k1", "k2", "place")).alias("first")] if keep_first else []
        twice = each.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("times"), *first).filter("times > 1").drop("times")
        single = each.join(twice, ["d1", "d2"])
        if keep_first:
            single = single.filter(F.struct("k1", "k2", "place") != F.col("first"))
        found.append(written(single.select("k1", "k2", F.col("place").alias("start"), (F.col("place") + length).alias("end"))))
    forget(cut_out)
    return found


def _segments(rows: DataFrame, several: DataFrame, length: int) -> DataFrame:
    """The runs in `several` (a, hot, k1, k2, at, n) with their bytes."""
    wanted = rows.sparkSession.sparkContext.broadcast(bloom(several.select("k2").distinct(), "k2"))

    def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            pick = []
            for i in np.flatnonzero(in_bloom(wanted.value, batch.column(1).to_numpy())).tolist():
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key not in sent:
                    sent.add(key)
                    pick.append(i)
            yield batch.take(pa.array(pick, pa.int64()))

    texts = rows.filter(F.length("text") >= length).select("k1", "k2", "text").mapInArrow(once, "k1 long, k2 long, text binary")
    lists = several.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "hot", "at", "n")).alias("runs"))
    part = lambda r: F.substring(F.col("text"), (r["at"] + 1).cast("int"), (r["n"] + (length - 1)).cast("int"))
    cut = F.transform("runs", lambda r: F.struct(r["a"].alias("a"), r["hot"].alias("hot"), r["at"].alias("at"), r["n"].alias("n"), part(r).alias("data")))
    made = texts.join(lists, ["k1", "k2"]).select("k1", "k2", F.explode(cut).alias("r")).select("k1", "k2", "r.*")
    return made.dropDuplicates(["k1", "k2", "at"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = False, class_runs: int = CLASS_RUNS) -> DataFrame:
    """One row per row: doc_id, n_bytes, spans (array of start, end: the maximal ranges removed), kept (the remaining bytes).

    Removes each byte covered by a string of `length` bytes that also starts elsewhere; with keep_first, elsewhere and earlier, in an
    order of texts that is fixed but of no meaning.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    rows = keyed(docs, id_col, text_col)
    found = repeats(rows, length, keep_first, class_runs)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    cuts = written(every.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("cuts")))
    forget(*found)
    touched = rows.sparkSession.sparkContext.broadcast(bloom(cuts, "k2"))

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(in_bloom(touched.value, batch.column(3).to_numpy()))], names=["doc_id", "text", "k1", "k2", "touched"])

    known = rows.mapInArrow(marked, "doc_id long, text binary, k1 long, k2 long, touched boolean")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, cuts_ in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                made: list[list[int]] = []
                if cuts_.is_valid:
                    flat = cuts_.values
                    order = np.lexsort((flat.field(1).to_numpy(), flat.field(0).to_numpy()))
                    for a, b in zip(flat.field(0).to_numpy()[order].tolist(), flat.field(1).to_numpy()[order].tolist(), strict=True):
                        if made and a <= made[-1][1]:
                            made[-1][1] = max(made[-1][1], b)
                        else:
                            made.append([a, b])
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in made])
                edges = [0, *(x for r in made for x in r), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    out = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    some = known.filter("touched").join(cuts, ["k1", "k2"], "left").select("doc_id", "text", "cuts").mapInArrow(cut, out)
    none = known.filter("not touched").select("doc_id", F.length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.col("text").alias("kept"))
    return some.unionByName(none)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring_dedup(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return made.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
