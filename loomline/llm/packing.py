"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

Documents become token ids and an end id; one longer than a sequence is cut into whole sequences and, before them, the rest.
Pieces are dealt by hash into shards of a few thousand. A solution is a list of bins. Parents are won in tournaments. Crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold an injected piece a second time, and best-fits the displaced
pieces; mutation empties the worst-filled bins and some others in the same way. Before displaced pieces are fitted, they change places with
smaller ones, or pairs of them, where that fills a bin better. A search ends at the lower bound, or once PATIENCE children in a row
bring no gain. Every shard is evolved on several islands, each a task of its own with its own seed; between rounds an
island's elite moves to the next one on the ring, by a shuffle. A shard keeps its islands' best solution, and badly filled bins of all
shards meet in a last round, evolved in the same way.

Scale: texts are tokenized where they are read; what is shuffled after that is a row of numbers per piece. Pieces are dealt by the number of
their row, so shards are of bounded size whatever the input and however often a row repeats, and all shards' islands run in parallel.
Rounds are cut by checkpoints.

Ids are those of the library `tokenizers` for the given file. Where that file is a plain byte-level BPE whose ranks are its ids, they are
made by `tiktoken` from the same vocabulary, three times as fast; a test holds both against each other.

Defined results: null text counts as empty, a piece of the end id alone; rows that repeat are packed each; a null doc_id is kept.
"""

from __future__ import annotations

import json
import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.shared import blank_null, checkpointed, documents, kept_in_worker, written

SEQUENCE = 1024
END_ID = 2
SHARD_PIECES = 4096
ISLANDS = 3
ROUNDS = 2
POPULATION = 8
PATIENCE = 10
#: Displaced pieces of which pairs are tried, and bins that a child's displaced pieces are held against.
PAIRED, TRIED = 48, 256
WELL_FILLED = 0.98
BADLY_FILLED = 0.9

# Fixed value: how this family of vocabularies splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids, as unsigned 32-bit numbers. A process loads a file once."""
    return kept_in_worker(("encoder", path), lambda: _loaded(path))


def _loaded(path: str) -> Callable[[str], np.ndarray]:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    pre, bpe = model.get("pre_tokenizer") or {}, model["model"]
    vocab, special = bpe.get("vocab", {}), {t["content"] for t in model.get("added_tokens", [])}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe.get("merges", [])]
    ranked = bpe.get("type", "BPE") == "BPE" and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    if ranked and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("normalizer") and not bpe.get("ignore_merges"):
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        return _tiktoken_ids(ranks)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def _tiktoken_ids(ranks: dict[bytes, int]) -> Callable[[str], np.ndarray]:
    import tiktoken

    made = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda text: made.encode_to_numpy(text, disallowed_special=())


def pieces_of(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Of rows doc_id, text: a row per piece with piece, start, length, ids_crc32, a number of its own and, if asked for, its ids as little-endian bytes."""
    if sequence < 1:
        raise ValueError("sequence must be positive")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row", *(["ids"] if with_ids else [])]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, which = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py()), end_id).astype("<u4")
                first = len(ids) % sequence or sequence
                at = 0
                for n, to in enumerate(range(first, len(ids) + 1, sequence)):
                    own = ids[at:to].tobytes()
                    rows.append((n, at, to - at, zlib.crc32(own), row, *([own] if with_ids else [])))
                    which.append(i)
                    at, row = to, row + 1
            columns = [*zip(*rows, strict=True)] or [()] * (len(names) - 1)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names=names)

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + ", ids binary" * with_ids)


Bins = list[list[int]]


def fills_of(bins: Bins, lengths: list[int]) -> list[int]:
    return [sum(map(lengths.__getitem__, b)) for b in bins]


def best_fit(bins: Bins, loose: Iterable[int], lengths: list[int], capacity: int, fills: list[int] | None = None) -> Bins:
    """Puts each loose piece, longest first, into the fullest bin that has room for it, or into a new one. Keeps `fills`, if given."""
    fills = fills_of(bins, lengths) if fills is None else fills
    loose = sorted(loose, key=lambda i: -lengths[i])
    if not loose:
        return bins
    least = lengths[loose[-1]]
    room = sorted((capacity - f, k) for k, f in enumerate(fills) if capacity - f >= least)
    for i in loose:
        at = bisect_left(room, (lengths[i], -1))
        if at == len(room):
            r, k = capacity, len(bins)
            bins.append([])
            fills.append(0)
        else:
            r, k = room.pop(at)
        bins[k].append(i)
        fills[k] += lengths[i]
        if r - lengths[i] >= least:
            insort(room, (r - lengths[i], k))
    return bins


def fitness(bins: Bins, lengths: list[int], capacity: int, fills: list[int] | None = None) -> tuple[int, float]:
    """Fewer bins are better; of as many, those with full and empty ones rather than all half full."""
    return -len(bins), sum((f / capacity) ** 2 for f in (fills_of(bins, lengths) if fills is None else fills))


def exchanged(bins: Bins, fills: list[int], loose: list[int], lengths: list[int], capacity: int, rng: random.Random) -> list[int]:
    """Fills bins better by changing one or two of their pieces for one or two loose ones; returns what is loose after that."""
    loose = sorted(loose, key=lengths.__getitem__)
    order = [k for k, f in enumerate(fills) if f < capacity]
    sizes = [lengths[i] for i in loose]
    pairs = _pairs(sizes)
    for k in rng.sample(order, min(len(order), TRIED)):
        if not loose:
            break
        own, slack = bins[k], capacity - fills[k]
        out = [(lengths[x], (x,)) for x in own] + [(lengths[x] + lengths[y], (x, y)) for n, x in enumerate(own) for y in own[:n]]
        best, what = 0, None
        for size, gone in out:
            at = bisect_right(sizes, size + slack) - 1
            if at >= 0 and sizes[at] - size > best:
                best, what = sizes[at] - size, (gone, (at,))
            at = bisect_right(pairs, (size + slack, len(sizes), 0)) - 1
            if at >= 0 and pairs[at][0] - size > best:
                best, what = pairs[at][0] - size, (gone, pairs[at][1:])
            if best == slack:
                break
        if what:
            gone, came = what
            bins[k] = [x for x in own if x not in gone] + [loose[i] for i in came]
            fills[k] += best
            loose = sorted([x for i, x in enumerate(loose) if i not in came] + list(gone), key=lengths.__getitem__)
            sizes = [lengths[i] for i in loose]
            pairs = _pairs(sizes)
    return loose


def _pairs(sizes: list[int]) -> list[tuple[int, int, int]]:
    """Sums of two sizes with their places, ascending; none if there are too many sizes."""
    return sorted((sizes[i] + sizes[j], i, j) for i in range(len(sizes)) for j in range(i)) if len(sizes) <= PAIRED else []


def child_of(a: Bins, fills: list[int], b: Bins, other: list[int], lengths: list[int], capacity: int, rng: random.Random) -> tuple[Bins, list[int]]:
    """A child of two solutions, given with their bins' fills, and its own fills.

    Crossover: some well-filled bins of `b` enter `a` whole, those they clash with go, and what else these held is displaced. Mutation: the
    worst-filled bins and some others are emptied. Then all displaced pieces are placed.
    """
    at = [0] * len(lengths)
    for k, x in enumerate(a):
        for i in x:
            at[i] = k
    # Few enough that what they displace can be placed well.
    some = rng.sample(range(len(b)), min(len(b), 4 * PAIRED))
    injected = [b[k] for k in some if other[k] >= WELL_FILLED * capacity and len({at[i] for i in b[k]}) + abs(len(a[at[b[k][0]]]) - len(b[k])) > 1][: rng.randint(1, PAIRED // 8)]
    taken = {i for x in injected for i in x}
    gone = {at[i] for i in taken}
    worst = nsmallest(rng.randint(1, 3), (k for k in range(len(a)) if k not in gone), key=fills.__getitem__)
    gone |= {*worst, *rng.sample(range(len(a)), min(len(a), rng.randint(1, 4)))}
    loose = [i for k in gone for i in a[k] if i not in taken]
    bins = [[*x] for k, x in enumerate(a) if k not in gone] + [[*x] for x in injected]
    fills = [f for k, f in enumerate(fills) if k not in gone] + [sum(map(lengths.__getitem__, x)) for x in injected]
    return best_fit(bins, exchanged(bins, fills, loose, lengths, capacity, rng), lengths, capacity, fills), fills


def least_bins(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins: all lengths in full bins, or as many as there are pieces of more than half."""
    return max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))


def evolve(lengths: list[int], capacity: int, seed: int, population: Iterable[Bins] = (), patience: int = PATIENCE, size: int = POPULATION) -> list[Bins]:
    """The population when its search ends, best first. Begins with best-fit decreasing and variants of it that hold back some pieces."""
    rng = random.Random(seed)
    everyone = range(len(lengths))
    bound = least_bins(lengths, capacity)
    people: list[tuple] = []
    made = 0

    def born(bins: Bins, fills: list[int]) -> None:
        nonlocal made
        people.append((fitness(bins, lengths, capacity, fills), -made, bins, fills))
        people.sort(key=lambda p: p[:2], reverse=True)
        made += 1

    for bins in population:
        born(bins, fills_of(bins, lengths))
    if not people:
        born(bins := best_fit([], everyone, lengths, capacity), fills_of(bins, lengths))
    while len(people) < size and len(people[0][2]) > bound:
        late = set(rng.sample(everyone, len(lengths) // 8))
        born(bins := best_fit(best_fit([], [i for i in everyone if i not in late], lengths, capacity), late, lengths, capacity), fills_of(bins, lengths))
    del people[size:]
    # A gain is a bin less, or a good part of the emptiest one emptied.
    state = lambda: (len(people[0][2]), min(people[0][3], default=0) * 16 // capacity)
    best, stale = state(), 0
    while stale < patience and len(people[0][2]) > bound:
        a, b = (max(rng.sample(people, min(2, len(people))), key=lambda p: p[:2]) for _ in range(2))
        bins, fills = child_of(*a[2:], *b[2:], lengths, capacity, rng)
        if all(fitness(bins, lengths, capacity, fills) != p[0] for p in people):
            born(bins, fills)
            del people[size:]
        best, stale = (state(), 0) if state() < best else (best, stale + 1)
    return [p[2] for p in people]


def _numbered(bins: Bins, n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _as_bins(numbers: bytes) -> Bins:
    numbers = np.frombuffer(numbers, np.int32)
    order = np.argsort(numbers, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1)] if len(numbers) else []


_ORDER = [("row", "ascending")]


def pack(pieces: DataFrame, sequence: int = SEQUENCE, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """The pieces with sequence_id and offset. `pieces` must be a stored table, as it is read several times; row tells all of them apart."""
    columns, own = ["doc_id", "piece", "start", "length", "ids_crc32"], ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
    part = pieces.filter(F.col("length") < sequence)
    shards = max(1, -(-part.count() // shard_pieces))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long")
    items = part.select(shard.alias("shard"), *own)

    def bred(shard_no: int, island: int, turn: int, table: pa.Table, found: list[bytes]) -> pa.Table:
        lengths = table.sort_by(_ORDER).column("length").to_pylist()
        people = evolve(lengths, sequence, hash((seed, shard_no, island, turn)), [_as_bins(x) for x in found])
        return pa.table({
            "shard": pa.array([shard_no] * len(people), pa.int64()), "island": pa.array([island] * len(people), pa.int32()), "place": pa.array(range(len(people)), pa.int32()),
            "bins": pa.array(map(len, people), pa.int64()), "squares": pa.array([fitness(x, lengths, sequence)[1] for x in people], pa.float64()), "solution": pa.array([_numbered(x, len(lengths)) for x in people], pa.binary()),
        })

    def first(key: tuple, table: pa.Table) -> pa.Table:
        return bred(key[0].as_py(), key[1].as_py(), 0, table, [])

    def later(turn: int):
        def breed(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
            ranked = found.sort_by([("bins", "ascending"), ("squares", "descending"), ("place", "ascending")])
            return bred(key[0].as_py(), key[1].as_py(), turn, table, ranked.column("solution").to_pylist())

        return breed

    people_schema = "shard long, island int, place int, bins long, squares double, solution binary"
    spread = items.select("shard", "row", "length").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    people = checkpointed(spread.groupBy("shard", "island").applyInArrow(first, people_schema))
    for turn in range(1, rounds):
        elite = people.filter("place = 0").withColumn("island", (F.col("island") + 1) % islands)
        moved = people.unionByName(elite) if islands > 1 else people

        people = checkpointed(spread.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island")).applyInArrow(later(turn), people_schema))
    best = people.groupBy("shard").agg(F.min_by("solution", F.struct("bins", -F.col("squares"), "island", "place")).alias("solution"))

    def settle(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        table = table.sort_by(_ORDER).select(own)
        numbers = np.frombuffer(found.column("solution")[0].as_py(), np.int32)
        return _placed(table, numbers, key[0].as_py())

    out_schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, fill long"
    placed = checkpointed(items.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(settle, out_schema))
    # Whole bins with much room, dealt anew by their sequence: repacked where that takes fewer.
    poor = F.col("fill") < BADLY_FILLED * sequence
    bad = placed.filter(poor)
    groups = max(1, -(-bad.count() // shard_pieces))

    def again(key: tuple, table: pa.Table) -> pa.Table:
        old = len(pc.unique(table.column("sequence_id")))
        sorted_ = table.sort_by(_ORDER).select([*own, "sequence_id", "offset", "fill"])
        bins = evolve(sorted_.column("length").to_pylist(), sequence, hash((seed, key[0].as_py(), -1)))[0]
        if len(bins) >= old:
            return sorted_
        return _placed(sorted_.select(own), np.frombuffer(_numbered(bins, len(sorted_)), np.int32), shards + key[0].as_py())

    fixed = bad.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("group")).applyInArrow(again, out_schema)
    # Sequences of one whole piece are numbered below zero.
    per = F.monotonically_increasing_id()
    full = checkpointed(pieces.filter(F.col("length") == sequence).select(*columns, (-per - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return placed.filter(~poor).drop("fill", "row").unionByName(fixed.drop("fill", "row")).unionByName(full)


def _placed(table: pa.Table, numbers: np.ndarray, shard: int) -> pa.Table:
    """The rows by bin, with sequence ids of their shard's own range, offsets and each bin's fill."""
    order = np.argsort(numbers, kind="stable")
    table, numbers = table.take(pa.array(order)), numbers[order].astype(np.int64)
    lengths = table.column("length").to_numpy()
    ends = np.cumsum(lengths)
    first = np.concatenate([[True], numbers[1:] != numbers[:-1]]) if len(numbers) else np.zeros(0, bool)
    bin_no = np.cumsum(first) - 1
    base = (ends - lengths)[first][bin_no]
    fill = np.bincount(bin_no, lengths).astype(np.int64)[bin_no] if len(numbers) else lengths
    return table.append_column("sequence_id", pa.array((np.int64(shard) << 24) + numbers, pa.int64())).append_column("offset", pa.array(ends - lengths - base, pa.int64())).append_column("fill", pa.array(fill, pa.int64()))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), blank_null(text_col).alias("text"))
    return pack(written(pieces_of(rows, tokenizer or default_tokenizer(), sequence, end_id)), sequence, **options)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
