"""LM scoring with a hierarchical Pitman-Yor model whose Chinese-restaurant seating is sampled by Gibbs.

The word before a word chooses its restaurant; a table of a restaurant is a customer of the root, so restaurants share what they learn:

    restaurant of the word before  ->  all words  ->  uniform over the known words and one unknown

A text's first word has the restaurant of text ends. There is a restaurant for every CONTEXT_TOKENS tokens, so their number grows with the
corpus (up to MOST_CONTEXTS); words before are dealt to restaurants by hash, so common ones have their own in effect, and rare ones that
meet in one share it. A seating is kept by its counts, customers and tables of each dish (a restaurant and a word): given all others, the
number of tables of a dish is drawn at once from its exact conditional distribution, with generalised Stirling numbers of the discount
counting the seatings. That re-seats all customers of the dish; every dish is drawn in every sweep. Dishes of more than EXACT customers are
drawn in groups that grow by an eighth, as their Stirling numbers are too many. Predictive probabilities of several samples are averaged.

Words are dealt by hash into buckets, each of which holds all restaurants' customers for its words, and so their dishes at the root. What a
bucket needs of others is the number of tables in each restaurant and at the root: those are exchanged, first with one table per dish, then
as sampled, by sums over a tree of buckets, and sent to all. Words that are too common for one bucket (`hot_words`) are dealt by word and
restaurant; their customers at the root are exchanged in the same way.

Scale: texts are read twice (hot words; pairs) and never shuffled. What a chunk of texts sends to a bucket is its distinct pairs of word and
restaurant with their training counts, and back come their log probabilities; the chunk's own sequence of word numbers turns those into
sums per text. Rows between chunks and buckets hold packed arrays. Sums per restaurant on the driver are bounded by MOST_CONTEXTS, those per
hot word by 2 / LEAST_SHARE.

Defined results: null text counts as empty, whose only token is its end; a null doc_id is trained on; rows that repeat are trained on and
scored each; without training rows every token is unknown. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.shared import blank_null, documents, forget, kept_in_worker, sweep, written
from loomline.llm.words import mixed, word_codes, word_hashes

CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 1 << 13
BUCKET_TOKENS = 1_000_000
#: Tokens for each restaurant, and the most restaurants there are.
CONTEXT_TOKENS, MOST_CONTEXTS = 256, 1 << 22
#: A word is hot if it makes up so many tokens, and no less than this share.
HOT_TOKENS, LEAST_SHARE = 250_000, 2.0**-19
#: Discount and strength of the root and of the restaurants.
DISCOUNT, STRENGTH = (0.75, 0.8), (1.0, 4.0)
#: Sweeps before tables are exchanged; before the first sample; and samples.
SETTLED, BURN_IN, SAMPLES = 4, 2, 3
#: Parts of a unit of a log10 probability that are sent back; 16 bits reach to 1e-32.
FINE = 2000.0
#: Customers of a dish up to which its tables are drawn from Stirling numbers.
EXACT = 64
#: The end of a text, as a word.
END = np.uint64(0x9AE16A3B2F90404F)
_BUCKET = np.uint64(0xC2B2AE3D27D4EB4F)
_BLOCK = 1 << 16


def is_train(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 != 0


def planes(x: np.ndarray, width: int = 4) -> bytes:
    """Unsigned numbers by bytes of one rank: the upper ones are mostly zero and compress to nothing."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def numbers(data: pa.Scalar, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data.as_buffer(), np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers, how many there are first, compressed."""
    return np.int64(len(x)).tobytes() + pa.compress(planes(x), codec="zstd", asbytes=True)


def restored(data: pa.Scalar) -> np.ndarray:
    raw = data.as_buffer().to_pybytes()
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    plain = pa.decompress(raw[8:], decompressed_size=4 * n, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int32)


@dataclass
class Plan:
    """How pairs are dealt: numbers of restaurants and buckets, and hashes of hot words, ascending."""

    contexts: int
    buckets: int
    hot: np.ndarray

    def place(self, words: np.ndarray) -> np.ndarray:
        """Which hot word each is, or -1."""
        spot = np.minimum(np.searchsorted(self.hot, words), max(0, len(self.hot) - 1))
        return np.where(self.hot[spot] == words, spot, -1) if len(self.hot) else np.full(len(words), -1)


class Pairs:
    """The distinct pairs of a word and the word before it in a chunk, as they are dealt: by bucket, in it by word.

    codes: the chunk's tokens as numbers of its words, an end (0) after each text. buckets: of each word, `hot` for those that are dealt by pair,
    whose own buckets `of_pair` is or gives. index: each token's pair. first: where a run of one word in one bucket begins.
    """

    def __init__(self, codes: np.ndarray, buckets: np.ndarray, hot: int, of_pair: np.ndarray | Callable[[np.ndarray, np.ndarray], np.ndarray]):
        pairs = codes * np.int64(len(buckets))
        pairs[1:] += codes[:-1]
        keys, index = np.unique(pairs, return_inverse=True)
        del pairs
        index = index.astype(np.int32)
        word, before = keys // len(buckets), (keys % len(buckets)).astype(np.int32)
        del keys
        bucket = buckets[word].astype(np.int64)
        spread = np.flatnonzero(bucket == hot)
        self.hot = of_pair(word[spread], before[spread]) if callable(of_pair) else of_pair
        bucket[spread] = self.hot
        order = np.argsort(bucket, kind="stable")
        at = np.empty(len(order), np.int32)
        at[order] = np.arange(len(order), dtype=np.int32)
        self.index, self.word, self.before, self.bucket = at[index], word[order], before[order], bucket[order]
        change = np.ones(len(order), bool)
        change[1:] = (self.word[1:] != self.word[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        self.first = np.flatnonzero(change)


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's tokens as numbers of its words, common ones small; tokens per text; hashes of the words, the first that of an end."""
    codes, starts, words = word_codes(texts)
    often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    rank = np.empty(len(often), np.int32)
    rank[often] = np.arange(1, len(often) + 1, dtype=np.int32)
    sizes = np.diff(starts) + 1
    out = np.zeros(sizes.sum(), np.int32)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = rank[codes]
    return out, sizes, np.concatenate([[END], word_hashes(words)[often]])


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(n, t): how n customers sit at t tables, weighted by what their tables' sizes are worth."""

    def made() -> np.ndarray:
        out = np.full((most + 1, most + 1), -np.inf)
        out[0, 0] = 0
        with np.errstate(divide="ignore"):
            for n in range(most):
                stay = out[n] + np.log(np.maximum(n - discount * np.arange(most + 1), 0))
                out[n + 1] = np.logaddexp(np.concatenate([[-np.inf], out[n, :-1]]), stay)
        return out

    return kept_in_worker(("stirling", discount, most), made)


def draw_tables(n: np.ndarray, others: np.ndarray, prior: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of n customers, given the tables of all other dishes of their restaurants and the parent's probability of the dish."""
    out = np.minimum(n, 1)
    stirling = log_stirling(discount)
    for low, high in ((2, 4), (5, 16), (17, EXACT)):
        every = np.flatnonzero((n >= low) & (n <= high))
        for at in range(0, len(every), part := (1 << 20) // high):
            own = every[at : at + part]
            # The t-th table opens with a weight of strength + discount * (all tables before it), times the parent's probability.
            opens = np.log(strength + discount * (others[own, None] + np.arange(high))) + np.log(prior[own])[:, None]
            weight = stirling[n[own], 1 : high + 1] + np.cumsum(opens, axis=1)
            share = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[own] = np.minimum((share < rng.random(len(own))[:, None] * share[:, -1:]).sum(axis=1) + 1, n[own])
    large = np.flatnonzero(n > EXACT)
    if len(large):
        out[large] = _in_groups(n[large], others[large], prior[large], discount, strength, rng)
    return out


def _in_groups(n: np.ndarray, others: np.ndarray, prior: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of large dishes: customers enter in groups of an eighth of those who sit, each group at the probabilities that it finds."""
    seated, tables = np.ones(len(n), np.int64), np.ones(len(n), np.int64)
    while len(open_ := np.flatnonzero(seated < n)):
        k = np.minimum(np.maximum(seated[open_] // 8, 1), n[open_] - seated[open_])
        fresh = (strength + discount * (others[open_] + tables[open_])) * prior[open_]
        tables[open_] += rng.binomial(k, fresh / (fresh + np.maximum(seated[open_] - discount * tables[open_], 1e-9)))
        seated[open_] += k
    return tables


class Totals:
    """What all buckets know of each other. sums: of each restaurant its tables and customers; then of each hot word its customers at the root and
    its count; then the root's tables of other words, and their number. first: these are of one table per dish."""

    def __init__(self, sums: np.ndarray, plan: Plan, seed: int, first: bool):
        k, h = plan.contexts, len(plan.hot)
        self.first = first
        self.tables, self.customers = sums[0, :k].astype(np.float32), sums[1, :k].astype(np.float32)
        hot, self.hot_count = sums[0, k : k + h], sums[1, k : k + h]
        self.root_customers, self.tokens = int(sums[0, :k].sum()), int(sums[1, :k].sum())
        self.vocabulary = int(sums[1, k + h] + (self.hot_count > 0).sum())
        self.floor = 1.0 / (self.vocabulary + 1)
        found = float(sums[0, k + h] + (hot > 0).sum())
        tables = draw_tables(hot, np.full(h, found), np.full(h, self.floor), DISCOUNT[0], STRENGTH[0], np.random.default_rng(seed))
        self.root_tables = float(sums[0, k + h] + tables.sum())
        self.hot_p = self.common(self.hot_count) if first else self.root(hot, tables, 1.0, 1.0)

    def common(self, count: np.ndarray) -> np.ndarray:
        """Where a search begins: the root's probabilities as if each customer of a restaurant had a table."""
        return (count + self.floor) / (self.tokens + 1)

    def root(self, customers: np.ndarray, tables: np.ndarray, more_customers: float, more_tables: float) -> np.ndarray:
        d, s = DISCOUNT[0], STRENGTH[0]
        return (customers - d * tables + (s + d * self.root_tables * more_tables) * self.floor) / (s + self.root_customers * more_customers)

    def leaf(self, context: np.ndarray, customers: np.ndarray, tables: np.ndarray, root: np.ndarray) -> np.ndarray:
        d, s = DISCOUNT[1], STRENGTH[1]
        return (customers - d * tables + (s + d * self.tables[context]) * root) / (s + self.customers[context])


class Bucket:
    """A bucket's dishes: word, restaurant, customers. index: the dish of each pair that a chunk sent; chunks: how many pairs and runs each did."""

    def __init__(self, table: pa.Table, plan: Plan):
        table = table.sort_by("chunk")
        words = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("a")]
        runs, contexts, counts = ([numbers(x) for x in table.column(c)] for c in "bcd")
        self.known, self.runs = np.unique(np.concatenate(words), return_inverse=True)
        word = np.repeat(self.runs.astype(np.uint64), np.concatenate(runs))
        keys, self.index = np.unique(word << np.uint64(32) | np.concatenate(contexts).astype(np.uint64), return_inverse=True)
        self.word, self.context = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.n = np.bincount(self.index, np.concatenate(counts), len(keys)).astype(np.int64)
        self.place = plan.place(self.known)
        self.chunks = list(zip(table.column("chunk").to_pylist(), map(len, contexts), map(len, runs), strict=True))

    def sweeps(self, totals: Totals, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """After each Gibbs sweep: tables of dishes, root tables of words, and the root's probability of words.

        As long as the totals are those of one table per dish, others' tables are taken to have grown as the bucket's own, in restaurants of
        like size; so the first sampled totals are near those of a settled seating.
        """
        rng, tables = np.random.default_rng(seed), np.minimum(self.n, 1)
        several = np.flatnonzero(self.n > 1)
        hot = self.place >= 0
        size = np.minimum(np.log2(totals.customers[self.context] + 1).astype(np.int64), 63)
        seen, words = np.bincount(size, self.n > 0, 64), max(1, len(np.unique(self.word[self.n > 0])))
        grown, more_customers, more_tables = np.ones(64), 1.0, 1.0
        # The first draw is from word counts, as seatings with a table per dish are far from settled ones.
        root = totals.common(self.counts(totals))
        while True:
            others = np.maximum(totals.tables[self.context[several]] * grown[size[several]] - tables[several], 0).astype(float)
            tables[several] = draw_tables(self.n[several], others, root[self.word[several]], DISCOUNT[1], STRENGTH[1], rng)
            customers = np.bincount(self.word, tables, len(self.known)).astype(np.int64)
            every = np.full(len(customers), totals.root_tables * more_tables)
            root_tables = draw_tables(customers, every, np.full(len(customers), totals.floor), DISCOUNT[0], STRENGTH[0], rng)
            if totals.first and len(several):
                more_customers, more_tables = tables.sum() / max(1, seen.sum()), root_tables.sum() / words
                grown = (np.bincount(size, tables, 64) + more_customers) / (seen + 1)
            root = totals.root(customers, root_tables, more_customers, more_tables)
            root[hot] = totals.hot_p[self.place[hot]]
            yield tables, root_tables, root

    def sums(self, plan: Plan, totals: Totals | None, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, ascending, of what Totals sums up, and this bucket's parts of both sums: with one table per dish, or as sampled."""
        tables, hot = np.minimum(self.n, 1), self.place >= 0
        root_tables = np.bincount(self.word, tables, len(self.known)) > 0
        if totals is not None:
            for turn, (tables, root_tables, _) in enumerate(self.sweeps(totals, seed)):
                if turn == SETTLED:
                    break
        seen, context = np.unique(self.context, return_inverse=True)
        x, y = np.bincount(context, tables, len(seen)), np.bincount(context, self.n, len(seen))
        own, count = np.bincount(self.word, tables, len(self.known)), np.bincount(self.word, self.n, len(self.known))
        ids = np.concatenate([seen, plan.contexts + self.place[hot], [plan.contexts + len(plan.hot)]])
        return ids, np.concatenate([x, own[hot], [root_tables[~hot].sum()]]).astype(np.int64), np.concatenate([y, count[hot], [(count[~hot] > 0).sum()]]).astype(np.int64)

    def probabilities(self, totals: Totals, seed: int) -> np.ndarray:
        """Predictive probabilities of the dishes, averaged over samples."""
        out = np.zeros(len(self.n))
        for turn, (tables, _, root) in enumerate(self.sweeps(totals, seed)):
            if turn >= BURN_IN:
                out += totals.leaf(self.context, self.n, tables, root[self.word])
            if turn == BURN_IN + SAMPLES - 1:
                return out / SAMPLES

    def counts(self, totals: Totals) -> np.ndarray:
        """Training counts of the words."""
        own = np.bincount(self.word, self.n, len(self.known)).astype(np.int64)
        own[self.place >= 0] = totals.hot_count[self.place[self.place >= 0]]
        return own


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded text, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, min(at + CHUNK_ROWS, int(np.searchsorted(ends, base + CHUNK_BYTES, "right"))))
            yield batch.slice(at, to - at)
            at = to


PACKED = "kind int, bucket long, chunk long, a binary, b binary, c binary, d binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "bucket", "chunk", "a", "b", "c", "d"])


def hot_words(rows: DataFrame, tokens: float) -> np.ndarray:
    """Hashes, ascending, of words too common for one bucket. A word with a share of the corpus has that share of a part of it, which names it."""
    share = max(HOT_TOKENS / max(tokens, 1.0), LEAST_SHARE)
    if share >= 1:
        return np.zeros(0, np.uint64)

    def common(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            codes, _, words = word_codes(batch.column(1))
            counts = np.bincount(codes, minlength=len(words))
            often = np.flatnonzero(counts >= share * (len(codes) + len(batch)))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(word_hashes(words.take(pa.array(often))), END).view(np.int64)), pa.array(np.append(counts[often], len(batch)))], names=["word", "n"])

    found = rows.mapInArrow(common, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= share * tokens / 2).select("word").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, plan: Plan | None = None, exchanges: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; trained on rows that aren't held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), blank_null(text_col).alias("text"))
    if plan is None:
        # Tokens by the length of the texts: it steers only how work is dealt.
        size, texts = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
        tokens = (size or 0) / 6.0 + texts
        plan = Plan(int(min(MOST_CONTEXTS, max(256, tokens / CONTEXT_TOKENS))), max(1, int(tokens / BUCKET_TOKENS)), hot_words(rows, tokens))
    send = rows.sparkSession.sparkContext.broadcast
    dealt_as = (plan.contexts, plan.buckets, plan.hot)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, plan_ = TaskContext.get().partitionId() << 32, Plan(*dealt_as)
        for batch in _chunks(batches):
            codes, sizes, words = coded(batch.column(1))
            ids = batch.column(0)
            train = np.array([is_train(d) for d in ids.to_pylist()], bool)
            contexts = mixed(words) % np.uint64(plan_.contexts)
            own = np.where(plan_.place(words) >= 0, np.uint64(plan_.buckets), mixed(words ^ _BUCKET) % np.uint64(plan_.buckets))
            pairs = Pairs(codes, own, plan_.buckets, lambda w, u, words=words, contexts=contexts: (mixed(words[w] ^ mixed(contexts[u] + _BUCKET)) % np.uint64(plan_.buckets)).astype(np.int64))
            counts = np.bincount(pairs.index, np.repeat(train, sizes), len(pairs.word)).astype(np.int64)
            about = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() + ids.is_valid().to_numpy(zero_copy_only=False).tobytes() + train.tobytes()
            out = [(1, -1, chunk, squeezed(codes), planes(sizes), squeezed(np.concatenate([own.astype(np.int64), pairs.hot])), about)]
            ends = np.append(np.flatnonzero(np.diff(pairs.bucket)) + 1, len(pairs.bucket))
            runs = np.append(pairs.first, len(pairs.bucket))
            for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                low, high = np.searchsorted(pairs.first, (a, b))
                out.append((0, int(pairs.bucket[a]), chunk, words[pairs.word[pairs.first[low:high]]].tobytes(), planes(np.diff(runs[low : high + 1])), planes(contexts[pairs.before[a:b]]), planes(counts[a:b])))
            yield _packed(out)
            chunk += 1

    packed = written(rows.mapInArrow(pack, PACKED))
    dealt = packed.filter("kind = 0").select("bucket", "chunk", "a", "b", "c", "d")
    totals, shared = None, None
    for turn in range(exchanges):
        sums = _exchanged(dealt, dealt_as, shared, seed + turn)
        totals = Totals(sums, plan, seed + turn, turn == 0)
        # Plain values: what is broadcast is read where this package may be unknown.
        shared = send(vars(totals))
        sweep(rows.sparkSession)

    def score(key: tuple, table: pa.Table) -> pa.Table:
        about = Totals.__new__(Totals)
        vars(about).update(shared.value)
        bucket = Bucket(table, Plan(*dealt_as))
        # Rounded to a part of FINE: far below what sampling leaves open.
        log_p = np.rint(np.log10(bucket.probabilities(about, seed * 1_000_003 + key[0].as_py())) * -FINE).astype("<u2")[bucket.index]
        count = bucket.counts(about)[bucket.runs]
        out: list[list] = [[], [], []]
        at = run = 0
        for chunk, n, m in bucket.chunks:
            for column, value in zip(out, (chunk, log_p[at : at + n].tobytes(), planes(count[run : run + m], 8)), strict=True):
                column.append(value)
            at, run = at + n, run + m
        nothing = pa.nulls(len(out[0]), pa.binary())
        return pa.table({"kind": pa.array([0] * len(out[0]), pa.int32()), "bucket": pa.array([key[0].as_py()] * len(out[0]), pa.int64()), "chunk": pa.array(out[0], pa.int64()), "a": pa.array(out[1], pa.binary()), "b": pa.array(out[2], pa.binary()), "c": nothing, "d": nothing})

    answers = dealt.groupBy("bucket").applyInArrow(score, PACKED)
    norm = float(np.log10(totals.tokens + 0.1 * (totals.vocabulary + 1)))

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "descending"), ("bucket", "ascending")])
        sizes, codes, dealt_to = numbers(table.column("b")[0]), restored(table.column("a")[0]), restored(table.column("c")[0])
        words = int(codes.max()) + 1
        about, n = table.column("d")[0].as_buffer().to_pybytes(), len(sizes)
        ids, flags = np.frombuffer(about, np.int64, n), np.frombuffer(about, np.bool_, 2 * n, 8 * n)
        pairs = Pairs(codes, dealt_to[:words], dealt_as[1], dealt_to[words:].astype(np.int64))
        del codes
        back = table.slice(1)
        log_p = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in back.column("a")]) / -FINE
        count = np.concatenate([numbers(x, 8) for x in back.column("b")])
        run = np.searchsorted(pairs.first, np.arange(len(pairs.word)), "right") - 1
        doc, base = np.repeat(np.arange(n), sizes), np.log10(count + 0.1)[run]
        total = lambda values: np.bincount(doc, values[pairs.index], n)
        return pa.table({
            "doc_id": pa.array(ids, mask=~flags[:n]), "held_out": pa.array(~flags[n:]), "n_tokens": pa.array(sizes),
            "n_known": pa.array(total((count > 0)[run]).astype(np.int64)), "base_score": pa.array(total(base) - sizes * norm), "score": pa.array(total(log_p)),
        })

    made = answers.unionByName(packed.filter("kind = 1")).groupBy("chunk").applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return made.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _exchanged(dealt: DataFrame, dealt_as: tuple, shared, seed: int) -> np.ndarray:
    """Both sums of Totals over all buckets: in blocks of numbers, 64 parts at a time."""

    def parts(key: tuple, table: pa.Table) -> pa.Table:
        totals = None
        if shared is not None:
            totals = Totals.__new__(Totals)
            vars(totals).update(shared.value)
        plan = Plan(*dealt_as)
        return _blocks(*Bucket(table, plan).sums(plan, totals, seed * 1_000_003 + key[0].as_py()), key[0].as_py())

    def added(key: tuple, table: pa.Table) -> pa.Table:
        sums = np.zeros((2, _BLOCK), np.int64)
        for at, x, y in zip(table.column("at"), table.column("x"), table.column("y"), strict=True):
            sums[:, numbers(at)] += np.stack([numbers(x, 8), numbers(y, 8)])
        at = np.flatnonzero(sums.any(axis=0))
        return _blocks(at + key[0].as_py() * _BLOCK, *sums[:, at], key[1].as_py())

    contexts, buckets, hot = dealt_as
    schema = "block long, part long, at binary, x binary, y binary"
    out, left = dealt.groupBy("bucket").applyInArrow(parts, schema), buckets
    while True:
        left = -(-left // 64)
        out = out.withColumn("part", F.floor(F.col("part") / 64)).groupBy("block", "part").applyInArrow(added, schema)
        if left == 1:
            break
    sums = np.zeros((2, contexts + len(hot) + 1), np.int64)
    stored = written(out)
    for row in stored.toArrow().to_batches():
        for block, at, x, y in zip(row.column("block").to_pylist(), row.column("at"), row.column("x"), row.column("y"), strict=True):
            sums[:, numbers(at) + block * _BLOCK] += np.stack([numbers(x, 8), numbers(y, 8)])
    forget(stored)
    return sums


def _blocks(ids: np.ndarray, x: np.ndarray, y: np.ndarray, part: int) -> pa.Table:
    edges = np.concatenate([[0], np.flatnonzero(np.diff(ids // _BLOCK)) + 1, [len(ids)]])
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if len(ids) else []
    column = lambda values, width: pa.array([planes(values[a:b], width) for a, b in spans], pa.binary())
    return pa.table({"block": pa.array([int(ids[a]) // _BLOCK for a, _ in spans], pa.int64()), "part": pa.array([part] * len(spans), pa.int64()), "at": column(ids % _BLOCK, 4), "x": column(x, 8), "y": column(y, 8)})


def op3_hpy_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
