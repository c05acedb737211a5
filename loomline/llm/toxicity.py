"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, with exception phrases.

Folding lower-cases, maps homoglyphs of other scripts and digits put for letters to the letters they imitate, and closes up letters set
apart by single marks. Entries match at the start of a word, so a stem also finds its inflections. A hit inside an exception
phrase does not count. The weights of a text's hits, as they are and per hundred words, make a logistic score.

Entries, weights and exceptions beside the built-in ones are learnt from labelled rows: a bounded sample of at most `max_per_class`
rows of each class, by hash of their id, thinned so that copies count once. A word beginning is taken for an entry if many more
toxic than clean rows have it, as long as rows remain that fewer than `cover` entries explain.

Scale: learning sees the bounded sample only, whose ids are broadcast; its texts are written once to the shared folder. Scoring is one map
over Arrow batches without a shuffle.

Defined results: null and empty texts have no hits and get the score of such; labels that contradict one another count as toxic;
without labels the built-in entries and curve are used; rows that repeat are scored each; rows with a null doc_id are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.llm.shared import blank_null, documents, forget, written
from loomline.llm.words import doc_shingles, in_slices, mixed

THRESHOLD = 0.7
MAX_PER_CLASS = 4000
LEAST_DOCS = 3
LEAST_LIFT = 20.0
COVER = 3
STEM = range(3, 11)

#: Built-in entries, with the log-odds that they carry until labels say otherwise.
LEXICON = dict.fromkeys(("idiot", "moron", "stupid", "worthless", "pathetic", "disgusting", "scum", "loser", "trash", "clown", "imbecile", "retard", "bastard", "bitch", "asshole", "fuck", "cunt", "faggot", "nigger", "kys", "subhuman", "vermin"), 3.0)
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "sore loser bracket", "stupid simple", "scum line")
CURVE = (-3.0, 2.5, 0.3)

# Letters of other scripts that look like Latin ones, and the digits put for letters. As 1 stands for i and for l, these two fold together.
_ALIKE = {
    "l": "i",
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɩ": "i", "ℓ": "i",
}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
_WIDE = {chr(0xFF41 + i): "i" if i == 11 else chr(0x61 + i) for i in range(26)}
_HIDDEN = {c: None for c in "​‌‍⁠﻿­"}
_FOLD = str.maketrans({**_ALIKE, **_DIGITS, **_WIDE, **_HIDDEN})
_MARKS = {"@": "a", "$": "s"}
_MARKED = re.compile(r"[@$](?=[^\W\d_])")
_APART = re.compile(r"(?<!\w)\w(?:[.\-_*]\w){2,}(?!\w)")
_GAP = re.compile(r"[.\-_*]")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    out = text.lower().translate(_FOLD)
    if "@" in out or "$" in out:
        out = _MARKED.sub(lambda m: _MARKS[m[0]], out)
    return _APART.sub(lambda m: _GAP.sub("", m[0]), out)


#: The built-in entries as they look folded.
BUILTIN = {fold(word): weight for word, weight in LEXICON.items()}


@dataclass
class Model:
    """What a score needs. weights: entry to log-odds; exceptions: phrases; curve: of constant, raw and relative weight."""

    weights: dict[str, float] = field(default_factory=lambda: dict(BUILTIN))
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = CURVE


class Matcher:
    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.automaton = model, ahocorasick.Automaton()
        entries = {fold(entry): weight for entry, weight in model.weights.items()}
        for entry, weight in {**{fold(phrase): None for phrase in model.exceptions}, **entries}.items():
            self.automaton.add_word(entry, (len(entry), weight))
        self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(start, weight) of each entry that begins a word, the heaviest of those at one place, outside exceptions."""
        if not len(self.automaton):
            return []
        best: dict[int, float] = {}
        spared = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalnum():
                continue
            if weight is None:
                if end + 1 == len(folded) or not folded[end + 1].isalnum():
                    spared.append((start, end))
            else:
                best[start] = max(weight, best.get(start, weight))
        return [(s, w) for s, w in best.items() if not any(a <= s <= b for a, b in spared)]

    def weigh(self, text: str) -> tuple[float, int, int]:
        """Total weight, hits, words."""
        folded = fold(text)
        found = self.hits(folded)
        return sum(w for _, w in found), len(found), len(text.split())


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(weight)), np.log1p(np.maximum(weight, 0)), np.log1p(100 * np.maximum(weight, 0) / (words + 10))])


def fitted_curve(weight: np.ndarray, words: np.ndarray, label: np.ndarray, ridge: float = 0.5) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; slopes are kept from falling below zero."""
    x, beta = features(weight, words), np.array(CURVE)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (p - label) + ridge * beta * [0, 1, 1]
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + ridge * np.diag([0.01, 1, 1]), slope)
        beta = beta - step
        if np.abs(step).max() < 1e-6:
            break
    if (beta[1:] < 0).any():
        beta[1:] = np.maximum(beta[1:], 0)
    return tuple(float(b) for b in beta)


def _stems(folded: str) -> set[str]:
    out: set[str] = set()
    for w in set(_WORD.findall(folded)):
        out.update(w[:n] for n in STEM if n <= len(w))
    return out


def _sampled(docs: DataFrame, labels: DataFrame, train: Column, most: int) -> DataFrame:
    """doc_id, text, toxic: at most `most` rows of each class by hash of their ids, copies and near copies thinned to one."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(train)
    of = lambda x: known.filter(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # 2 * most ids: a bound that does not grow with the input.
    rows = docs.join(F.broadcast(of(1).unionByName(of(0))), "doc_id").select("doc_id", "text", "toxic")

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in in_slices(batch.column(1)):
                hashes, starts = doc_shingles(part)
                again = mixed(hashes ^ np.uint64(0x5DEECE66D))
                keys = [[int(h[a:b].min()) >> 1 if b > a else 0 for a, b in zip(starts[:-1], starts[1:], strict=True)] for h in (hashes, again)]
                own = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(k, pa.int64()) for k in keys)], names=["doc_id", "text", "toxic", "k1", "k2"])
                at += len(part)

    once = lambda k: F.row_number().over(Window.partitionBy("toxic", k).orderBy("doc_id", "text")) == 1
    thin = rows.mapInArrow(keyed, "doc_id long, text string, toxic int, k1 long, k2 long")
    return thin.withColumn("_a", once("k1")).withColumn("_b", once("k2")).filter("_a and _b").select("doc_id", "text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None, max_per_class: int = MAX_PER_CLASS, least_docs: int = LEAST_DOCS, least_lift: float = LEAST_LIFT, cover: int = COVER) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic. train: a condition on doc_id that rows to learn from meet."""
    rows = docs.select("doc_id", blank_null("text").alias("text"))
    sample = written(_sampled(rows, labels.select("doc_id", "toxic"), F.lit(True) if train is None else train, max_per_class))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        forget(sample)
        return Model()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                seen: tuple[Counter, Counter] = (Counter(), Counter())
                for text, label in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    seen[label == 1].update(_stems(fold(text)))
                names = list(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in seen)], names=["stem", "clean", "toxic"])

    least = max(least_docs, -(-toxic // 250))
    counted = sample.mapInArrow(count, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / clean)
    builtin = F.col("stem").isin(*BUILTIN)
    found = {r["stem"]: (r["toxic"], r["clean"]) for r in counted.filter(((F.col("toxic") >= least) & (lift >= min(least_lift, clean / toxic * least))) | builtin).collect()}
    odds = lambda t, c: float(np.log((t + 0.5) / (toxic - t + 0.5)) - np.log((c + 0.5) / (clean - c + 0.5)))
    able = {s for s, (t, c) in found.items() if t >= least and (t / toxic) / ((c + 0.5) / clean) >= min(least_lift, clean / toxic * least)}

    def holding(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(_stems(fold(t)) & able) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string()))], names=["stems"])

    held = [set(r["stems"]) for r in sample.filter("toxic = 1").mapInArrow(holding, "stems array<string>").collect()]
    chosen: list[str] = []
    covered = [0] * len(held)
    open_ = set(able)
    gains = Counter(s for h in held for s in h)
    while open_:
        # Ties go to the longer beginning, which is the more specific.
        best = max(open_, key=lambda s: (gains[s], -found[s][1], len(s), s))
        if gains[best] < least_docs:
            break
        chosen.append(best)
        open_ = {s for s in open_ if not s.startswith(best) and not best.startswith(s)}
        for i, h in enumerate(held):
            if best in h:
                covered[i] += 1
                if covered[i] == cover:
                    gains.subtract(h)
    weights = {s: w for s, w in BUILTIN.items() if s not in found}
    weights |= {s: w for s in {*chosen, *(set(BUILTIN) & set(found))} if (w := odds(*found[s])) > 0.5}
    model = Model(weights=weights)

    def phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            out = []
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                folded = fold(text)
                for start, _ in matcher.hits(folded):
                    if m := re.compile(r"[^\W_]+ [^\W_]+").match(folded, start):
                        out.append((m[0], label))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], names=["phrase", "toxic"])

    spared = sample.mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    model.exceptions = (*EXCEPTIONS, *sorted(r["phrase"] for r in spared.filter(f"t = 0 and c >= {least_docs}").collect()))
    weighed = _weighed(sample.select("doc_id", "text", "toxic"), model, ["toxic"]).select("weight", "words", "toxic").toArrow()
    model.curve = fitted_curve(*(weighed.column(c).to_numpy().astype(float) for c in ("weight", "words", "toxic")))
    forget(sample)
    return model


def _weighed(rows: DataFrame, model: Model, also: list[str] = ()) -> DataFrame:
    """doc_id, weight, hits, words and the columns `also` of rows that begin with doc_id, text."""

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            got = [matcher.weigh(x.as_py()) for x in batch.column(1)]
            columns = [*zip(*got, strict=True)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.int64(), pa.int64()), strict=True)), *batch.columns[2:]], names=["doc_id", "weight", "hits", "words", *also])

    made = StructType.fromDDL("doc_id long, weight double, hits long, words long")
    return rows.mapInArrow(weigh, StructType([*made.fields, *rows.schema.fields[2:]]))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, row: str | None = None) -> DataFrame:
    """doc_id, score, predicted, hits of every row, and the whole row as a struct named `row`, if asked."""
    also = [row] if row else []
    rows = _weighed(docs.select(F.col(id_col).cast("long").alias("doc_id"), blank_null(text_col).alias("text"), *(F.struct("*").alias(c) for c in also)), model, also)
    a, b, c = model.curve
    z = F.lit(a) + b * F.log1p("weight") + c * F.log1p(100 * F.col("weight") / (F.col("words") + 10))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return rows.select("doc_id", score.alias("score"), "hits", *also).select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits", *also)


def held_out(mod: int = 3, is_: int = 1) -> Column:
    """Whether a row is held out: crc32 of its doc_id as text. A null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == is_, F.lit(False))


def learnt(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, learnt(spark, docs, sf_dir)).select("doc_id", held_out().alias("held_out"), "score", "predicted", "hits")
