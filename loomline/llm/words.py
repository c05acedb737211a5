"""Words and word shingles of Arrow batches, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHINGLE_WORDS = 5
SLICE_BYTES = 4 << 20
SLICE_ROWS = 1000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def in_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The array in runs of at most SLICE_ROWS rows and about `most` bytes, one row at least: bounds what numpy holds at once."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(ends, base + most, "right"))))
        yield texts.slice(at, to - at)
        at = to


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and where each text's begin (one more at the end)."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    kept = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not kept.all():
        words = words.filter(pa.array(kept))
        starts = np.concatenate([[0], np.cumsum(kept)])[starts]
    return words, starts


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the words, where each text's begin, and the words that the codes stand for."""
    words, starts = split_words(texts, lower)
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    hashed = xxhash.xxh3_64_intdigest
    return np.fromiter((hashed(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def doc_shingles(texts: pa.Array, n: int = SHINGLE_WORDS, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, and where each text's begin.

    A text of fewer than n words has one shingle of all of them; one without words has none.
    """
    codes, starts, words = word_codes(texts, lower)
    per_word = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    counts = np.diff(starts)
    rolled = np.zeros(max(0, len(per_word) - n + 1), np.uint64)
    for j in range(n):
        rolled = rolled * _STEP + per_word[j : j + len(rolled)]
    rolled = mixed(rolled)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(begins[-1], np.uint64)
    for i in range(len(counts)):
        a, b, s = begins[i], begins[i + 1], starts[i]
        if counts[i] >= n:
            out[a:b] = rolled[s : s + b - a]
            out[a:b].sort()
        elif b > a:
            h = np.uint64(counts[i])
            with np.errstate(over="ignore"):
                for w in per_word[s : starts[i + 1]]:
                    h = h * _STEP + w
            out[a] = mixed(np.array([h]))[0]
    if not len(out):
        return out, begins
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[begins[:-1][sizes > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[begins]
