"""Bloom filters of bounded size over a column of 64-bit numbers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.words import mixed

#: 64-bit words at most: 32 MB, broadcast, and as many rows to the driver.
MOST_WORDS = 1 << 22


def _places(values: np.ndarray) -> list[np.ndarray]:
    spread = mixed(np.ascontiguousarray(values).view(np.uint64))
    return [spread & np.uint64(0xFFFFFFFF), spread >> np.uint64(32)]


def bloom(df: DataFrame, column: str, most: int = MOST_WORDS) -> np.ndarray:
    """A filter with 16 bits a row, as long as that fits into `most` words; one that is too full lets more values through but loses none."""
    words = 1 << 10
    need = df.count() // 4
    while words < min(need, most):
        words *= 2

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h in _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)):
                word, bit = (h >> np.uint64(6)) % np.uint64(words), np.uint64(1) << (h & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bit.view(np.int64))], names=["word", "bits"])

    found = df.select(column).mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out


def in_bloom(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    hit = np.ones(len(values), bool)
    for h in _places(values):
        hit &= (table[(h >> np.uint64(6)) % np.uint64(len(table))] >> (h & np.uint64(63))) & np.uint64(1) == 1
    return hit
