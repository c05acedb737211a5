"""The genetic search against optima that are known, and against best-fit decreasing."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.llm import packing

CAPACITY = 1024


def cut_bins(n, rng, low, high):
    """The lengths of n full bins, each cut into a number of pieces."""
    out = []
    for _ in range(n):
        cuts = sorted(rng.sample(range(1, CAPACITY), rng.randint(low, high) - 1))
        out += [b - a for a, b in zip([0, *cuts], [*cuts, CAPACITY], strict=True)]
    rng.shuffle(out)
    return out


def thirds(n, rng):
    """Full bins of three pieces, each of more than a quarter and less than a half."""
    out = []
    while len(out) < 3 * n:
        a, b = rng.randint(257, 511), rng.randint(257, 511)
        if 257 <= CAPACITY - a - b <= 511:
            out += [a, b, CAPACITY - a - b]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n", [60, 200, 1000])
def test_most_of_the_excess_of_best_fit_decreasing_goes(n):
    lengths = thirds(n, random.Random(n))
    plain = len(packing.best_fit([], range(len(lengths)), lengths, CAPACITY))
    best = packing.evolve(lengths, CAPACITY, 1)[0]
    assert sorted(i for b in best for i in b) == list(range(len(lengths)))
    assert plain - n >= n // 20 and len(best) - n <= (plain - n) // 4


def test_islands_and_rounds_reach_the_optimum_of_cut_bins(spark):
    lengths = cut_bins(300, random.Random(5), 2, 5)
    rows = [(i, 0, 0, n, i, i) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")
    got = packing.pack(pieces, islands=3, rounds=3).collect()
    assert len(got) == len(lengths) and len({r.sequence_id for r in got}) <= 301


def optimum(lengths, capacity):
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + lengths[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_tiny_optima():
    rng = random.Random(2)
    for seed in range(40):
        lengths = sorted((rng.randint(1, 60) for _ in range(rng.randint(1, 9))), reverse=True)
        assert len(packing.evolve(lengths, 100, seed)[0]) == optimum(lengths, 100) >= packing.least_bins(lengths, 100)


def test_repeated_rows_are_dealt_over_shards(spark):
    df = spark.createDataFrame([(None, "same text")], "doc_id long, text string").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20000)))).drop("n").repartition(4)
    got = packing.pack_documents(df, shard_pieces=1000, islands=1, rounds=1)
    per_shard = got.groupBy(F.shiftright("sequence_id", 24).alias("shard")).count().agg(F.max("count"), F.count("*")).first()
    assert per_shard[1] >= 20 and per_shard[0] < 2000
