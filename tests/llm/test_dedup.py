import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import exact_dedup, near_dedup, substring_dedup
from loomline.llm.catalog import ORACLES, QUERIES
from loomline.llm.graph import components
from tests.llm import brute
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def documents(c):
    return c.sql("SELECT doc_id, text FROM documents").fetchall()


def test_exact_against_sql(spark):
    same(QUERIES["op10_exact_dedup"](spark, SF), connect(SF), ORACLES["op10_exact_dedup"])


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_exact_edge_cases(spark, block):
    rows = [(1, "a b"), (2, " ab"), (3, None), (4, ""), (5, "\t\n\x0b\x0c\r"), (6, "x" * 50), (7, "x" * 49 + "y"), (8, "x" * 50), (9, "a b")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS), block_chars=block).collect()}
    assert got == brute.exact(rows)


def test_exact_repeats_nulls_and_names(spark):
    rows = [(1, "t", "k"), (1, "t", "k"), (None, "t", "k"), (None, "t", "k"), (2, "tt", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string").withColumnsRenamed({"_key": "group_size"})
    got = exact_dedup.exact_dedup(df)
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got.collect()) == [(0, 1, 4, False), (0, 1, 4, False), (1, 1, 4, False), (1, 1, 4, True), (2, 2, 1, True)]
    assert {r.text_sha256 for r in got.filter("doc_id = 2").collect()} == {hashlib.sha256(b"tt").hexdigest()}
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_exact_hot_blocks(spark):
    rows = [(i, "h" * 30 + (str(i) if i % 3 else "")) for i in range(600)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS), block_chars=10).collect()}
    assert got == brute.exact(rows)


def variant(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for g in range(8):
        base = [f"b{rng.randrange(2000)}" for _ in range(rng.choice([6, 20, 150, 400]))]
        rows += [(len(rows) + k, variant(rng, base, k % 4)) for k in range(9)]
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "a b c d e"), (1005, "a  b\nc d e"), (1006, "w " * 5000)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, DOCS)).collect()
    want = brute.components(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(brute.shingles(dict(rows)[r.doc_id])) for r in got)


def test_near_open_clusters_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, variant(rng, base, 3)) for i in range(90)]  # neither all alike nor all apart
    monkeypatch.setattr(near_dedup, "WIDE", 64)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, DOCS), rounds=1)
    want = brute.components(rows)
    assert 1 < len(set(want.values())) < 90
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_near_nulls_repeats_and_names(spark):
    text = "a b c d e f g"
    rows = [(None, text), (3, text), (3, text), (5, text.upper()), (3, "other words stand here now")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "1 AS component", "2 AS bucket", "3 AS id")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_dedup(df).collect())
    assert got == [(0, None, True), (3, 3, True), (3, 3, True), (3, 3, True), (5, 3, False)]
    assert near_dedup.near_dedup(df.limit(0)).count() == 0


def test_signature_densification():
    bins, looked = 40, near_dedup.probes(40)
    one, more = np.array([7 << 40], np.uint64), np.sort(np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    s = near_dedup.signatures(np.concatenate([one, more]), np.array([0, 1, 1, 501]), bins, looked)
    assert (s[0] == one[0]).all() and (s[1] == 0).all() and (s[2] != 0).all()
    again = near_dedup.signatures(more, np.array([0, 500]), bins, looked)
    assert (again[0] == s[2]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, 199), (199, 201)] + [(300 + rng.randrange(40), 300 + rng.randrange(40)) for _ in range(30)] + [(5, 5), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = up.setdefault(a, {a}), up.setdefault(b, {b})
            both = x | y
            for k in both:
                up[k] = both
    assert got == {k: min(v) for k, v in up.items()}


@pytest.mark.parametrize(("length", "class_runs"), [(2, 4096), (5, 4096), (5, 2), (12, 4096), (12, 1)])
def test_passages_against_brute_force(spark, length, class_runs):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abé") for _ in range(rng.randrange(70)))) for i in range(50)] + [(60, "ab" * 40), (61, "a" * 60), (62, None), (63, "")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS), length=length, class_runs=class_runs).collect()
    made = [(r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(made) == sorted(brute.repeated(rows, length))


def test_passages_query(spark):
    got = QUERIES["op5_substring_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeated(documents(connect(SF)), 200))


def test_passages_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", 97)
    rng = random.Random(6)
    part = "".join(rng.choice("abcdef") for _ in range(300))
    rows = [(1, "x" + part + "y" * 30), (2, part[40:260] + "z"), (3, "".join(rng.choice("abcdef") for _ in range(400)))]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS), length=20).collect()
    assert sorted((r.doc_id, sum(s["end"] - s["start"] for s in r.spans)) for r in got) == sorted((i, n) for i, _, n, *_ in brute.repeated(rows, 20))


def test_factors_are_previous_factors_that_reach_the_length():
    rng = random.Random(9)
    text = "".join(rng.choice("ab") for _ in range(200)).encode()
    for length in (2, 5, 9):
        places = len(text) - length + 1
        later, source = substring_dedup.factors([(text, places)], length)
        assert later == (substring_dedup.lpf(text)[:places] >= length).tolist()
        strings = [text[i : i + length] for i in range(places)]
        assert [x or y for x, y in zip(later, source, strict=True)] == [strings.count(s) > 1 for s in strings]


@pytest.mark.parametrize("class_runs", [4096, 1])
def test_passages_keep_first_matches_previous_factors(spark, class_runs):
    rng = random.Random(8)
    text = "".join(rng.choice("ab") for _ in range(120))
    length = 9
    lpf = substring_dedup.lpf(text.encode())
    want = bytearray(len(text))
    for k in np.flatnonzero(lpf >= length):
        want[k : k + length] = b"\1" * length
    got = substring_dedup.substring_dedup(spark.createDataFrame([(1, text)], DOCS), length=length, keep_first=True, class_runs=class_runs).first()
    mask = bytearray(len(text))
    for s in got.spans:
        mask[s["start"] : s["end"]] = b"\1" * (s["end"] - s["start"])
    assert mask == want and sum(want)


def test_passages_of_many_repeated_rows(spark):
    rows = [(None, "p" * 5 + "common passage of all" + "s" * 7)] * 3000 + [(7, "common passage of all"), (8, None)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS), length=12).groupBy("doc_id", "n_bytes", F.length("kept").alias("left")).count().collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.left, r["count"]) for r in got) == [(0, 33, 0, 3000), (7, 21, 0, 1), (8, 0, 0, 1)]


def test_passages_repeats_and_names(spark):
    rows = [(None, "q" * 10), (None, "q" * 10), (4, "r" * 3)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "'x' AS key", "1 AS start")
    got = substring_dedup.substring_dedup(df, length=10)
    assert sorted((r.doc_id or 0, len(r.kept)) for r in got.collect()) == [(0, 0), (0, 0), (4, 3)]
    assert substring_dedup.substring_dedup(df.limit(0), length=10).count() == 0
