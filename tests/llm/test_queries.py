"""Queries over the smallest tables against brute force."""

import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from loomline.llm.catalog import QUERIES
from loomline.llm.mixing import targets_of
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def test_near_dedup_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents()]
    want = brute.components(rows)
    got = QUERIES["op9_near_dedup"](spark, SF).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert all(r.n_shingles == len(brute.shingles(t)) and r.kept == (r.doc_id == r.component_id) for r, (_, t) in zip(sorted(got), sorted(rows), strict=True))


def test_mixing_query(spark):
    rows = documents()
    sizes = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    totals = defaultdict(int)
    for i, n in sizes.items():
        totals[source[i]] += n
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, targets_of([totals[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3), strict=True))
    got = QUERIES["op2_mix_sources"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(sizes)
    taken = defaultdict(int)
    for r in got:
        assert (r.size, r.source_size) == (sizes[r.doc_id], totals[source[r.doc_id]]) and r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(taken[s] == pytest.approx(target[s], rel=0.01, abs=64) for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, QUERIES["op2_mix_sources"](spark, SF).collect()))


def test_toxicity_query_on_held_out_labels(spark):
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    labels = [(r["doc_id"], r["toxic"]) for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()]
    held = [(got[i].score, y) for i, y in labels if i in got and got[i].held_out and y is not None]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))
    assert auc > 0.85 and sum(s >= 0.7 for s in good) <= 0.02 * len(good)
