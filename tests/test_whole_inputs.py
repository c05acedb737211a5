"""Registered queries over fixtures that reach past what once cut them short, against brute force."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loomline.catalog import ORACLES, QUERIES
from loomline.operators import aggregates as A
from loomline.operators import editing as E
from loomline.operators import sequences as S
from loomline.operators import vectors as V
from tests.oracle import connect


def stored(folder, name, columns):
    pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")
    return str(folder)


def plain_subsequence(a, b):
    """By the whole table of lengths, walked back as the surveyed engine does."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            size[i][j] = size[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(size[i - 1][j], size[i][j - 1])
    out, i, j = "", len(a), len(b)
    while i and j:
        if size[i][j] == size[i - 1][j]:
            i -= 1
        elif size[i][j] == size[i][j - 1]:
            j -= 1
        else:
            out, i, j = a[i - 1] + out, i - 1, j - 1
    return out


def plain_extreme(text):
    lines = text.replace(" ", "\n").split("\n")
    if len(lines) < 6:
        return False
    for step in (1, 2):
        shared = plain_subsequence(lines[0], lines[step])
        if len(shared) > 5 or len(shared) > len(lines[0]) * 0.5:
            hits = sum(shared in lines[i] for i in range(0, len(lines), step)) * step
            if hits > 8 or hits / len(lines) > 0.8:
                return True
    return False


def test_common_subsequence_walks_back_as_surveyed():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        assert E.common_subsequence(a, b) == plain_subsequence(a, b)


def test_extreme_repetition_reads_whole_texts(spark, tmp_path):
    other = " ".join(f"{i:04d}" for i in range(600))
    texts = [
        "repeat repeat " + other + " repeat" * 10,  # more than 8 hits only past 2,000 characters
        "repeat repeat " + other,
        "\n".join(["x" * 700] * 6 + [f"{i:04d}" for i in range(600)]),  # a prefix all of repeats, then none
        "ab ba " + "cd ab " * 600,
        "word " * 600,
        other,
        "",
    ]
    rng = random.Random(5)
    texts += [" ".join(rng.choices(["alpha", "alphabet", "beta", "gamma", "delta", "eps"], [1, 1, 1, 200, 200, 200], k=rng.randint(300, 1500))) for _ in range(40)]
    folder = stored(tmp_path, "documents", {"doc_id": list(range(len(texts))), "text": texts})
    got = {r.doc_id: r.extreme for r in QUERIES["tx11_extreme_repetition"](spark, folder).collect()}
    want = {i: plain_extreme(x) for i, x in enumerate(texts)}
    assert got == want and any(plain_extreme(x) != plain_extreme(x[:2000]) for x in texts)


def plain_tree(rows, root):
    """(own, children, total, nodes) of all simple paths down from a root's rows."""
    own, below, nodes = [], [], 0
    todo = [(i, c, (i,)) for i, _, c in rows if i == root]
    while todo:
        i, c, path = todo.pop()
        nodes += 1
        if c is not None:
            (own if len(path) == 1 else below).append(c)
        todo += [(j, d, (*path, j)) for j, up, d in rows if up == i and j is not None and j not in path]
    return sum(own) if own else None, sum(below), sum(own + below) if own + below else None, nodes


TREES = {
    "chain deeper than 100": [(i, i - 1, 1) for i in range(1, 151)],
    "one parent each": [(i, random.Random(i).randint(0, i - 1), i) for i in range(1, 80)],
    "cycles": [(i, random.Random(7 * i).randint(1, 60), i if i % 5 else None) for i in range(1, 61)],
    "a cycle with trees": [(1, 3, 1), (2, 1, 2), (3, 2, 4), (4, 3, 8), (5, 4, None), (6, 6, 16), (7, 99, None), (8, 7, None), (None, 1, 32)],
    "two parents": [(1, None, 1), (2, 1, 2), (3, 1, 4), (4, 2, 8), (4, 3, 8), (5, 4, 16), (1, 5, 1)],
}


def test_every_tree_is_summed(spark):
    for name, rows in TREES.items():
        spark.createDataFrame(rows, "id long, parent long, cost long").createOrReplaceTempView("whole_trees")
        got = {r.root: (r.own, r.children, r.total, r.nodes) for r in A.tree_cost(spark, "whole_trees", "id", "parent", "cost", "id IS NOT NULL").collect()}
        assert got == {i: plain_tree(rows, i) for i, *_ in rows if i is not None}, name


def test_trees_are_summed_from_their_leaves(spark):
    """Where no table is too small for that; the last with leaves first and the rest by doubling."""
    shapes = {
        "chain with a leaf at each node": ([(i, i - 1, i) for i in range(1, 31)] + [(100 + i, i, 1) for i in range(1, 31)], 0),
        "trees on cycles": ([(i, i % 4 + 1 if i < 5 else i // 2, i) for i in range(1, 90)] + [(None, 3, 5)], 0),
        "heap": ([(i, i // 2, None if i % 3 else i) for i in range(1, 150)], 40),
    }
    for name, (rows, few) in shapes.items():
        spark.createDataFrame(rows, "id long, parent long, cost long").createOrReplaceTempView("raked_trees")
        got = {r.root: (r.own, r.children, r.total, r.nodes) for r in A.tree_cost(spark, "raked_trees", "id", "parent", "cost", "id IS NOT NULL", few).collect()}
        assert got == {i: plain_tree(rows, i) for i, *_ in rows if i is not None}, name


def test_tree_costs_have_no_row_limit(spark, tmp_path):
    n = 600
    folder = stored(tmp_path, "orders", {"o_orderkey": list(range(10, 10 + n)), "o_totalprice": [float(i % 7) for i in range(n)]})
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "500")
    try:
        got = {r.root: (r.own, r.children, r.total, r.nodes) for r in QUERIES["ag08_all_tree_costs"](spark, folder).collect()}
        some = {r.root: (r.own, r.children, r.total, r.nodes) for r in QUERIES["ag08_tree_cost"](spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    rows = [(i, i // 2, (i - 1) % 7) for i in range(1, n + 1)]
    assert got == {i: plain_tree(rows, i) for i, *_ in rows}
    assert some == {i: got[i] for i in got if i % 100 == 1}


def test_numbers_have_no_gaps_where_sorts_sample(spark, tmp_path):
    n = 150_000
    keys = random.Random(4).sample(range(10 * n), n)
    folder = stored(tmp_path, "orders", {"o_orderkey": [*keys, None], "o_totalprice": [float(k % 97) for k in keys] + [5.0]})
    spread = spark.read.parquet(f"{folder}/orders.parquet").repartition(8).withColumn("filler", F.sha2(F.col("o_orderkey").cast("string"), 512))
    got = S.numbered(spread.filter("o_orderkey IS NOT NULL"), ["o_orderkey"]).select("index", "o_orderkey", "filler").orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(n)) and [r.o_orderkey for r in got] == sorted(keys)
    costs = {r.root: r.own for r in QUERIES["ag08_all_tree_costs"](spark, folder).collect()}
    assert costs == {i + 1: k % 97 for i, k in enumerate(sorted(keys))} | {n + 1: 5}
    assert {r.root: r.own for r in QUERIES["ag08_tree_cost"](spark, folder).collect()} == {i: costs[i] for i in range(1, n + 2, 100)}


def test_bursts_of_a_batch(spark, tmp_path):
    """Pauses of a gap, of a microsecond less and more, days without a pause, times before 1970, ties and nulls."""
    rng, at, rows = random.Random(8), -3 * 86_400_000_000, []
    for i in range(4000):
        at += rng.choice([0, 1, 299_999_999, 300_000_000 if i % 40 == 0 else 60_000_000, 300_000_001 if i % 300 == 0 else 7, 299_000_000])
        rows.append((at, rng.choice([1, 2, None]), rng.choice(["a", "b", None])))
    rows += [(None, 1, "a"), (None, 1, "b"), (None, 2, "a"), (None, None, None)]
    rng.shuffle(rows)
    stamps = pa.array([r[0] for r in rows], pa.timestamp("us"))
    folder = stored(tmp_path, "events", {"event_id": list(range(len(rows))), "ts": stamps, "user_id": [r[1] for r in rows], "event_type": [r[2] for r in rows]})
    bursts = QUERIES["st01_bursts"](spark, folder)
    assert sorted(map(str, map(tuple, bursts.collect()))) == sorted(map(str, connect(folder).sql(ORACLES["st01_bursts"]).fetchall()))
    assert bursts.filter("events > 100").count() and bursts.select("start").distinct().count() > 15
    plan = bursts._jdf.queryExecution().executedPlan().toString().lower()
    assert "session" not in plan and "collect_list" not in plan


def test_repeated_lines_of_many_copies(spark, tmp_path):
    """Copies are paired by equality: only different lines of a group are compared."""
    rng = random.Random(6)
    names = ["large ring", "orange plates", "orange plate", "orange plane", "brown", "pipe", "a" * 30, "a" * 28 + "bc", "a" * 27 + "bcd", None]
    rows = [(rng.choice(names), rng.choice(["x", "y", None]), rng.choice([1, 2, None])) for _ in range(400)]
    folder = stored(tmp_path, "part", {"p_partkey": rng.sample(range(1000), 400), "p_name": [r[0] for r in rows], "p_brand": [r[1] for r in rows], "p_size": [r[2] for r in rows]})
    pairs = QUERIES["tx09_repeated_lines"](spark, folder)
    assert sorted(map(tuple, pairs.collect())) == sorted(connect(folder).sql(ORACLES["tx09_repeated_lines"]).fetchall())
    compared = pairs._jdf.queryExecution().optimizedPlan().toString().split("levenshtein", 1)[1]
    assert compared.count("Aggregate") >= 2


def test_waits_round_times_to_milliseconds(spark, tmp_path):
    pairs = [(at, at + 537_000_000 + d) for at in (690, 500, 499, -499, -500, -1_500, -537_000_500, 1_706_257_505_702_690, 9_000_000_000_000_500) for d in (-501, -500, -281, 0, 281, 500, 70_000_000)]
    rows = [(u, at) for u, both in enumerate(pairs) for at in both]
    folder = stored(tmp_path, "events", {"event_id": list(range(len(rows))), "user_id": [u for u, _ in rows], "ts": pa.array([at for _, at in rows], pa.timestamp("us"))})
    got = sorted(map(tuple, QUERIES["st13_rate_limit"](spark, folder).collect()))
    assert got == sorted(connect(folder).sql(ORACLES["st13_rate_limit"]).fetchall())


def test_suffixes_that_start_with_a_newline(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=150)) for _ in range(12)]
    texts = [w[:40] + blank + w[40:] for w, blank in zip(words, ["\n", "\t", "\u00a0", "\r\n", " ", "\n ", " \n", "", "\n\n", "\u3000", "x", "\f"], strict=True)]
    folder = stored(tmp_path, "benchmark", {"item_id": list(range(len(texts))), "text": texts})
    got = sorted(map(tuple, QUERIES["wn15_cut_at_suffix"](spark, folder).collect()))
    assert got == sorted(connect(folder).sql(ORACLES["wn15_cut_at_suffix"]).fetchall()) and len(got) == 10


def test_no_number_of_queries_is_refused(spark, tmp_path):
    n, rng = 10_050, random.Random(2)
    vectors = [[float(rng.randint(-3, 3)) for _ in range(3)] for _ in range(60)]
    points = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, vector array<double>")
    asked = spark.createDataFrame([(q, vectors[q % 60]) for q in range(n)], "query_id long, query array<double>")
    got = {}
    for r in V.search_many(points, asked, 3, 0.1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    size = lambda v: sum(x * x for x in v) ** 0.5
    for q in range(60):
        scores = {i: sum(x * y for x, y in zip(vectors[q], v, strict=True)) / size(v) / size(vectors[q]) for i, v in enumerate(vectors) if size(v) and size(vectors[q])}
        top = sorted((-round(s, 9), i) for i, s in scores.items() if s >= 0.1)[:3]
        assert [round(scores[i], 9) for _, i in sorted(got.get(q, []))] == [-s for s, _ in top]
        assert all(got.get(k) == got.get(q) for k in range(q, n, 60))


def test_all_logs_are_merged(spark, tmp_path):
    rows = [(c, t, f"{c}:{t}") for c in range(7) for t in range(1 + c % 4)]
    folder = stored(tmp_path, "conversations", {"conv_id": [r[0] for r in rows], "turn": [r[1] for r in rows], "role": ["user"] * len(rows), "text": [r[2] for r in rows]})
    want = {(c // 2, t): (c, x) for c, t, x in rows if c % 2 == 0} | {(c // 2, t + 1): (c, x) for c, t, x in rows if c % 2}
    assert {(r.log, r.ts): (r.conv_id, r.text) for r in QUERIES["xs04_all_merged_logs"](spark, folder).collect()} == want
