import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.llm import chat_format, fingerprints, hpy_lm, mixing, packing, secrets, toxicity
from loomline.llm.catalog import ORACLES, QUERIES
from tests.llm import brute
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def table():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


# op1


def test_folding():
    assert toxicity.fold("IDI0T mоrоn") == "idiot moron"
    assert toxicity.fold("i.d.i.o.t") == "idiot" and toxicity.fold("c1\u200bown") == toxicity.fold("clown") and toxicity.fold("p@thetic") == "pathetic"


def test_matching_and_exceptions():
    m = toxicity.Matcher(toxicity.Model(weights={"clown": 2.0, "clow": 1.0, "moron": 3.0}, exceptions=("class clown",)))
    hits = lambda text: m.hits(toxicity.fold(text))
    assert hits("clowns eat moron") == [(0, 2.0), (11, 3.0)] and hits("sclown") == [] and hits("c10wn") == [(0, 2.0)] and hits("a class clown") == [] and hits("class clowny") == [(6, 2.0)]
    assert toxicity.Matcher(toxicity.Model(weights={}, exceptions=())).hits("x") == []


def labelled(spark, n=300):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
        toxic = int(i % 4 == 0)
        if toxic:
            words[rng.randrange(60)] = "zorv" + rng.choice(["ak", "el", "in"])
            words[rng.randrange(60)] = "zorv" + rng.choice(["ak", "el", "in"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_new_words(spark):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, labels, ~toxicity.held_out())
    assert any(w[:3] == "zor" for w in model.weights)
    got = toxicity.toxicity(docs, model).join(labels, "doc_id").filter(toxicity.held_out())
    assert got.filter("predicted <> toxic").count() <= 0.03 * got.count()


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "you idiot idiot"), (4, "plain words"), (4, "plain words"), (5, "idiot " * 3 + "w " * 50_000)], DOCS).withColumn("score", F.lit("x")).withColumn("weight", F.lit(1))
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert by[1] == by[2] == by[4] == 0 and by[None] == 1
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_toxicity_query(spark):
    got = QUERIES["op1_toxicity"](spark, SF)
    assert got.count() == len(table()) and got.filter("held_out is null or score is null").count() == 0


# op2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 100), st.integers(0, 20)), min_size=1, max_size=8), st.integers(0, 60))
def test_sainte_lague(parties, seats):
    votes, most = np.array([p[0] for p in parties]), np.array([p[1] for p in parties])
    votes[votes < 1e-6] = 0
    got = mixing.sainte_lague(votes, seats, most)
    want = np.zeros(len(votes), int)
    for _ in range(seats):
        q = np.where((want < most) & (votes > 0), votes / (2 * want + 1), -1)
        if q.max() < 0:
            break
        want[q.argmax()] += 1
    quotients = lambda s: sorted(round(v / (2 * k + 1), 6) for v, n in zip(votes, s, strict=True) for k in range(n))
    assert got.sum() == want.sum() and quotients(got) == quotients(want)


def test_targets():
    got = mixing.targets_of([10, 100, 100], [5, 2, 1], 3)
    assert got[0] == 30 and got.sum() == pytest.approx(210) and got[1] == pytest.approx(2 * got[2])
    assert (mixing.targets_of([0, 0], [5, 2], 3) == 0).all()


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", None, "Z"]), " ".join(["w"] * rng.randrange(400))) for i in range(400)] + [(900, "a", None), (901, "tiny", "one two"), (None, "b", "x y"), (902, "b", "q r s"), (902, "b", "q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumn("shard", F.lit(0))
    got = mixing.mix_sources(docs, shard_words=5000).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    sums = got.fillna({"source": "~"}).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), whole=("source_size", "first"))
    assert (sums["size"] == sums["whole"]).all() and (abs(sums["taken"] - sums["target"]) <= 0.05 * sums["target"] + 2).all()
    again = mixing.mix_sources(docs.orderBy(F.rand(1)), shard_words=5000).toPandas()
    order = ["doc_id", "size", "taken"]
    assert got[order].sort_values(order).reset_index(drop=True).equals(again[order].sort_values(order).reset_index(drop=True))
    out = mixing.mixed_documents(docs.select("doc_id", "source", "text", F.length("text").cast("long").alias("n_chars")), shard_words=5000).toPandas()
    assert sum(len(brute.WORD.findall(t or "")) for t in out["text"]) == got["taken"].sum()
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mix_sources(docs.filter("doc_id = 900")).first().taken == 0


# op3


def test_base_scores(spark):
    got = QUERIES["op3_hpy_lm"](spark, SF).collect()
    want = brute.base_scores(table())
    assert len(got) == len(want)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_edge_cases(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "A b a"), (7, "z " * 3000)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "1 AS score", "2 AS key", "3 AS chunk")
    got = hpy_lm.lm_scores(df).collect()
    assert len(got) == 6 and sorted(r.n_tokens for r in got) == [1, 1, 1, 3, 4, 3001] and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert hpy_lm.lm_scores(df.limit(0)).count() == 0


def brute_pairs(rows):
    """Training counts of (word before, word), an end as None."""
    out = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            out.update(brute.word_pairs(t))
    return out


def test_lm_tells_seen_pairs_from_unseen(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(300)]
    ids = [i for i in range(1, 4000) if zlib.crc32(str(i).encode()) % 10][:300]
    held = [i for i in range(1, 4000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    again, fresh = texts[:30], [" ".join(rng.choices(vocabulary, k=60)) for _ in range(30)]
    rows = list(zip(ids, texts, strict=True)) + list(zip(held, again + fresh, strict=True))
    score = {r.doc_id: r.score for r in hpy_lm.lm_scores(spark.createDataFrame(rows, DOCS)).collect()}
    assert min(score[i] for i in held[:30]) > max(score[i] for i in held[30:])


def test_lm_agrees_with_a_plain_sampler(spark):
    """Texts' probabilities against those of a sampler that seats customer by customer in one process, averaged over many sweeps."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abcde", weights=(8, 4, 2, 1, 1), k=rng.randrange(1, 12)))) for i in range(1, 40)]
    counts = brute_pairs(rows)
    plan = hpy_lm.Plan(1 << 20, 2, np.zeros(0, np.uint64))
    got = {r.doc_id: r.score for r in hpy_lm.lm_scores(spark.createDataFrame(rows, DOCS), plan=plan, exchanges=3).collect()}
    want = brute.pitman_yor(rows, counts, hpy_lm.DISCOUNT, hpy_lm.STRENGTH, sweeps=60, burn_in=20)
    off = [(got[i] - want[i]) / (len(text.split()) + 1) for i, text in rows]
    assert abs(sum(off) / len(off)) < 0.03 and max(map(abs, off)) < 0.15


@pytest.mark.parametrize("turn", [2, 3])
def test_lm_probabilities_sum_to_one(turn):
    rng = np.random.default_rng(0)
    contexts = 40
    word, context = np.minimum((rng.pareto(0.9, 20_000) * 1.5).astype(np.int64), 1500), rng.integers(0, contexts, 20_000)
    hashes = np.sort(rng.integers(1, 2**63, 1502).astype(np.uint64))
    plan = hpy_lm.Plan(contexts, 1, np.sort(hashes[[0, 3]]))
    every = np.repeat(np.arange(1502), contexts), np.tile(np.arange(contexts), 1502)
    n = np.zeros((1502, contexts), np.int64)
    np.add.at(n, (word, context), 1)
    table_ = pa.table({"chunk": [0], "a": pa.array([hashes.tobytes()], pa.binary()), **{c: pa.array([hpy_lm.planes(x)], pa.binary()) for c, x in (("b", np.full(1502, contexts)), ("c", every[1]), ("d", n.ravel()))}})
    totals = None
    for t in range(turn):
        bucket = hpy_lm.Bucket(table_, plan)
        ids, x, y = bucket.sums(plan, totals, 5 + t)
        sums = np.zeros((2, contexts + 3), np.int64)
        sums[:, ids] = x, y
        totals = hpy_lm.Totals(sums, plan, t, t == 0)
    assert totals.tokens == 20_000 and totals.vocabulary == len(np.unique(word))
    p = hpy_lm.Bucket(table_, plan).probabilities(totals, 3)
    of = np.bincount(hpy_lm.Bucket(table_, plan).context, p, contexts)
    unknown = int((n.sum(axis=1) == 0).sum())  # each is given what all unknown words share
    rest = p[(n.sum(axis=1) == 0)[hpy_lm.Bucket(table_, plan).word]].reshape(unknown, contexts)
    total = of - rest.sum(axis=0) + rest.mean(axis=0)
    assert total.mean() == pytest.approx(1, abs={2: 0.1, 3: 0.02}[turn]) and total == pytest.approx(np.ones(contexts), abs=0.15)


@pytest.mark.parametrize(("n", "others", "prior"), [(2, 0.0, 0.5), (5, 3.0, 0.2), (17, 40.0, 0.05), (9, 900.0, 0.01)])
def test_tables_are_drawn_from_their_conditional_distribution(n, others, prior):
    discount, strength = 0.8, 4.0
    # Seatings by the sizes of their tables, built customer by customer: a path's weight is the product of its choices' weights.
    ways = {(1,): (strength + discount * others) * prior}
    for _ in range(n - 1):
        more = Counter()
        for sizes, weight in ways.items():
            for k, size in enumerate(sizes):
                more[tuple(sorted((*sizes[:k], size + 1, *sizes[k + 1 :])))] += weight * (size - discount)
            more[tuple(sorted((*sizes, 1)))] += weight * (strength + discount * (others + len(sizes))) * prior
        ways = more
    want = np.zeros(n + 1)
    for sizes, weight in ways.items():
        want[len(sizes)] += weight
    draws = 40_000
    one = np.ones(draws)
    got = hpy_lm.draw_tables(np.full(draws, n), one * others, one * prior, discount, strength, np.random.default_rng(3))
    assert np.bincount(got, minlength=n + 1) / draws == pytest.approx(want / want.sum(), abs=0.012)


def test_large_dishes_have_about_as_many_tables_as_customers_one_by_one_make():
    discount, strength, others, prior, n = 0.8, 4.0, 50.0, 0.05, 400
    rng, made = np.random.default_rng(5), []
    for _ in range(300):
        t = 1
        for seated in range(1, n):
            fresh = (strength + discount * (others + t)) * prior
            t += rng.random() < fresh / (fresh + seated - discount * t)
        made.append(t)
    one = np.ones(300)
    got = hpy_lm.draw_tables(np.full(300, n), one * others, one * prior, discount, strength, rng)
    assert got.mean() == pytest.approx(np.mean(made), rel=0.1)


def test_lm_does_not_depend_on_how_pairs_are_dealt(spark):
    rows = [(i, t) for i, t in table()[:120]]
    df = spark.createDataFrame(rows, DOCS)
    ends = np.array([hpy_lm.END], np.uint64)
    some = [{r.doc_id: r for r in hpy_lm.lm_scores(df, plan=p).collect()} for p in (hpy_lm.Plan(4096, 1, ends[:0]), hpy_lm.Plan(4096, 200, ends))]
    for i, _ in rows:
        a, b = some[0][i], some[1][i]
        assert (a.n_known, a.n_tokens, a.train_tokens) == (b.n_known, b.n_tokens, b.train_tokens) and a.base_score == pytest.approx(b.base_score, rel=1e-9)
        assert a.score == pytest.approx(b.score, rel=0.02)


# op4


def test_chat_against_sql(spark):
    same(QUERIES["op4_chat_format"](spark, SF), connect(SF), ORACLES["op4_chat_format"])


TEXTS = st.lists(st.sampled_from([*"#\\<>/: \n", "turn", "join", "</turn>\n", "### ", "<join/>", "é", "a"]), max_size=12).map("".join)


def test_chat_round_trip(spark):
    seen = []

    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x: y", "a:"]), TEXTS), min_size=1, max_size=6), min_size=1, max_size=5))
    def run(conversations):
        rows = [(c, n, role, text) for c, turns in enumerate(conversations) for n, (role, text) in enumerate(turns)]
        made = chat_format.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        back = made.select("conv_id", "n_blocks", chat_format.read_back(F.col("formatted")).alias("t"), "pieces", "formatted", "blocks").collect()
        for r in back:
            turns = conversations[r.conv_id]
            assert [(x["role"], x["text"]) for x in r.t] == turns
            assert r.n_blocks == sum(i == 0 or turns[i - 1][0] != t[0] for i, t in enumerate(turns))
            assert "".join(p["piece"] for p in r.pieces) == r.formatted
            assert [(b["role"], x) for b in r.blocks for x in b["texts"]] == turns and all(a["role"] != b["role"] for a, b in zip(r.blocks, r.blocks[1:], strict=False))
        seen.append(len(back))

    run()
    assert seen


def test_chat_edge_cases(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, None, "user", "u"), (None, 1, "assistant", "v"), (2, 1, "assistant", "x"), (2, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit(1))
    got = {r.conv_id: r.formatted for r in chat_format.chat_format(df).collect()}
    assert got == {1: "### : <join/></turn>\n", None: "### user: u</turn>\n### assistant: v</turn>\n", 2: "### assistant: x<join/>y</turn>\n"}
    assert chat_format.chat_format(df.limit(0)).count() == 0


def test_chat_runs_without_python(spark):
    plan = QUERIES["op4_chat_format"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# op6


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode = packing.encoder(path)
    texts = [x for _, x in table()] + ["<|endoftext|> a", "", " \n\t x  ", "日本語 😀́ \x00", "it's we'LL 12³ a b"]
    assert all(encode(x).tolist() == t.encode(x, add_special_tokens=False).ids for x in texts)


def test_other_tokenizers_use_the_library():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    assert packing.encoder(path("word_bpe_49k.json"))("Two words").tolist() == Tokenizer.from_file(path("word_bpe_49k.json")).encode("Two words", add_special_tokens=False).ids


def check_packed(rows, sequence):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= sequence
    return len(by)


def test_packing_query(spark):
    import zlib

    rows = QUERIES["op6_packing"](spark, SF).collect()
    used = check_packed(rows, 1024)
    encode = packing.encoder(packing.default_tokenizer())
    texts = dict(table())
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    assert set(docs) == set(texts)
    for i, own in docs.items():
        ids, at = np.append(encode(texts[i]), 2).astype("<u4"), 0
        own.sort(key=lambda r: r.piece)
        for n, r in enumerate(own):
            assert (r.piece, r.start) == (n, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and (n == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids) and (len(own) == 1) == (len(ids) <= 1024)
    total = sum(r.length for r in rows)
    assert used <= -(-total // 1024) * 1.02 + 1


def test_packing_edge_cases(spark):
    rows = [(1, None), (1, None), (None, "a b"), (5, "word " * 5000), (6, "x")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "1 AS length", "2 AS piece", "3 AS shard")
    got = packing.pack_documents(df, sequence=16, shard_pieces=3).collect()
    check_packed(got, 16)
    assert sum(r.doc_id == 1 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_genetic_operators_keep_all_pieces():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 100) for _ in range(200)]
    people = packing.evolve(lengths, 128, 1)
    a, b = people[0], people[-1]
    child, fills = packing.child_of(a, packing.fills_of(a, lengths), b, packing.fills_of(b, lengths), lengths, 128, rng)
    assert fills == packing.fills_of(child, lengths)
    for bins in (*people, child, packing._as_bins(packing._numbered(child, 200))):
        assert sorted(i for b in bins for i in b) == list(range(200)) and all(sum(lengths[i] for i in b) <= 128 for b in bins)
    assert packing.fitness(people[0], lengths, 128) >= packing.fitness(people[-1], lengths, 128)
    assert len(packing.evolve(lengths, 128, 2, people)[0]) <= len(people[0])


# op7


def test_fingerprints_query(spark):
    rows = sorted(table())
    got = {r.doc_id: r for r in QUERIES["op7_fingerprints"](spark, SF).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        follower = rows[(k + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[1][:half]
        a, b, c = brute.shingles(text), brute.shingles(edited), brute.shingles(follower[1])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b), abs=0.13) and r.near_next == pytest.approx(len(a & c) / len(a | c), abs=0.1)


def test_sketches():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 9000).astype(np.uint64) * np.uint64(2)
    a, b = pool[:6000], pool[2000:]
    x, y = fingerprints.Sketch.of(a), fingerprints.Sketch.of(b)
    assert x.merge(y).dump() == fingerprints.Sketch.of(pool).dump() == y.merge(x).dump()
    assert x.resemblance(y) == pytest.approx(4000 / 9000, abs=0.12) and x.containment(y) == pytest.approx(2 / 3, abs=0.15) and x.distinct() == pytest.approx(6000, rel=0.2)
    small = fingerprints.Sketch.of(pool[:10])
    assert small.distinct() == 10 and fingerprints.Sketch.load(x.dump()).dump() == x.dump()
    none = fingerprints.Sketch.of(pool[:0])
    assert none.resemblance(none) == 1.0 and none.resemblance(x) == 0.0


def followed(spark, rows):
    """(id, characters, digest of the edited text) of rows in the order of id, none first, and of the hash of their text."""
    plain = [(i, t or "") for i, t in rows]
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in plain], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    plain.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    out = []
    for k, (i, t) in enumerate(plain):
        half = len(t) // 2
        edited = t[: len(t) - half] + plain[(k + 1) % len(plain)][1][:half]
        out.append((i or 0, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out)


def test_fingerprints_of_ids_that_many_rows_share(spark):
    rng = random.Random(7)
    rows = [(None, "".join(rng.choices("abc ", k=20))) for _ in range(120)] + [(4, "".join(rng.choices("abc ", k=20))) for _ in range(150)] + [(i, f"text {i}") for i in (1, 2, 3, 5, 6, 4)] + [(4, "same")] * 9
    out = fingerprints.fingerprint_pairs(spark.createDataFrame(rows, DOCS))
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in out.collect()) == followed(spark, rows)


def test_fingerprint_edge_cases(spark):
    one = fingerprints.fingerprint_pairs(spark.createDataFrame([(1, "ab")], DOCS)).first()
    assert one.edited_sha256 == hashlib.sha256(b"aa").hexdigest() and one.near_next == 1.0
    rows = [(None, "n"), (2, None), (2, "bb"), (2, "aa"), (9, "é" * 3)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "1 AS bucket", "2 AS guest")
    got = sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in fingerprints.fingerprint_pairs(df).collect())
    assert got == followed(spark, rows)
    assert fingerprints.fingerprint_pairs(df.limit(0)).count() == 0


# op8


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef012345", "AKIA", "ABCDEFGH12", "0123456789abcdef", "-", "x", "\n", "password"]), max_size=14).map("".join))
def test_base_spans(text):
    assert sorted(secrets.base_spans(text)) == sorted(brute.base_spans(text))


@pytest.mark.parametrize(("text", "found"), [
    ('db_passwd := "Xk29fLq0Zt81Mn"', "Xk29fLq0Zt81Mn"), ("k = 'Zx81Qw92Er73Ty64'\nauth_token = k", "Zx81Qw92Er73Ty64"), ("<secretKey>Ab12Cd34Ef56Gh78</secretKey>", "Ab12Cd34Ef56Gh78"),
    ("privateKey: Ab12Cd34Ef56Gh78", "Ab12Cd34Ef56Gh78"), ("token = ${TOKEN}", None), ('password = "changeme"', None), ("name = Ab12Cd34Ef56Gh78", None), ('client_secret = "Ab12Cd" + "34Ef56Gh78"', 'Ab12Cd" + "34Ef56Gh78'),
])
def test_assignments(text, found):
    assert [text[a:b] for a, _, b in secrets.assigned_spans(text)] == ([found] if found else [])


def test_secrets_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, 'é token = "0123456789abcdef"'), (4, "AKIA" + "B" * 16), (4, "AKIA" + "B" * 16), (5, "plain " * 40_000)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "1 AS spans", "2 AS base")
    got = secrets.secret_spans(df).collect()
    assert len(got) == 6
    by = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.base] for r in got}
    assert by[None] == [("assign", 2, 27), ("hex", 11, 27)] and by[4] == [("access", 0, 20)] and by[1] == by[2] == by[5] == []
    assert secrets.secret_spans(df.limit(0)).count() == 0


def test_secrets_query(spark):
    texts = dict(table())
    for r in QUERIES["op8_secrets"](spark, SF).collect():
        want = brute.base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in want) for k in ("assign", "access", "hex")]
        assert set(joined.split(",")) <= set(r.spans.split(","))
