"""Fixtures for operators whose inputs the driver's tables don't have."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomline.operators import aggregates as A
from loomline.operators import budgets as B
from loomline.operators import editing as E
from loomline.operators import relational as R
from loomline.operators import search as X
from loomline.operators import sequences as S
from loomline.operators import vectors as V


def rows(df):
    return [tuple(r) for r in df.collect()]


LOG = "task_id string, seq long, ts long, type string, ask string, say string, text string, contextCondense struct<cost:double,prevContextTokens:long,newContextTokens:long>"


def log(spark, *messages, task="t"):
    return spark.createDataFrame([(task, i, 1000 + i, *m, *[None] * (5 - len(m))) for i, m in enumerate(messages)], LOG)


def started(text):
    return ("say", None, "api_req_started", text)


def test_token_usage(spark):
    m = log(spark, started('{"tokensIn":100,"tokensOut":50,"cost":0.01}'), started('{"tokensIn":200,"tokensOut":100,"cost":0.02}'), started("invalid json"))
    r = A.token_usage(m).first()
    assert (r.tokens_in, r.tokens_out, r.cache_writes, r.cache_reads, r.context_tokens) == (300, 150, None, None, 300) and r.cost == pytest.approx(0.03)
    m = log(spark, started('{"tokensIn":100,"tokensOut":50,"cacheWrites":500,"cacheReads":200}'), ("say", None, "condense_context", None, (0.05, 9000, 5000)), started('{"request":"x"}'))
    r = A.token_usage(m).first()
    assert (r.cache_writes, r.cache_reads, r.context_tokens, r.cost) == (500, 200, 5000, 0.05)


def test_task_summary(spark):
    m = log(spark, started('{"tokensIn":1,"tokensOut":1}'), ("ask", "resume_task", None, ""))
    assert A.task_summary(m).first().ts == 1000


def test_paired_requests(spark):
    fin = lambda t: ("say", None, "api_req_finished", t)
    got = S.paired_requests(log(spark, started('{"request":"GET"}'), fin('{"cost":0.005}'))).collect()
    assert [(r.ts, r.text) for r in got] == [(1000, '{"request":"GET","cost":0.005}')]
    got = S.paired_requests(log(spark, started('{"id":1}'), started('{"id":2}'), fin('{"f":"a"}'), fin('{"f":"b"}'), fin('{"f":"c"}'))).orderBy("seq").collect()
    assert [r.text for r in got] == ['{"id":1,"f":"b"}', '{"id":2,"f":"a"}']
    assert S.paired_requests(log(spark, fin('{"x":1}'))).count() == 1  # a lone message is left as it is


def test_folded_commands(spark):
    cmd, out = lambda t: ("ask", "command", None, t), lambda t: ("ask", "command_output", None, t)
    got = S.folded_commands(log(spark, cmd("ls"), out("file1.txt"), out("file2.txt"))).collect()
    assert [r.text for r in got] == ["ls\nOutput:file1.txt\nfile2.txt"]
    got = S.folded_commands(log(spark, cmd("ls"), out("output1"), cmd("pwd"), out("output2"))).orderBy("seq").collect()
    assert [r.text for r in got] == ["ls\nOutput:output1", "pwd\nOutput:output2"]
    got = S.folded_commands(log(spark, cmd("ls"), out("same"), ("say", None, "command_output", "same"))).collect()
    assert [r.text for r in got] == ["ls\nOutput:same"]
    mcp, resp = lambda t: ("ask", "use_mcp_server", None, t), lambda t: ("say", None, "mcp_server_response", t)
    got = S.folded_commands(log(spark, mcp('{"a":1}'), resp("r1"), resp("r2"))).collect()
    assert [r.text for r in got] == ['{"a":1,"response":"r1\\nr2"}']
    # A request between a command and its last output is passed over.
    got = S.folded_commands(log(spark, cmd("ls"), mcp('{"a":1}'), resp("r"), out("o"))).orderBy("seq").collect()
    assert [r.text for r in got] == ["ls\nOutput:o", '{"a":1}']


def test_timeline(spark):
    m = log(spark, ("say", None, "text", "hi"), started('{"a":1}'), ("say", None, "api_req_finished", '{"b":2}'), ("say", None, "noise", ""))
    got = S.timeline(m, ["api_req_started"]).collect()
    assert [(r["index"], r.text) for r in got] == [(1, '{"a":1,"b":2}')]


HISTORY = "conv_id string, seq long, ts long, role string, content string, isSummary boolean, condenseId string, condenseParent string, isTruncationMarker boolean, truncationId string, truncationParent string"


def history(spark, messages):
    names = [c.split()[0] for c in HISTORY.split(", ")]
    return spark.createDataFrame([tuple({"conv_id": "c", "seq": i, "ts": 100 + i, "role": "user", **m}.get(n) for n in names) for i, m in enumerate(messages)], HISTORY)


def test_visibility_and_orphans(spark):
    m = history(spark, [{}, {"condenseParent": "s"}, {"condenseParent": "s"}, {"isSummary": True, "condenseId": "s"}, {}, {}, {"condenseParent": "gone"}])
    assert sorted(r.seq for r in R.hidden_by_parent(m).collect()) == [0, 3, 4, 5, 6]
    assert {r.seq: r.condenseParent for r in R.cleared_orphans(m).collect()} == {0: None, 1: "s", 2: "s", 3: None, 4: None, 5: None, 6: None}
    got = R.released(m, F.lit(False)).collect()
    assert sorted(r.seq for r in got) == [0, 1, 2, 4, 5, 6] and {r.condenseParent for r in got} == {None, "gone"}


def test_truncation(spark):
    m = history(spark, [{"role": "user" if i % 2 == 0 else "assistant"} for i in range(11)])
    got = B.truncated(m, 0.5, "t1").orderBy("position").collect()
    assert len(got) == 12 and sum(r.truncationParent == "t1" for r in got) == 4
    marker = next(r for r in got if r.isTruncationMarker)
    assert got.index(marker) == 5 and marker.ts == 104 and "4 messages hidden" in marker.content
    assert B.truncated(m.limit(2), 0.5, "t").count() == 2


def test_managed(spark):
    m = history(spark, [{} for _ in range(5)]).withColumn("tokens", F.lit(10))
    state = spark.createDataFrame([("c", True)], "conv_id string, manage boolean")
    got = B.managed(m, state, "t").collect()
    assert len(got) == 6 and {r.visible_tokens for r in got} == {30}


def test_since_summary(spark):
    m = history(spark, [{}, {"role": "assistant"}, {"isSummary": True, "role": "assistant"}, {}])
    assert sorted(r.seq for r in S.since_summary(m).collect()) == [0, 2, 3]
    assert S.since_summary(m.filter("seq < 2")).count() == 2


def test_rewind_exact(spark):
    m = history(spark, [{}, {"role": "assistant"}, {}]).select("conv_id", "seq", "ts", "role")
    cut = lambda x: spark.createDataFrame([("c", x)], "conv_id string, cutoff long")
    assert sorted(r.seq for r in S.rewound(m, "conv_id", cut(101)).collect()) == [0]
    assert sorted(r.seq for r in S.rewound(m, "conv_id", cut(101), inclusive=True).collect()) == [0, 1]


def test_tool_results(spark):
    uses = spark.createDataFrame([("c", "a", 1), ("c", "b", 5), ("c", "d", 6)], "conv_id string, tool_use_id string, seq long")
    results = spark.createDataFrame([("c", "a", 2), ("c", "a", 3), ("c", "x", 7), ("c", "d", 8)], "conv_id string, tool_use_id string, seq long")
    assert {(r.id, r.state) for r in R.tool_result_check(uses, results).collect()} == {("a", "duplicate"), ("b", "missing"), ("d", "ok"), ("x", "invalid")}
    assert {(r.seq, r.use_seq) for r in R.tool_use_before(results, uses).collect()} == {(2, 1), (3, 1), (7, None), (8, 6)}


def test_suggestions(spark):
    h = spark.createDataFrame([(1, "foo", "", "bar()"), (2, "foobar", "", "(x)"), (3, "zz", "", "")], "seq long, prefix string, suffix string, text string")
    q = spark.createDataFrame([(1, "foo", ""), (2, "foobar(", ""), (3, "foob", ""), (4, "zz", ""), (5, "q", "")], "req long, prefix string, suffix string")
    assert {r.req: (r.kind, r.suggestion) for r in R.suggestion(q, h).collect()} == {1: ("deletion", "bar(x)"), 2: ("typing", "x)"), 3: ("deletion", "ar(x)"), 4: ("exact", "")}


def test_approval(spark):
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "prefix string")
    commands = spark.createDataFrame([("git status",), ("Git push origin",), ("rm x",), ("ls",)], "cmd string")
    got = R.approval(commands, frame(["git", "rm x"]), frame(["git push", "rm"]), "cmd")
    assert {r.cmd: r.decision for r in got.collect()} == {"git status": "approve", "Git push origin": "deny", "rm x": "approve", "ls": "ask"}
    got = R.longest_prefix(commands, frame(["git", "git push", "*"]), "cmd")
    assert {r.cmd: r.matched for r in got.collect()} == {"git status": "git", "Git push origin": "git push", "rm x": "*", "ls": "*"}


def test_repeated_rows_stay(spark):
    s = spark.createDataFrame([("3.37.0", "a"), ("3.36.4", "b")], "since string, value string")
    q = spark.createDataFrame([("3.36.5",), ("3.36.5",), (None,), (None,)], "version string")
    out = R.as_of_version(q, s)
    assert sorted((r.version or "", r.value or "") for r in out.collect()) == [("", ""), ("", ""), ("3.36.5", "b"), ("3.36.5", "b")]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    p = spark.createDataFrame([("git",)], "prefix string")
    c = spark.createDataFrame([("git a",), ("git a",), (None,), (None,), ("ls",)], "cmd string")
    assert sorted((r.cmd or "", r.matched or "") for r in R.longest_prefix(c, p, "cmd").collect()) == [("", ""), ("", ""), ("git a", "git"), ("git a", "git"), ("ls", "")]
    assert R.approval(c, p, p, "cmd").count() == 5


def test_versions(spark):
    s = spark.createDataFrame([("3.37.0", "a"), ("3.36.4", "b"), ("3.35.0", "c"), ("4.0.0", "d")], "since string, value string")
    q = spark.createDataFrame([("3.36.5",), ("3.1.0",), ("3.37.0-beta",)], "version string")
    assert {r.version: (r.matched, r.value) for r in R.as_of_version(q, s).collect()} == {"3.36.5": ("3.36.4", "b"), "3.1.0": (None, None), "3.37.0-beta": ("3.37.0", "a")}


def test_maps(spark):
    m = spark.createDataFrame([("r", {"read": (3, 0), "diff": (3, 1)}), ("r", {"read": (3, 0), "diff": (2, 0)})], "run string, tool_usage map<string,struct<attempts:int,failures:int>>")
    assert {tuple(r)[1:] for r in A.merged_usage(m, ["run"]).collect()} == {("read", 6, 0), ("diff", 5, 1)}
    assert {tuple(r)[1:] for r in A.merged_usage(m, ["run"], how="max").collect()} == {("read", 3, 0), ("diff", 3, 1)}
    assert A.usage_map(A.merged_usage(m, ["run"]), ["run"]).first().tool_usage["diff"].attempts == 5
    changed = A.changes(m.withColumn("seq", F.monotonically_increasing_id()), "run", "seq", ["tool_usage"])
    assert changed.count() == 2


def test_task_metrics(spark):
    d = datetime(2024, 1, 1)
    tasks = spark.createDataFrame([(1, d, d.replace(minute=1)), (2, d, None)], "id int, started_at timestamp, finished_at timestamp")
    stored = spark.createDataFrame([(1, 5, 0), (2, 7, 9)], "id int, tokens int, duration int")
    streamed = spark.createDataFrame([(1, 6, 3), (2, 8, 4)], "id int, tokens int, duration int")
    got = A.task_metrics(tasks, stored, streamed, "id", ["tokens", "duration"])
    assert {(r.id, r.tokens, r.duration) for r in got.collect()} == {(1, 5, 60000), (2, 8, 4)}


def test_tree_costs_with_cycle(spark):
    spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("c", None, 1.5)], "id string, parent string, cost double").createOrReplaceTempView("tree_fixture")
    got = A.tree_cost(spark, "tree_fixture", "id", "parent", "cost", "true").collect()
    assert {r.root: (r.own, r.total) for r in got} == {"a": (1.0, 3.0), "b": (2.0, 3.0), "c": (1.5, 1.5)}


def test_properties_and_payloads(spark):
    m = lambda **k: F.create_map(*[x for p in k.items() for x in map(F.lit, p)])
    got = spark.range(1).select(R.merged_properties(m(a="1", b="2"), m(b="3", git="g"), ["git"], F.lit(False)).alias("x"), R.valid_payload(m(filePath="f", codeChunk="c", startLine="1", endLine="2")).alias("v"), R.valid_payload(m(filePath="f")).alias("w")).first()
    assert got.x == {"a": "1", "b": "3"} and got.v and not got.w


def test_snippets_and_sampling(spark):
    now = datetime(2024, 1, 1, 12)
    rows_ = spark.createDataFrame([(" ", False, now), ("x", True, datetime(2024, 1, 1, 11)), ("y", True, now), ("z", False, None)], "c string, clip boolean, t timestamp")
    assert [r.c for r in rows_.filter(R.valid_snippet(F.col("c"), F.col("clip"), F.col("t"), now)).collect()] == ["y", "z"] or [r.c for r in rows_.filter(R.valid_snippet(F.col("c"), F.col("clip"), F.coalesce("t", F.lit(now)), now)).collect()] == ["y", "z"]
    n = R.sampled(spark.range(10_000), 0.2, 1).count()
    assert 1700 < n < 2300 and R.sampled(spark.range(10), 7.0, 1).count() == 10


def test_git_changes(spark):
    lines = spark.createDataFrame([("M\ta",), ("R100\told\tnew",), ("C75\ta\tb",), ("D\tz",)], "line string")
    assert set(rows(R.git_changes(lines))) == {("a", "modify"), ("old", "delete"), ("new", "add"), ("b", "add"), ("z", "delete")}


def frame(spark, text, key="k"):
    return spark.createDataFrame([(key, i, x) for i, x in enumerate(text.split("\n"))], "k string, pos int, line string")


def kept(df):
    return [r.line for r in df.orderBy("pos").collect()]


def test_line_stops(spark):
    assert kept(S.stop_at_lines(frame(spark, "a\nend\nb"), "k", ["end"])) == ["a"]
    assert kept(S.stop_at_lines(frame(spark, "a 'end'\nbend\nend it\nb"), "k", ["end"])) == ["a 'end'", "bend"]
    assert kept(S.stop_at_lines(frame(spark, "x end\n end \nb"), "k", ["end"], exact=True)) == ["x end"]
    assert kept(S.stop_at_similar(frame(spark, "a\nreturn value;\nb"), "k", "return value;")) == ["a"]
    assert kept(S.without_path_lines(frame(spark, "// Path: a.ts\n//\ncode"), "k.ts" and "a.ts")) == ["code"]
    assert kept(S.without_prefixes(frame(spark, "<COMPLETION>a\n<COMPLETION>b\nc\n<COMPLETION>d"), "k")) == ["a", "b", "c", "<COMPLETION>d"]
    chunks = spark.createDataFrame([("k", 0, "a\nb"), ("k", 1, "c\nd")], "k string, n int, t string")
    assert kept(S.lines_of_chunks(chunks, "k", "n", "t")) == ["a", "bc", "d"]


def test_markdown(spark):
    text = "intro\n# One\n" + "body line that is long enough\n" * 4 + "Two\n===\nshort\n"
    lines = frame(spark, text)
    got = S.markdown_sections(lines, "k")
    assert [(r.title, r.level, r.start, r.end) for r in got.orderBy("start").collect()] == [("One", 1, 1, 5), ("Two", 1, 6, 9)]
    assert [r.outline for r in S.section_outline(got).orderBy("start").collect()] == ["2--6 | # One", "7--10 | # Two"]
    chunks = E.chunked_sections(lines, got, "k")
    assert [(r.identifier, r.start_line, r.end_line) for r in chunks.collect()] == [("One", 2, 6)]


def test_unified_diff(spark):
    text = "--- a\n+++ b\n@@ -1,2 +1,2 @@\n x\n-old\n+new\n@@ -10,1 +10,1 @@\n y"
    got = S.diff_line_numbers(frame(spark, text), "k").orderBy("pos").collect()
    assert [(r.kind, r.old, r.new, r.text) for r in got] == [("context", 1, 1, "x"), ("deletion", 2, None, "old"), ("addition", None, 2, "new"), ("gap", None, None, got[3].text), ("context", 10, 10, "y")]


def test_log_elapsed(spark):
    got = S.log_elapsed(frame(spark, "[2024-01-01T00:00:00Z] [x] start\n[2024-01-01T00:00:02.5Z] next"), "k").orderBy("pos").collect()
    assert [(r.elapsed, r.message) for r in got] == [(0.0, "start"), (2.5, "next")]


def test_read_within(spark):
    lines = frame(spark, "aaaa\nbbbb\ncccc")
    r = B.read_within(lines, "k", F.length("line"), 8).first()
    assert (r.content, r.line_count, r.token_count, r.complete) == ("aaaa\nbbbb", 2, 8, False)
    assert B.read_within(lines, "k", F.length("line"), 12).first().complete


def test_greedy_with_priority(spark):
    r = spark.createDataFrame([("q", 1, 1, 50), ("q", 2, 0, 60), ("q", 3, 2, 20)], "k string, id int, priority int, tokens int")
    assert sorted(x.id for x in B.greedy_fill(r, "k", ["priority", "id"], "tokens", 110, overhead=10).collect()) == [2, 3]


def test_vectors(spark):
    p = spark.createDataFrame([("1", [1.0, 0.0], "src/a"), ("2", [0.8, 0.6], "src2/b"), ("m", [1.0, 0.0], "src/m")], "id string, vector array<double>, filePath string")
    assert [r.id for r in V.search(p, [1.0, 0.0], "src", marker="m").collect()] == ["1"]
    assert [r.id for r in V.search(p, [1.0, 0.0], "src", by_segment=False, marker="m").collect()] == ["1", "2"]
    assert V.search(p, [0.0, 0.0]).count() == 0
    new = spark.createDataFrame([("2", [0.0, 1.0], "x", "c", 1, 2)], "id string, vector array<double>, filePath string, codeChunk string, startLine int, endLine int")
    assert V.upserted(p, new).count() == 3 and V.upserted(p, new.drop("codeChunk")).count() == 3
    assert V.without_files(p, spark.createDataFrame([("/w/./src/a",)], "filePath string"), "/w").count() == 2
    files = spark.createDataFrame([("a.py", 10), ("b.bin", 10), ("c.PY", 2_000_000)], "path string, length long")
    assert [r.path for r in V.within_size(files, (".py",)).collect()] == ["a.py"]
    with pytest.raises(ValueError, match="queries"):
        V.search_many(p, spark.range(3).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("query")), 1, max_queries=2)


def test_index_batch(spark):
    points = spark.createDataFrame([("old", [1.0], "f", "c", 1, 2), ("other", [1.0], "g", "c", 1, 2)], "id string, vector array<double>, filePath string, codeChunk string, startLine int, endLine int")
    hashes = spark.createDataFrame([("f", "h0"), ("g", "h1")], "path string, hash string")
    chunks = E.chunked(spark.createDataFrame([("f", "text " * 20)], "path string, text string"), "path", "text")
    vectors = chunks.select("segmentHash", F.array(F.lit(0.5)).alias("vector"))
    p, h = V.index_batch(points, hashes, chunks, vectors)
    assert p.count() == 2 and "old" not in {r.id for r in p.collect()} and {r.path: r.hash for r in h.collect()}["f"] != "h0"


def test_branches(spark):
    r = spark.createDataFrame([("main", "a", 1, 2, 0.5), ("dev", "a", 1, 2, 0.9), ("main", "b", 1, 2, 0.4)], "branch string, filePath string, startLine int, endLine int, score double")
    assert {(x.filePath, x.branch) for x in V.preferred_branch(r, "dev", "main").collect()} == {("a", "dev"), ("b", "main")}
    gone = spark.createDataFrame([("b",)], "filePath string")
    assert V.preferred_branch(r, "dev", "main", gone).count() == 1


def test_grouped(spark):
    r = spark.createDataFrame([("s", "b"), ("s", "a"), ("t", "c")], "section string, item string")
    assert {x.section: x.results for x in X.grouped(r, "section", "item").collect()} == {"s": ["a", "b"], "t": ["c"]}
