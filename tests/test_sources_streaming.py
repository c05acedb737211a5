import io
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomline.functions.registry import InvalidTool, Registry, Tool
from loomline.sources import stores as St
from loomline.streaming import jobs as J


def test_listing(spark, tmp_path):
    for name in ("a.py", "b.txt", "node_modules/x.py", "d/c.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text("x")
    files, hit = St.list_files(spark, str(tmp_path), glob="*.py", ignore=["node_modules/"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["a.py", "c.py"] and not hit
    files, hit = St.list_files(spark, str(tmp_path), limit=2)
    assert files.count() == 2 and hit
    assert St.newest_first(files).count() == 2


def test_messages(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"role": "user", "content": "a", "ts": 1}, {"role": "assistant", "content": "b", "ts": 2}]))
    got = St.read_messages(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.role, r.content, r.ts) for r in got] == [(0, "user", "a", 1), (1, "assistant", "b", 2)]


def test_spreadsheet(spark, tmp_path):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} {r}><sheets><sheet name="S" r:id="r1"/><sheet name="H" state="hidden" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {m}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row><c r="A2" t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {m}><sheetData/></worksheet>")
    assert St.sheet_text(data.getvalue()) == "--- Sheet: S ---\nname\t\t2\nTRUE"
    (tmp_path / "b.xlsx").write_bytes(data.getvalue())
    assert "TRUE" in St.spreadsheets(spark, str(tmp_path)).first().text


def store(spark, run_ids):
    n = datetime(2024, 1, 1)
    runs = spark.createDataFrame([(i, i * 10, "m", "n", "d", 1, 1.0, 1.0, 1.0, 1.0, "{}", None, None, None, "vscode", 1, 5, 1, 0, n) for i in run_ids], St.RUNS)
    tasks = spark.createDataFrame([(i * 100, i, i * 10 + 1, "go", "say", 1, True, n, n, n) for i in run_ids], St.TASKS)
    metrics = spark.createDataFrame([(i * 10 + k, 1, 1, 1, 1, 1, 0.5, 1, {}, n) for i in run_ids for k in (0, 1)], St.METRICS)
    errors = spark.createDataFrame([(i * 7, i, i * 100, "t", "e", n) for i in run_ids], St.TOOL_ERRORS)
    return {"runs": runs, "tasks": tasks, "metrics": metrics, "tool_errors": errors}


def test_store(spark):
    t = store(spark, [1, 2])
    table, made = St.inserted(t["tool_errors"], spark.createDataFrame([(None, 1, "x")], "id int, run_id int, tool_name string"))
    assert table.count() == 3 and made.first().id == 15
    keyed = spark.createDataFrame([(20, 1, "own"), (None, 1, "a"), (None, 1, "b"), (3, 1, "low")], "id int, run_id int, tool_name string").repartition(3)
    _, made = St.inserted(t["tool_errors"], keyed)
    assert sorted(r.id for r in made.collect()) == [3, 20, 21, 22]
    up = St.updated(t["runs"], spark.createDataFrame([(1, "new", None)], "id int, model string, name string"))
    assert {(r.id, r.model, r.name) for r in up.collect()} == {(1, "new", "n"), (2, "m", "n")}
    left = St.deleted_runs(t, spark.createDataFrame([(1,)], "id int"))
    assert {k: left[k].count() for k in t} == {"runs": 1, "tasks": 1, "metrics": 2, "tool_errors": 1}
    both = St.copied_run(t, store(spark, [5]), 2)
    run = both["runs"].filter("id <> 5").first()
    task = both["tasks"].filter(F.col("run_id") == run.id).first()
    ids = {r.id for r in both["metrics"].collect()}
    assert len(ids) == 4 and {run.task_metrics_id, task.task_metrics_id} <= ids and run.timeout == 5
    assert both["tool_errors"].filter(F.col("task_id") == task.id).count() == 1


def test_index_state(spark, tmp_path):
    points = spark.range(1)
    assert St.has_data(points, St.marked(None, spark, True)) and not St.has_data(points, St.marked(None, spark, False)) and not St.has_data(points.limit(0), St.marked(None, spark, True))
    spark.range(100).repartition(10).write.parquet(str(tmp_path / "in"))
    St.compacted(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def run(spark, df, name, mode="append", most_s=120):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination(most_s)
        assert q.exception() is None
        return spark.createDataFrame(spark.table(name).collect(), spark.table(name).schema)
    finally:
        q.stop()


@pytest.fixture
def events(spark, tmp_path):
    """Two files of events a second apart, with a pause of a minute before the last two."""
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=i if i < 8 else i + 60), f"u{i % 2}", ("click", "view")[i % 3 == 0]) for i in range(10)]
    schema = "id long, ts timestamp, user string, kind string"
    for k, part in enumerate((rows[:5], rows[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    folder = tmp_path / "all"
    folder.mkdir()
    for k in range(2):
        next((tmp_path / f"p{k}").glob("*.parquet")).rename(folder / f"{k}.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # each has state of its own
    yield J.file_stream(spark, str(folder), schema), spark.createDataFrame(rows, schema)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_equals_batch(spark, events):
    stream, batch = events
    got = run(spark, J.latest_state(stream, "user", "ts", ["kind"]), "latest", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, J.latest_state(batch, "user", "ts", ["kind"]).collect()))
    usage = lambda d: J.usage_windows(d.withColumn("n", F.lit(1)).withColumn("k", F.lit("requests")), "ts", "user", "k", "n", "1 minute", "30 seconds")
    got = run(spark, usage(stream), "usage", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, usage(batch).collect()))


def test_debounced_stream(spark, events):
    stream, batch = events
    want = {(r.path, r.change, r.events) for r in J.debounced(batch, "user", "ts", "kind", "5 seconds").collect()}
    got = {(r.path, r.change, r.events) for r in run(spark, J.debounced(stream, "user", "ts", "kind", "5 seconds", delay="1 second"), "bursts").collect()}
    assert {e for *_, e in want} == {8, 2} and got == {w for w in want if w[2] == 8}  # the last burst is still open
    assert J.debounced(batch, "user", "ts", "kind", "5 seconds", per_path=True).count() == 4


def test_filters(spark, events):
    stream, _ = events
    assert run(spark, J.without_repeats(stream, ["kind"], "ts", "5 minutes"), "once").count() == 2
    lines = spark.createDataFrame([('{"a":1}',), ("{bad",), ('{"a":2}',)], "value string")
    assert sorted(r.a for r in J.parsed(lines, "a int").collect()) == [1, 2]
    e = spark.createDataFrame([("x", False, None), ("y", False, "text"), ("y", True, "text"), ("y", None, "other")], "eventName string, partial boolean, say string")
    assert J.published(e, ["x"], ["text"]).count() == 1 and J.published(e, []).count() == 3


def test_upserts(spark, events, tmp_path):
    stream, _ = events
    rows = stream.select("user", "ts", F.create_map(F.col("kind"), F.struct(F.col("id").cast("int").alias("attempts"), F.lit(0).alias("failures"))).alias("tool_usage"))
    q = rows.writeStream.foreachBatch(J.upserting(str(tmp_path / "t"), "user", "ts", "tool_usage")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = {r.user: {k: v.attempts for k, v in r.tool_usage.items()} for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {"u0": {"view": 6, "click": 8}, "u1": {"view": 9, "click": 7}}


def test_upserts_read_and_rewrite_only_their_parts(spark, tmp_path):
    write = J.upserting(str(tmp_path / "t"), "user", "ts", parts=4)
    rows = lambda xs: spark.createDataFrame(xs, "user string, ts long, v string")
    write(rows([(f"u{i}", 1, "old") for i in range(40)]), 0)
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    write(rows([("u3", 2, "new"), ("u3", 1, "late")]), 1)
    write(rows([("u3", 2, "new"), ("u3", 1, "late")]), 1)
    got = {r.user: r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert len(got) == 40 and got["u3"] == "new" and got["u4"] == "old"
    after = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert len(before.keys() & after.keys()) >= 3


def test_stateful(spark, events):
    stream, batch = events
    ms = stream.withColumn("ms", F.unix_millis("ts"))
    got = run(spark, J.cooled_down(ms, "user", "ms", 3000), "cool", "append", 15)  # expiring state keeps its batches coming
    assert {(r.key, r.ts % 86_400_000 // 1000) for r in got.collect()} == {("u0", 0), ("u0", 4), ("u0", 68), ("u1", 1), ("u1", 5), ("u1", 69)}
    got = run(spark, J.dwelling(stream, "user", "kind", "ts", 1500), "dwell", "append")
    want = {(r.user, r.kind) for r in J.dwelt(batch, "user", "ts", "kind", 1500).collect()}
    assert want <= {(r.viewer, r.shown) for r in got.collect()}


def test_queue(spark):
    items = spark.createDataFrame([("t", "a", 1), ("t", "a", 2), ("t", "b", 3), ("s", "a", 9)], "task string, blob string, ts long")
    assert {(r.task, r.ts) for r in J.queue_to_flush(items, "task", "blob", "ts", 2).collect()} == {("t", 2), ("t", 3)}
    done = spark.createDataFrame([("t", 2)], "task string, until long")
    assert {(r.task, r.ts) for r in J.after_flush(items, done, "task", "ts").collect()} == {("t", 3), ("s", 9)}


class Letters:
    def eval(self, text: str):
        for c in text:
            yield (c,)


def test_registry(spark, tmp_path):
    r = Registry(spark)
    r.register(Tool("shout", lambda x: x.upper(), "louder", {"x": "string"}))
    df = spark.createDataFrame([("a",)], "x string")
    assert r.apply(df, "shout", "x", into="y").first().y == "A"
    r.register(Tool("shout", lambda x: x + "!", "the last one wins", {"x": "string"}))
    assert r.apply(df, "shout", "x", into="y").first().y == "a!" and [t.name for t in r.list()] == ["shout"]
    r.register(Tool("letters", Letters, "each letter", {"text": "string"}, "letter string", "table"))
    assert spark.sql("SELECT * FROM letters('abc')").count() == 3
    with pytest.raises(InvalidTool) as e:
        r.register(Tool("no name", None, "", {"x": "strange"}, kind="odd"))
    assert len(e.value.problems) == 5
    path = tmp_path / "mine.py"
    path.write_text("from loomline.functions.registry import Tool\nTOOLS = [Tool('twice', lambda x: x * 2, 'doubles', {'x': 'long'}, 'long')]\n")
    (tmp_path / "bad.py").write_text("raise RuntimeError('no')")
    got = r.load(str(tmp_path))
    assert got["loaded"] == ["twice"] and len(got["failed"]) == 1 and not r.stale()
    assert spark.sql("SELECT twice(4)").first()[0] == 8
    path.unlink()
    assert r.stale() and r.unregister("twice") and not r.has("twice") and r.get("shout")
    r.clear()
    assert r.list() == []
