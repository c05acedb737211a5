"""Sources and sinks: files, message logs, the evaluation store, vector tables."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.operators.editing import seen_files
from loomline.operators.sequences import counted

# Folders that file listings pass over.
SKIPPED_FOLDERS = ("node_modules", "__pycache__", "env", "venv", "target/dependency", "build/dependencies", "dist", "out", "bundle", "vendor", "tmp", "temp", "deps", "pkg", "Pods", ".git", ".*")

RUNS = "id int, task_metrics_id int, model string, name string, description string, contextWindow int, inputPrice float, outputPrice float, cacheWritesPrice float, cacheReadsPrice float, settings string, jobToken string, pid int, socket_path string, execution_method string, concurrency int, timeout int, passed int, failed int, created_at timestamp"
TASKS = "id int, run_id int, task_metrics_id int, language string, exercise string, iteration int, passed boolean, started_at timestamp, finished_at timestamp, created_at timestamp"
METRICS = "id int, tokens_in int, tokens_out int, tokens_context int, cache_writes int, cache_reads int, cost float, duration int, tool_usage map<string,struct<attempts:int,failures:int>>, created_at timestamp"
TOOL_ERRORS = "id int, run_id int, task_id int, tool_name string, error string, created_at timestamp"
API_MESSAGES = "role string, content string, ts long, isSummary boolean, condenseId string, condenseParent string, isTruncationMarker boolean, truncationId string, truncationParent string"


def list_files(spark: SparkSession, folder: str, recursive: bool = True, limit: int = 0, glob: str = "*", ignore: Iterable[str] = ()) -> tuple[DataFrame, bool]:
    """SC9, SC10, VS13, XS23: path, length and modification time below a folder, less what is ignored; and whether the limit was hit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(folder).select("path", "length", "modificationTime")
    if patterns := list(ignore):
        base = "file:" + folder if folder.startswith("/") else folder
        relative = files.withColumn("_r", F.regexp_replace(F.replace(F.col("path"), F.lit("file:///"), F.lit("file:/")), "^" + re.escape(base.rstrip("/")) + "/", ""))
        files = seen_files(relative, "_r", patterns).drop("_r")
    if not limit:
        return files, False
    return files.orderBy("path").limit(limit), files.limit(limit + 1).count() > limit


def newest_first(files: DataFrame) -> DataFrame:
    """XS23."""
    return files.orderBy(F.desc("modificationTime"), "path")


def read_messages(spark: SparkSession, path: str, schema: str | StructType = API_MESSAGES) -> DataFrame:
    """SC12: message files that hold one JSON array each, with the position in it as seq."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    text = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), "value")
    return text.select("file", F.posexplode(F.from_json("value", f"array<struct<{_nested(kind)}>>")).alias("seq", "m")).select("file", F.col("seq").cast("long").alias("seq"), "m.*")


def _nested(ddl: str) -> str:
    return ddl if ":" in ddl.split(",")[0] else ", ".join(f"{p.strip().split(' ', 1)[0]}:{p.strip().split(' ', 1)[1]}" for p in ddl.split(","))


def spreadsheets(spark: SparkSession, path: str, rows: int = 50_000) -> DataFrame:
    """SC11: workbooks as tab-separated text, a part per visible sheet, each of up to `rows` rows: the limit is the feature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sheet_text(x, rows) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")


def sheet_text(data: bytes, rows: int = 50_000) -> str:
    """The visible sheets of a workbook, read from its XML: strings, numbers, booleans, errors and inline text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(BytesIO(data)) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in tree("xl/sharedStrings.xml").findall("m:si", ns)] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in tree("xl/workbook.xml").findall("m:sheets/m:sheet", ns):
            if sheet.get("state") in ("hidden", "veryHidden"):
                continue
            lines = []
            for n, row in enumerate(tree("xl/" + targets[sheet.get(rel)].lstrip("/").removeprefix("xl/")).findall("m:sheetData/m:row", ns)):
                if n >= rows:
                    lines.append(f"[... truncated at row {rows + 1} ...]")
                    break
                cells: dict[int, str] = {}
                for at, c in enumerate(row.findall("m:c", ns)):
                    column = 0
                    for letter in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                        column = column * 26 + ord(letter) - 64
                    value, kind = c.find("m:v", ns), c.get("t")
                    text = value.text or "" if value is not None else "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                    cells[column - 1 if column else at] = shared[int(text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text
                if any(cells.values()):
                    lines.append("\t".join(cells.get(i, "") for i in range(max(cells) + 1)))
            out.append(f"--- Sheet: {sheet.get('name')} ---\n" + "\n".join(lines))
    return "\n\n".join(out).strip()


# The evaluation store: tables are DataFrames; writing is replacing a table with what these return.


def inserted(table: DataFrame, rows: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """SC5: the table with new rows, and those rows. Rows that have a key keep it; the others are numbered after the greatest key of both sides."""
    tops = [x.agg(F.max(key)).first()[0] or 0 for x in (table, rows)]
    missing = [c for c in table.columns if c not in rows.columns]
    full = rows.withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in missing})
    made = counted(full.filter(F.col(key).isNull()), "_new").withColumn(key, (F.col("_new") + max(tops)).cast(table.schema[key].dataType))
    made = full.filter(F.col(key).isNotNull()).withColumn(key, F.col(key).cast(table.schema[key].dataType)).select(table.columns).unionByName(made.select(table.columns))
    return table.unionByName(made), made


def updated(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """SC6, ST5: rows of the key take the values of `changes` where these aren't null."""
    c = changes.select(F.col(key).alias("_k"), *[F.col(x).alias(f"_n_{x}") for x in changes.columns if x != key])
    return table.join(c, F.col(key) == F.col("_k"), "left").select(*[F.coalesce(f"_n_{x}", x).alias(x) if x != key and x in changes.columns else F.col(x) for x in table.columns])


def deleted_runs(tables: dict[str, DataFrame], runs: DataFrame) -> dict[str, DataFrame]:
    """SC7: all tables without some runs: their tool errors, tasks, both metrics, and the runs. runs: id."""
    ids = runs.select(F.col("id").alias("_id")).distinct()
    without = lambda t, c: t.join(ids, F.col(c) == F.col("_id"), "left_anti")
    gone_runs, gone_tasks = tables["runs"].join(ids, F.col("id") == F.col("_id"), "left_semi"), tables["tasks"].join(ids, F.col("run_id") == F.col("_id"), "left_semi")
    metrics = gone_runs.select("task_metrics_id").unionByName(gone_tasks.select("task_metrics_id")).filter("task_metrics_id is not null").withColumnRenamed("task_metrics_id", "_m").distinct()
    out = {"tool_errors": without(tables["tool_errors"], "run_id"), "tasks": without(tables["tasks"], "run_id"), "runs": without(tables["runs"], "id"), "metrics": tables["metrics"].join(metrics, F.col("id") == F.col("_m"), "left_anti")}
    return {**tables, **out}


def copied_run(source: dict[str, DataFrame], target: dict[str, DataFrame], run_id: int) -> dict[str, DataFrame]:
    """SC8: the target's tables with a run of the source, its tasks, metrics and tool errors under new keys. All columns are copied."""
    run = source["runs"].filter(F.col("id") == run_id)
    tasks = source["tasks"].filter(F.col("run_id") == run_id)
    errors = source["tool_errors"].filter(F.col("run_id") == run_id)
    wanted = run.select("task_metrics_id").unionByName(tasks.select("task_metrics_id")).filter("task_metrics_id is not null").distinct()
    metrics = source["metrics"].join(wanted, F.col("id") == F.col("task_metrics_id"), "left_semi")

    def remapped(rows: DataFrame, table: DataFrame) -> DataFrame:
        top = table.agg(F.max("id")).first()[0] or 0
        return counted(rows.select(F.col("id").alias("_old")).orderBy("_old"), "_new").select("_old", (F.col("_new") + top).cast("int").alias("_new"))

    def rekeyed(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
        return rows.join(ids, F.col(column) == F.col("_old"), "left").withColumn(column, F.col("_new")).drop("_old", "_new")

    maps = {n: remapped(rows, target[n]) for n, rows in (("runs", run), ("tasks", tasks), ("metrics", metrics), ("tool_errors", errors))}
    new = {
        "metrics": rekeyed(metrics, "id", maps["metrics"]),
        "runs": rekeyed(rekeyed(run, "id", maps["runs"]), "task_metrics_id", maps["metrics"]),
        "tasks": rekeyed(rekeyed(rekeyed(tasks, "id", maps["tasks"]), "run_id", maps["runs"]), "task_metrics_id", maps["metrics"]),
        "tool_errors": rekeyed(rekeyed(rekeyed(errors, "id", maps["tool_errors"]), "run_id", maps["runs"]), "task_id", maps["tasks"]),
    }
    return {n: target[n].unionByName(new[n]) for n in new}


def marked(metadata: DataFrame | None, spark: SparkSession, complete: bool) -> DataFrame:
    """SC15: the one row that says whether an index is complete; it is kept apart from the points."""
    del metadata
    return spark.createDataFrame([(complete,)], "complete boolean")


def has_data(points: DataFrame, metadata: DataFrame) -> bool:
    """SC15: an index with points whose last run was completed."""
    return not metadata.filter("complete").isEmpty() and not points.isEmpty()


def compacted(spark: SparkSession, path: str, out: str, rows_per_file: int = 1_000_000) -> None:
    """SC16: a table rewritten in files of about a given number of rows."""
    spark.read.parquet(path).hint("rebalance").write.option("maxRecordsPerFile", rows_per_file).parquet(out)
