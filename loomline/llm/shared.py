"""Helpers that several training-data operators use."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable
from types import ModuleType
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words, as a Java/Python character class and as plain text.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one serves a single-machine session; elsewhere that is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loomline-")
        place = spark._jvm.org.apache.hadoop.fs.Path(where)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small rows: Spark's cleaner removes it once nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A Parquet table in the shared folder, for wide rows: read back, only the columns that are needed are loaded. It goes with the application at the latest."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """In as many partitions as `rows` rows fill, 8 at least: small tables that are shuffled again and again leave fewer files."""
    n = max(8, -(-rows // each))
    return df.coalesce(n) if n < partitions(df) else df


def sweep(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that Spark's cleaner removes shuffles and checkpoints that nothing refers to any more."""
    spark._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later plan reads, and lets Spark clear the shuffles that made them."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        sweep(tables[0].sparkSession)


def blank_null(name: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def kept_in_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """A value made once per Python process. Functions reach executors by value, with globals of their own, so it hangs on a module."""
    cache = vars(sys.modules.setdefault("_loomline_kept", ModuleType("_loomline_kept"))).setdefault("values", {})
    if key not in cache:
        cache[key] = make()
    return cache[key]
