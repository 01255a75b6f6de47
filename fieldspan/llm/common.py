"""Helpers shared by the operators: tables of control values, staged tables, word splitting."""

from __future__ import annotations

import atexit
import json
import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\f\r"

_own_dir: list[str] = []


def ship(module: str) -> None:
    """Send this module's functions to executors by value: they need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the session names
    none, a temporary one on a single machine (as in tests), and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="fieldspan-"))
    return _own_dir[0]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already
        pass


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it is deleted when this Python process ends."""
    path = f"{shared_dir(spark)}/fieldspan/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table that was written.

    This cuts the lineage; the table outlives any executor, and values such as generated row
    ids are fixed from here on."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop(staged: DataFrame) -> None:
    """Delete the files of a table of stage() that nothing reads any more."""
    _delete(staged.sparkSession, staged.staged_at)


@contextmanager
def arrow_batches(spark: SparkSession, size: int = 8 << 20, rows: int = 2000):
    """While tables are written in this block, Python workers get batches of so many bytes and rows at
    most, so that a worker's memory doesn't depend on how long texts are."""
    names = {"spark.sql.execution.arrow.maxBytesPerBatch": str(size), "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Tables written in this block leave no shuffle files behind: what follows reads the tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A table of control values (one row for each shard, source, rule ...) held by the driver."""
    data = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_typed(ddl)}>>")
    return spark.range(1).select(F.inline(data))


def _typed(ddl: str) -> str:
    out, depth, cur = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = cur.strip().split(" ", 1)
            out.append(f"{name}:{kind.strip()}")
            cur = ""
        else:
            cur += ch
    return ",".join(out)


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """df under names that no operator uses for its own columns, those names by df's, and columns that give
    df's names back: whatever an input's columns are called, none is taken for another."""
    names = {c: f"__input_{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names, [F.col(new).alias(old) for old, new in names.items()]


def words(text: Column) -> Column:
    """array<string>: the maximal runs of other characters than white space; null gives none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS + "+"))


def word_count(text: Column) -> Column:
    """long: how many words a text has, without building them."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), rf"{WS}*[^\x20\x09-\x0D]+{WS}*", "w")
    marks = F.regexp_replace(marks, f"^{WS}+$", "")
    return F.length(marks).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
