"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that are still there, in order of writing.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own (all its
    threads see it); a cluster session without the setting is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="spark-quern-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage,
    and a lost executor costs no recomputation."""
    return read_back(df.sparkSession, write_out(df, name), df)


def write_out(df: DataFrame, name: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/quern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return path


def read_back(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`write_out` made and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


@contextmanager
def passing(spark: SparkSession, *keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Tables written inside go at the end, but for those that the DataFrames added to the
    list read. For steps whose result is written, or whose last plan reads few of them."""
    before, kept = set(_written), list(keep)
    yield kept
    files = {f for df in kept for f in df.inputFiles()}
    for path in [p for p in _written if p not in before]:
        name = path.rsplit("/", 1)[1]
        if not any(f"/{name}/" in f for f in files):
            remove(spark, path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go as soon as its result is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
