"""Checkpoints of jobs: versions of a table, each counted only once its commit is written.

A version is a folder of rows and, written after it, a folder of commits: for each job how many
rows it has and a checksum over them, with the schema. A version without a commit never
was; a job whose rows are not those of its commit is torn, and an older version counts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMIT = "job string, n_rows long, checksum string, schema string, version long"


def _folder(spark: SparkSession, path: str) -> tuple[object, object]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the version folders in ``path``, in order; their names only are read."""
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def checksum(columns: list[str]) -> Column:
    """A checksum of rows that does not depend on their order: the sum of a 64-bit hash, and
    the exclusive or of another, over all columns, nulls told apart from other values."""
    nulls = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns))
    total = F.sum(F.xxhash64(nulls, *columns).cast("decimal(38,0)"))
    return F.sha2(F.concat_ws("|", total.cast("string"), F.bit_xor(F.xxhash64(F.lit(7), nulls, *columns)).cast("string")), 256)


def _commits(state: DataFrame, job: str) -> DataFrame:
    schema = F.lit(state.schema.json())
    return state.groupBy(F.col(job).cast("string").alias("job")).agg(F.count(F.lit(1)).alias("n_rows"), checksum(state.columns).alias("checksum"), schema.alias("schema"))


def write_rows(state: DataFrame, folder: str, version: int) -> None:
    state.write.mode("overwrite").parquet(f"{folder}/rows/version={version}")


def commit(state: DataFrame, folder: str, version: int, job: str = "job") -> None:
    """Declare ``version`` whole, with what ``state`` holds of each job."""
    _commits(state, job).coalesce(1).write.parquet(f"{folder}/commits/version={version}")


def save(state: DataFrame, folder: str, *, job: str = "job", keep: int = 3) -> int:
    """Save all rows of ``state`` as the next version; its number. The ``keep`` newest versions
    stay. Rows come first and are read back for the commit, so the commit says what was
    written, not what should have been. A run that dies between leaves no version; its
    number is not used again. One writer at a time; a job without rows leaves no trace.
    """
    spark = state.sparkSession
    known = _versions(spark, f"{folder}/rows") + _versions(spark, f"{folder}/commits")
    version = max(known, default=0) + 1
    write_rows(state, folder, version)
    commit(spark.read.schema(state.schema).parquet(f"{folder}/rows/version={version}"), folder, version, job)
    for old in _versions(spark, f"{folder}/commits")[:-keep]:
        for part in ("commits", "rows"):  # the commit first: half a version is none
            fs, at = _folder(spark, f"{folder}/{part}/version={old}")
            fs.delete(at, True)
    return version


def load(spark: SparkSession, folder: str, *, job: str = "job") -> DataFrame | None:
    """The rows of each job's newest whole version, plus ``version``; None without any commit.

    Rows are read once to check them and once to give them back, by version, so that torn
    or unreadable files of one version hide none of another; files that cannot be read
    count as having no rows, which their commit then contradicts. Jobs whose every version
    is torn are not there. The schema is the newest commit's; older rows lack what it added.
    """
    numbers = _versions(spark, f"{folder}/commits")
    if not numbers:
        return None
    lenient = {"ignoreCorruptFiles": True, "ignoreMissingFiles": True}
    read = lambda schema, part, n: spark.read.schema(schema).options(**lenient).parquet(f"{folder}/{part}/version={n}")
    plain = T.StructType(T._parse_datatype_string(_COMMIT).fields[:-1])
    schema, whole, rows = None, None, None
    for n in reversed(numbers):  # as many as save() keeps
        told = read(plain, "commits", n)
        first = told.select("schema").first()
        if first is None or n not in _versions(spark, f"{folder}/rows"):
            continue
        own = T.StructType.fromJson(json.loads(first[0]))
        schema = schema or own
        held = read(own, "rows", n)
        found = told.select("job", "n_rows", "checksum").join(
            _commits(held, job).select(F.col("job").alias("j"), F.col("n_rows").alias("n"), F.col("checksum").alias("c")),
            F.col("job").eqNullSafe(F.col("j")) & (F.col("n_rows") == F.col("n")) & (F.col("checksum") == F.col("c")),
        ).select("job", F.lit(n).cast("long").alias("version"))
        part = held.withColumn("version", F.lit(n).cast("long"))
        whole = found if whole is None else whole.unionByName(found)
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        return None
    newest = whole.groupBy(F.col("job").alias("_job")).agg(F.max("version").alias("_version"))
    on = F.col(job).cast("string").eqNullSafe(F.col("_job")) & (F.col("version") == F.col("_version"))
    return rows.join(newest, on, "left_semi").select(*schema.names, "version")
