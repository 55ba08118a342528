"""Two-pass external shuffle into shards. DataFrame functions only.

Pass 1 scatters whole records into memory-sized buckets by a seeded hash; pass 2
shuffles each bucket with Fisher-Yates (Spark's seeded ``shuffle``). The buckets one
after another are a random order of all rows, which is cut into shards of equal row
counts. Buckets number ``bytes / bucket_bytes``, so memory per bucket stays the same
at every size; a partition holds several, so that partitions grow with the root of the
size only, up to PART_BUCKETS buckets each.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets of so many buckets are broadcast at most, 16 bytes each.
BROADCAST_BUCKETS = 1_000_000
#: Buckets of a partition at most. Beyond 128 Spark sorts them on disk and takes one at a time.
PART_BUCKETS = 512


def record_size(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text counts as one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def external_shuffle(
    docs: DataFrame,
    *,
    shards: int = 8,
    seed: int = 20240101,
    bucket_bytes: int = 2 << 20,
    bucket_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` (int) and ``slot`` (long, from 0 in each shard).

    Row counts of shards differ by one at most. Order and shards depend on rows, seed
    and bucket sizes, not on file layout or the number of executors.

    Null ids and texts hash like any value. Rows equal in id and text share a bucket, as
    large as they are, and change places freely. One very long text makes a bucket of its
    own size. An empty table gives an empty table. Columns of ``docs`` named ``shard`` or
    ``slot`` are replaced; others may have any name, but for those that begin with ``_sh_``.
    """
    docs = docs.drop("shard", "slot")
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(record_size(F.col(text_col))), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes), -(-rows // bucket_rows))
    per = min(PART_BUCKETS, max(1, ceil(sqrt(buckets) / 4)))
    key = (F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in (id_col, text_col))), F.col(id_col), F.col(text_col))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)).cast("int")
    before = Window.orderBy("_sh_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        docs.select(bucket.alias("_sh_b"))
        .groupBy("_sh_b")
        .agg(F.count(F.lit(1)).alias("_sh_n"))
        .select(F.col("_sh_b").alias("_sh_of"), F.coalesce(F.sum("_sh_n").over(before), F.lit(0)).alias("_sh_start"))
    )
    # A partition shuffles its buckets in order of their numbers, with a stream of random
    # numbers seeded by its own number.
    mixed = (
        docs.select(
            bucket.alias("_sh_b"),
            F.struct(F.xxhash64(F.lit(seed + 1), *key).alias("_sh_h"), *docs.columns).alias("_sh_rec"),
        )
        .withColumn("_sh_p", F.floor(F.col("_sh_b") / per).cast("int"))
        .repartitionById(-(-buckets // per), "_sh_p")
        .groupBy("_sh_p", "_sh_b")
        .agg(F.array_sort(F.collect_list("_sh_rec"), _by_hash).alias("_sh_recs"))
        .sortWithinPartitions("_sh_b")
        .select("_sh_b", F.shuffle("_sh_recs", F.lit(seed)).alias("_sh_recs"))
        .select("_sh_b", F.posexplode("_sh_recs").alias("_sh_i", "_sh_rec"))
    )
    if buckets <= BROADCAST_BUCKETS:  # 16 bytes a bucket; beyond it Spark joins by shuffle
        starts = F.broadcast(starts)
    return (
        mixed.join(starts, F.col("_sh_b") == F.col("_sh_of"))
        .withColumn("_sh_at", (F.col("_sh_start") + F.col("_sh_i")).cast("long"))
        .withColumn("shard", F.expr(f"cast(({shards} * (_sh_at + 1) - 1) div {max(rows, 1)}L as int)"))
        .select(
            *(F.col("_sh_rec")[c].alias(c) for c in docs.columns),
            "shard",
            F.expr(f"_sh_at - (cast(shard as bigint) * {rows}L) div {shards}").cast("long").alias("slot"),
        )
    )


def _by_hash(a: Column, b: Column) -> Column:
    return (
        F.when(a["_sh_h"] < b["_sh_h"], -1)
        .when(a["_sh_h"] > b["_sh_h"], 1)
        .otherwise(0)
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The shuffled records as ``path/shard=K/``: a file for each bucket and shard, in slot order."""
    external_shuffle(docs, **options).write.partitionBy("shard").parquet(path)
