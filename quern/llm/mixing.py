"""Mix sources to target weights by a low-discrepancy schedule of equal-word blocks.

Each source's documents, shuffled by a seeded hash, form a stream of words that repeats
up to ``epochs`` times and is cut into blocks of equal size. Van der Corput points are
mapped through the cumulative block counts of the sources: every point is a slot of the
schedule, slots are ranked within their source, and slot number r takes block r.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, hash128, materialize
from quern.operators.ordered import ranged

#: Weights of sources in order of code points, repeating.
WEIGHTS = (5, 2, 1)
#: Slots of a stretch of the schedule, in which slots of a source are ranked together.
STRETCH = 4_096
#: Documents that are put in order together.
BUCKET_DOCS = 16_384


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, *, share: tuple[int, int] = (3, 2), epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, mx_at, source_size, target, quota) for every source of (source, size).

    Targets share ``share`` times all words by weight; none exceeds ``epochs`` times its
    source, and the excess is shared again among the others. quota is the whole words of
    target. One row a source; only these rows meet in a single task.
    """
    num, den = share
    everything = Window.orderBy("mx_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("mx_at", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    weight = F.get(F.array(*map(F.lit, weights)), F.col("mx_at") % len(weights)).cast("long")
    scale = 1
    for w in set(weights):
        scale *= w
    per = per.withColumn("w", weight).withColumn("key", F.col("source_size") * (F.lit(scale) / F.col("w")).cast("long"))
    # Sources in order of the level at which they are full: the first so many are.
    filling = Window.orderBy("key", "mx_at")
    before = F.coalesce(F.sum("source_size").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights_left = F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    big = "decimal(38,0)"
    rest = (F.sum("source_size").over(everything) * num - before * (epochs * den)).cast(big)  # times den
    full = rest * F.col("w").cast("decimal(10,0)") >= (F.col("source_size") * (epochs * den)).cast(big) * weights_left.cast("decimal(18,0)")
    per = per.withColumn("full", full)
    free = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    words = F.sum("source_size").over(everything) * num - F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(everything) * (epochs * den)
    level = words.cast("double") / (free * den).cast("double")
    return per.withColumn(
        "target", F.when(F.col("full"), (F.col("source_size") * epochs).cast("double")).otherwise(level * F.col("w").cast("double"))
    ).select("source", "mx_at", "source_size", "target", F.floor("target").cast("long").alias("quota"))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """(mx_at, mx_rank, slot): the slot of the schedule that takes block mx_rank of a source.

    The points of k bits are the bit reversals of 0 .. 2^k - 1, each number once. Source s
    owns the numbers from its cumulative block count on, as many as it has blocks, so its
    slots lie evenly in the schedule, and none is short or over.
    """
    blocks = targets.withColumn("mx_blocks", F.ceil(F.col("quota") / F.lit(float(block_words))).cast("long"))
    running = Window.orderBy("mx_at").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("mx_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    owned = blocks.withColumns(
        {
            "mx_from": F.coalesce(F.sum("mx_blocks").over(running), F.lit(0)),
            "mx_bits": F.greatest(F.length(F.bin(F.greatest(F.sum("mx_blocks").over(everything) - 1, F.lit(0)))), F.lit(1)),
        }
    ).filter("mx_blocks > 0")
    points = (
        owned.withColumn("mx_part", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("mx_blocks") - 1).cast("long"), F.lit(STRETCH).cast("long"))))
        .repartition("mx_at", "mx_part")
        .withColumn("mx_i", F.explode(F.sequence(F.col("mx_part"), F.least(F.col("mx_part") + (STRETCH - 1), F.col("mx_blocks") - 1))))
        .withColumn("mx_point", (F.col("mx_from") + F.col("mx_i")).cast("long"))
        .select("mx_at", F.expr("cast(conv(reverse(lpad(bin(mx_point), mx_bits, '0')), 2, 10) as bigint)").alias("slot"))
        .withColumn("mx_stretch", (F.col("slot") / STRETCH).cast("long"))
    )
    earlier = Window.partitionBy("mx_at").orderBy("mx_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = points.groupBy("mx_at", "mx_stretch").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("mx_at", "mx_stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("mx_before"))
    within = F.row_number().over(Window.partitionBy("mx_at", "mx_stretch").orderBy("slot")) - 1
    return points.withColumn("mx_in", within).join(counts, ["mx_at", "mx_stretch"]).select(
        "mx_at", (F.col("mx_before") + F.col("mx_in")).cast("long").alias("mx_rank"), "slot"
    )


def mix_plan(
    docs: DataFrame,
    *,
    share: tuple[int, int] = (3, 2),
    epochs: int = 2,
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = 1_024,
    seed: int = 20240101,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    key_cols: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(placed, pieces). placed has a row for each row of ``docs``: id, source, size (words),
    source_size, target, mx_k1/mx_k2 (hashes of ``key_cols``, else of the three named columns),
    mx_bucket/mx_ord (its place in
    its source's order). pieces has the same columns and slot, epoch, from_word, to_word:
    which words of the row a slot takes. Words of a source's pieces add up to its quota.

    Null texts have no words; null is a source of its own, last. Rows without words are
    placed and never taken. Repeated rows are rows of their own; documents with one id are
    in order of their hashes. Reruns agree. An empty table gives empty tables. Columns of
    ``docs`` but the three named ones are ignored.
    """
    spark = docs.sparkSession
    k1, k2 = hash128(*map(F.col, key_cols or (id_col, source_col, text_col)))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = materialize(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            order.alias("mx_order"), k1.alias("mx_k1"), k2.alias("mx_k2"), F.monotonically_increasing_id().alias("mx_row"),
        ),
        "sized",
    )
    rows = sized.count()
    targets = materialize(source_targets(sized, share=share, epochs=epochs, weights=weights), "targets")
    # Ranges of the whole order of a source: no id, source or repeated row makes one larger.
    inside_order = ["mx_order", "id", "size", "mx_k1", "mx_k2", "mx_row"]
    tied = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    tied = tied.repartitionByRange(max(2, -(-rows // BUCKET_DOCS)), "mx_at", *inside_order).withColumn("mx_bucket", F.spark_partition_id())
    tied = materialize(tied, "ranges")
    earlier = Window.partitionBy("mx_at").orderBy("mx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = tied.groupBy("mx_at", "mx_bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("mx_at", "mx_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("mx_before"))
    inside = Window.partitionBy("mx_at", "mx_bucket").orderBy(*inside_order)
    placed = (
        tied.withColumns(
            {"mx_ord": F.row_number().over(inside), "mx_run": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))}
        )
        .join(sums, ["mx_at", "mx_bucket"])
        .withColumn("mx_start", (F.col("mx_before") + F.col("mx_run") - F.col("size")).cast("long"))
        .drop("mx_before", "mx_run", "mx_order", "mx_row")
    )
    placed = materialize(placed, "placed")
    b = block_words
    cut = (
        placed.filter("size > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("mx_lo", F.col("epoch") * F.col("source_size") + F.col("mx_start"))
        .withColumn("mx_hi", F.least(F.col("mx_lo") + F.col("size"), F.col("quota")))
        .filter("mx_lo < mx_hi")
        .withColumn("mx_rank", F.explode(F.sequence(F.expr(f"mx_lo div {b}"), F.expr(f"(mx_hi - 1) div {b}"))))
    )
    pieces = cut.join(schedule(targets, block_words), ["mx_at", "mx_rank"]).select(
        *placed.columns,
        "slot",
        "epoch",
        (F.greatest(F.col("mx_lo"), F.col("mx_rank") * b) - F.col("mx_lo")).alias("from_word"),
        (F.least(F.col("mx_hi"), (F.col("mx_rank") + 1) * b) - F.col("mx_lo")).alias("to_word"),
    )
    return placed, pieces


def taken_words(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """placed plus ``taken``: the words that the mix takes of a row, repeats counted.
    Spark broadcasts the sums only while they are below its own bound
    (spark.sql.autoBroadcastJoinThreshold)."""
    key = ["mx_at", "mx_bucket", "mx_ord"]
    sums = pieces.groupBy(*key).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return placed.join(sums, key, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


#: Rows that repeat entirely and are numbered together.
REPEATS = 16_384


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` plus ``mx_no``, from 1 within (mx_k1, mx_k2), in ranges: no task gets a key."""
    cut = ranged(rows, [F.col("mx_k1"), F.col("mx_k2"), *order], REPEATS)
    key = ["mx_k1", "mx_k2"]
    per = cut.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # Keys that go on in the next range: a row a range at most.
    before = per.withColumn("mx_skip", F.sum("n").over(earlier)).filter("mx_skip > 0").drop("n").withColumnsRenamed({"mx_k1": "b1", "mx_k2": "b2", "_range": "b_range"})
    crossed = (F.col("mx_k1") == F.col("b1")) & (F.col("mx_k2") == F.col("b2")) & (F.col("_range") == F.col("b_range"))
    inside = F.row_number().over(Window.partitionBy("_range", *key).orderBy(*order))
    return cut.withColumn("mx_in", inside).join(F.broadcast(before), crossed, "left").select(
        *rows.columns, (F.col("mx_in") + F.coalesce("mx_skip", F.lit(0))).alias("mx_no")
    )


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix, with the columns of ``docs`` plus ``mix_slot``: each row once for
    each epoch that takes words of it. A row at the end of its source's quota is cut to the
    words taken; all others keep their text. Rows that are not taken are left out.

    Nulls, ties and repeats: as :func:`mix_plan`. Rows that repeat entirely are numbered, in
    ranges, and each takes its own part. An empty table gives an empty table. A column of
    ``docs`` named ``mix_slot`` is replaced; others may have any name, but for those that
    begin with ``mx_``, and any type that can be hashed.
    """
    docs = docs.drop("mix_slot")
    placed, pieces = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, key_cols=docs.columns, **options)
    takes = pieces.groupBy("mx_at", "mx_bucket", "mx_ord", "epoch", "mx_k1", "mx_k2", "size").agg(
        F.min("slot").alias("mix_slot"), F.min("from_word").alias("mx_a"), F.max("to_word").alias("mx_z")
    )
    k1, k2 = hash128(*map(F.col, docs.columns))
    keyed = docs.withColumns({"mx_k1": k1, "mx_k2": k2})
    repeated = materialize(placed.groupBy("mx_k1", "mx_k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated")
    key, told = ["mx_k1", "mx_k2"], ["mix_slot", "mx_a", "mx_z", "size"]
    if repeated.isEmpty():
        taken = keyed.join(takes.select(*key, F.struct(*told).alias("mx_take")), key)
    else:
        once = keyed.join(repeated, key, "left_anti").join(takes.join(repeated, key, "left_anti").select(*key, F.struct(*told).alias("mx_take")), key)
        # One number for each row of a key: of its copies in docs, and of their places in the mix.
        places = _numbered(placed.join(repeated, key, "left_semi").select(*key, "mx_at", "mx_bucket", "mx_ord"), [F.col(c) for c in ("mx_at", "mx_bucket", "mx_ord")])
        parts = takes.join(places, ["mx_at", "mx_bucket", "mx_ord", *key]).select(*key, "mx_no", F.struct(*told).alias("mx_take"))
        copies = _numbered(keyed.join(repeated, key, "left_semi").withColumn("mx_row", F.monotonically_increasing_id()), [F.col("mx_row")]).drop("mx_row")
        taken = once.unionByName(copies.join(parts, [*key, "mx_no"]).drop("mx_no"))
    words = F.regexp_extract_all(text_col, F.lit(f"({WORD})"), F.lit(1))
    whole = (F.col("mx_take.mx_a") == 0) & (F.col("mx_take.mx_z") == F.col("mx_take.size"))
    cut = F.array_join(F.slice(words, (F.col("mx_take.mx_a") + 1).cast("int"), (F.col("mx_take.mx_z") - F.col("mx_take.mx_a")).cast("int")), " ")
    return taken.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(cut)).select(*docs.columns, F.col("mx_take.mix_slot").alias("mix_slot"))
