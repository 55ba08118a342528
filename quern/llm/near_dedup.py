"""Near duplicates: one-permutation MinHash, bands, star-shaped candidates, exact check.

Equal shingle sets become one node first, so copies cost nothing later. A bucket of a
band links its members to one centre (a star), which bounds pairs by members. Where the
stars leave a bucket's members in different components, blocks of the members outside
its largest component are compared with all its blocks, inside tasks of bounded size
that give back links only: every pair that shares a bucket is either checked or already
connected, and no pair of a bucket is emitted unless it is a star's or a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import WORD, hash128, look_up, materialize, passing
from quern.llm.graph import components
from quern.llm.hashing import mix, shingles

BINS = 128
_BIN_SHIFT = np.uint64(57)


def _donors() -> np.ndarray:
    """For each bin the order in which an empty one asks the others: a fixed random
    permutation per bin, the same for all documents (optimal densification)."""
    keys = mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(0xD05E)).reshape(BINS, BINS)
    return np.argsort(keys, axis=1, kind="stable")


_DONORS = _donors()


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """One minimum for each of 128 bins of a single permutation; empty bins borrow."""
    out = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):  # s is sorted: the first hash of a bin is its minimum
        bins = (s >> _BIN_SHIFT).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        out[i, bins[first]] = s[first]
        filled[i, bins[first]] = True
    row, bin_ = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    for t in range(BINS):
        if not len(row):
            break
        donor = _DONORS[bin_, t]
        ok = filled[row, donor]
        out[row[ok], bin_[ok]] = out[row[ok], donor[ok]]
        row, bin_ = row[~ok], bin_[~ok]
    return out


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    n = BINS // rows
    parts = signatures[:, : n * rows].reshape(len(signatures), n, rows)
    factors = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((parts * factors).sum(axis=2, dtype=np.uint64) + mix(np.arange(n, dtype=np.uint64) + np.uint64(77)))


_SIGNED = "nd_n long, nd_s1 long, nd_s2 long, nd_bands array<long>"


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, for tasks that hold several arrays for each text."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _sign(width: int, rows: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = [(t or "").encode() for t in batch.column(text_at).to_pylist()]
            sets = list(shingles(texts, width))
            bands = band_hashes(signature(sets), rows).view(np.int64)
            s1 = np.array([mix(s ^ np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64)
            s2 = np.array([mix(s ^ np.uint64(2)).sum(dtype=np.uint64) for s in sets], np.uint64)
            offsets = np.arange(len(sets) + 1, dtype=np.int32) * bands.shape[1]
            keep = [c for i, c in enumerate(batch.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays(
                [
                    *keep,
                    pa.array(np.array([len(s) for s in sets], np.int64)),
                    pa.array(mix(s1).view(np.int64)),
                    pa.array(s2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1))),
                ],
                names=[*(n for i, n in enumerate(batch.schema.names) if i != text_at), "nd_n", "nd_s1", "nd_s2", "nd_bands"],
            )

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            u, v = batch.column(0), batch.column(1)
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            index: dict[str, int] = {}
            for t in left + right:
                index.setdefault(t, len(index))
            sets = list(shingles([t.encode() for t in index], width))
            linked = []
            for a, b in zip(left, right, strict=True):
                x, y = sets[index[a]], sets[index[b]]
                same = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(linked))

    return run


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each of ``left`` the sizes of its intersections with all of ``right``, none empty."""
    ends = np.cumsum([len(s) for s in right])
    known, at = np.unique(np.concatenate(right), return_inverse=True)
    starts = np.concatenate([[0], ends[:-1]])
    mark = np.zeros(len(known), np.int32)
    for s in left:
        place = np.minimum(np.searchsorted(known, s), len(known) - 1)
        held = place[known[place] == s]
        mark[held] = 1
        yield np.add.reduceat(mark[at], starts)
        mark[held] = 0


def _compare(width: int, percent: int):
    """Groups hold whole pairs of blocks (b, i, j); out come links between different roots,
    one for each two roots of a pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table[c].to_numpy() for c in ("own", "j", "i", "b")])
        b, i, j, own, root = (table[c].to_numpy()[order] for c in ("b", "i", "j", "own", "root"))
        texts = [t.encode() for t in table["text"].take(pa.array(order)).to_pylist()]
        index: dict[bytes, int] = {}
        where = np.array([index.setdefault(t, len(index)) for t in texts], np.int64)
        sets = list(shingles(list(index), width))
        new = (np.diff(b, prepend=b[:1]) != 0) | (np.diff(i, prepend=i[:1]) != 0) | (np.diff(j, prepend=j[:1]) != 0)
        found = [np.empty((0, 2), np.int64)]
        for at in np.split(np.arange(len(b)), np.flatnonzero(new)):
            left, right = at[own[at] == i[at]], at[own[at] == j[at]]
            if not len(left) or not len(right) or len(np.unique(root[at])) < 2:
                continue
            others = [sets[where[k]] for k in right]
            sizes = np.array([len(s) for s in others])
            for k, same in zip(left, _intersections([sets[where[k]] for k in left], others), strict=True):
                union = len(sets[where[k]]) + sizes - same
                linked = root[right][(100 * same >= percent * union) & (root[right] != root[k])]
                if len(linked):
                    linked = np.unique(linked)
                    found.append(np.stack([np.maximum(linked, root[k]), np.minimum(linked, root[k])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    width: int = 5,
    percent: int = 75,
    rows: int = 4,
    block: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(``id_col``, n_shingles long, component_id, kept boolean), a row for each row of ``docs``.

    Rows are linked where 100 * intersection >= ``percent`` * union of their distinct
    ``width``-word shingles (A-Z lowered; fewer words: the whole sequence as one), and
    component_id is the smallest id reachable. Candidates share one of 32 bands of 4
    bins: a pair at 0.75 is missed with a chance of 5e-6; every candidate is confirmed
    on full sets. ``block`` is about how many shingles a block holds.

    Null, empty or blank texts have no shingles and are linked with nothing. Repeated ids
    are rows of their own that share component and ``kept``. A row with a null id gets
    the smallest id of its component, null if there is none, and is never ``kept``
    unless it is alone. A very long text is one set of one task. An empty table gives an
    empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    with passing(spark) as kept:
        signed, by_node = _labelled(docs, width, percent, rows, block, id_col, text_col)
        kept += [signed, by_node]
    id_type = signed.schema["nd_id"].dataType
    found = look_up(signed, by_node, ["nd_s1", "nd_s2"], "copies", F.xxhash64("nd_id", "nd_t1"))
    component = F.when(F.col("nd_n") > 0, F.col("component_id")).otherwise(F.col("nd_id")).cast(id_type)
    return found.withColumn("component_id", component).select(
        F.col("nd_id").alias(id_col),
        F.col("nd_n").alias("n_shingles"),
        "component_id",
        F.col("nd_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one row of each group of near copies
    (as :func:`near_duplicates` links them) stays: the one with the smallest id, then the
    smallest hash of its text.

    Exactly one row of a group stays, also where ids repeat, with equal or other texts, or
    are null (null comes last); of rows equal in id and text any one. Rows without words
    are copies of nothing and all stay. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    with passing(spark) as kept:
        every = {"width": 5, "percent": 75, "rows": 4, "block": 1 << 16} | options
        signed, by_node = _labelled(docs, *every.values(), id_col, text_col)
        found = look_up(signed.filter("nd_n > 0"), by_node, ["nd_s1", "nd_s2"], "copies", F.xxhash64("nd_id", "nd_t1"))
        key = ["nd_id", "nd_t1", "nd_t2"]
        counted = found.groupBy("root", *key).agg(F.count(F.lit(1)).alias("rows"))
        first = counted.groupBy("root").agg(F.min(F.struct(F.isnull("nd_id").alias("last"), *key, "rows")).alias("r"))
        k1, k2 = hash128(F.col("r.nd_id"), F.col("r.nd_t1"), F.col("r.nd_t2"))
        chosen = materialize(first.select(k1.alias("nd_k1"), k2.alias("nd_k2"), F.col("r.rows").alias("rows"), F.col("r.rows").alias("copies")), "chosen")
        kept.append(chosen)
    t1, t2 = hash128(F.col(text_col))
    k1, k2 = hash128(F.col(id_col), t1, t2)
    keyed = docs.select(F.struct(*docs.columns).alias("rec"), k1.alias("nd_k1"), k2.alias("nd_k2"), F.coalesce(F.col(text_col).rlike(WORD), F.lit(False)).alias("words"))
    looked = look_up(keyed, chosen, ["nd_k1", "nd_k2"], "rows", F.col("nd_k1") + F.monotonically_increasing_id())
    alone = looked.filter("not words or copies = 1").select("rec.*")
    again = keyed.join(chosen.filter("copies > 1"), ["nd_k1", "nd_k2"]).groupBy("nd_k1", "nd_k2").agg(F.first("rec").alias("rec")).select("rec.*")
    return alone.unionByName(again)


def _labelled(docs: DataFrame, width: int, percent: int, rows: int, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Two written tables: signed (nd_id, nd_t1, nd_t2, nd_n, nd_s1, nd_s2, bands), a row for each
    row of ``docs``; and by set (nd_s1, nd_s2, copies, root, component_id)."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("nd_id"), F.col(text_col).alias("nd_text"))
    t1, t2 = hash128(F.col("nd_text"))
    plain = named.select("nd_id", t1.alias("nd_t1"), t2.alias("nd_t2"), "nd_text")
    schema = T.StructType([*plain.schema.fields[:3], *T._parse_datatype_string(_SIGNED).fields])
    signed = materialize(plain.mapInArrow(_sign(width, rows, 3), schema), "signed")

    # Nodes: distinct shingle sets, by 128 bits, with one text each; numbers that are
    # given once, as the table is written, name them from here on.
    nodes = (
        signed.filter("nd_n > 0")
        .groupBy("nd_s1", "nd_s2")
        .agg(
            F.min(F.struct("nd_t1", "nd_t2", "nd_bands")).alias("r"), F.first("nd_n").alias("n"),
            F.count(F.lit(1)).alias("copies"), F.min("nd_id").alias("least"),
        )
        .select(F.monotonically_increasing_id().alias("node"), "nd_s1", "nd_s2", "r.*", "n", "copies", "least")
    )
    nodes = materialize(nodes, "nodes")
    members = nodes.select("node", "n", F.explode("nd_bands").alias("b"))
    shared = members.groupBy("b").agg(F.min("node").alias("c"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialize(members.join(shared, "b").select("b", "node", "n", "c"), "members")

    # Texts of nodes that share a bucket at all: what every later round reads.
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "nd_t1", "nd_t2")
    texts = (
        named.select(t1.alias("nd_t1"), t2.alias("nd_t2"), "nd_text")
        .join(wanted, ["nd_t1", "nd_t2"])
        .groupBy("node")
        .agg(F.min("nd_text").alias("text"))
    )
    texts = materialize(texts, "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """pairs: distinct (u, v) whose sizes allow a link."""
        both = (
            pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
            .join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
            .select("u", "v", "a", "b")
        )
        return both.mapInArrow(_confirm(width, percent), "u long, v long")

    sizes = nodes.select(F.col("node").alias("c"), F.col("n").alias("cn"))
    first = (
        members.filter("node != c")
        .select(F.col("c"), "node", "n")
        .distinct()
        .join(sizes, "c")
        .filter(f"100 * least(n, cn) >= {percent} * greatest(n, cn)")
        .select(F.col("c").alias("u"), F.col("node").alias("v"))
    )
    links = materialize(confirmed(materialize(first, "pairs")), "links")
    roots = materialize(components(links), "roots")

    # Buckets whose members the stars left apart: blocks of those outside the largest
    # component meet each other and the blocks inside it.
    labelled = members.drop("c").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = labelled.groupBy("b", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    split = (
        per.groupBy("b")
        .agg(F.max_by(F.struct("root", "w"), F.struct("k", "root")).alias("most"), F.count(F.lit(1)).alias("roots"), F.sum("w").alias("w"))
        .filter("roots > 1")
        .select(
            "b",
            F.col("most.root").alias("most"),
            F.ceil((F.col("w") - F.col("most.w")) / F.lit(float(block))).alias("outs"),
            F.ceil(F.col("most.w") / F.lit(float(block))).alias("ins"),
        )
    )
    spread = F.xxhash64("node")
    own = F.when(F.col("root") == F.col("most"), F.col("outs") + F.pmod(spread, F.col("ins"))).otherwise(F.pmod(spread, F.col("outs")))
    meets = F.sequence(F.lit(0).cast("long"), F.when(F.col("own") < F.col("outs"), F.col("outs") + F.col("ins")).otherwise(F.col("outs")) - 1)
    placed = materialize(
        labelled.join(split, "b")
        .withColumn("own", own)
        .withColumn("other", F.explode(meets))
        .select("b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "n"),
        "placed",
    )
    weight = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if weight:
        tasks = max(1, -(-weight // (2 * block)))
        more = (
            placed.withColumn("g", F.pmod(F.xxhash64("b", "i", "j"), F.lit(tasks)))
            .join(texts, "node")
            .select("g", "b", "i", "j", "own", "root", "text")
            .groupBy("g")
            .applyInArrow(_compare(width, percent), "u long, v long")
        )
        more = materialize(more.distinct(), "links")
        joined = components(more).select(F.col("node").alias("root"), F.col("root").alias("merged"))
        roots = roots.unionByName(more.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")).join(roots, "node", "left_anti"))
        roots = roots.join(joined, "root", "left").select("node", F.coalesce("merged", "root").alias("root"))
        roots = materialize(roots, "roots")

    rooted = nodes.select("node", "nd_s1", "nd_s2", "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")), "smallest")
    by_node = look_up(rooted, smallest, ["root"], "size", F.col("node")).select("nd_s1", "nd_s2", "copies", "root", "component_id")
    return signed, materialize(by_node, "by_node")
