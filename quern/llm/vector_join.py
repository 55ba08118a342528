"""Near duplicates among vectors: an exact range join by angle, over cells around pivots.

Equal vectors become one node first. Angles are a metric, so the triangle inequality says
what has to be compared: every node lives in the cell of its nearest pivot and is copied to
those cells whose members it can be linked with. Inside a cell, nodes fall into rings by
their distance to the pivot; rings that are far enough apart are not compared, and nodes
so near the pivot that all must be linked are only counted. What is left is compared in
blocks of bounded size, each pair of blocks by itself, as one product of matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import hash128, look_up, materialize, passing
from quern.llm.graph import components

#: Angles are compared with this much to spare; cosines near 1 tell angles to about 1e-8.
SPARE = 1e-6
#: Rows of a block that are multiplied at once.
STRIP = 1_024


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, all components finite, one not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(column: pa.Array, dims: int = 0) -> np.ndarray:
    """Vectors of length one, as rows; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    first = column.offsets[0].as_py() if len(column) else 0
    out = np.zeros((len(column), max(dims, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values[first : first + int(lengths.sum())]
    out /= np.abs(out).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _angles(column: pa.Array, pivots: np.ndarray) -> np.ndarray:
    rows = directions(column, pivots.shape[1])
    return np.arccos(np.clip(rows[:, : pivots.shape[1]] @ pivots.T, -1, 1))


def _homes(pivots: np.ndarray):
    """(node, copies, vec) to (home, dist, node, copies, vec): the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(batch.column(2), pivots)
                home = angles.argmin(axis=1)
                dist = angles[np.arange(len(home)), home]
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(dist), *batch.columns], names=["home", "dist", "node", "copies", "vec"])

    return run


def _placed(pivots: np.ndarray, radii: np.ndarray, theta: float):
    """A row for the home of a node, and one for each cell before it in number that may hold
    a node within ``theta``: no farther from that pivot than its own pivot by two thetas,
    nor than the cell reaches by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            home, dist = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            angles = _angles(batch.column(4), pivots)
            near = angles <= np.minimum(dist[:, None] + 2 * theta, radii[None, :] + theta) + SPARE
            near &= np.arange(len(pivots)) < home[:, None]
            near[np.arange(len(home)), home] = True
            row, cell = np.nonzero(near)
            at = angles[row, cell]
            inner, width = theta / 2 - SPARE, theta / 2 + SPARE
            ring = np.where(at <= inner, 0, 1 + np.floor((at - inner) / width)).astype(np.int32)
            kept = batch.select(["node", "copies", "vec"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(cell == home[row]), pa.array(ring), *kept.columns], names=["cell", "own", "ring", "node", "copies", "vec"]
            )

    return run


def linked(left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``left`` and ``right`` have that cosine or more. Single precision
    settles all but those within its error, which are multiplied again in double."""
    spare = left.shape[1] * 1.2e-7 + 1e-6
    small, other = left.astype(np.float32), right.astype(np.float32).T.copy()
    out = np.empty((len(left), len(right)), bool)
    for at in range(0, len(left), STRIP):
        product = small[at : at + STRIP] @ other
        out[at : at + STRIP] = product >= cosine + spare
        i, j = np.nonzero((product >= cosine - spare) & (product < cosine + spare))
        for k in range(0, len(i), STRIP * 16):
            a, b = i[k : k + STRIP * 16], j[k : k + STRIP * 16]
            out[at + a, b] = np.einsum("ij,ij->i", left[at + a], right[b]) >= cosine
    return out


def _roots(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node that each row and column of ``links`` reaches; all have a link."""
    by_row, by_column = np.full(len(rows), -1, np.int64), np.full(len(columns), -1, np.int64)
    for start in range(len(rows)):
        if by_row[start] >= 0:
            continue
        seen_rows, seen_columns, front = [start], [], np.array([start])
        by_row[start] = 0
        while len(front):
            across = np.flatnonzero(links[front].any(axis=0) & (by_column < 0))
            by_column[across] = 0
            front = np.flatnonzero(links[:, across].any(axis=1) & (by_row < 0))
            by_row[front] = 0
            seen_columns += across.tolist()
            seen_rows += front.tolist()
        root = min(rows[seen_rows].min(), columns[seen_columns].min())
        by_row[seen_rows], by_column[seen_columns] = root, root
    return by_row, by_column


def _compare(cosine: float):
    """A pair of blocks, sides 0 and 1, or one block with itself, all side 0: for each node
    with a link how many rows it is linked with here and the smallest node it reaches here."""

    def run(table: pa.Table) -> pa.Table:
        side, node, copies = (table[c].to_numpy() for c in ("side", "node", "copies"))
        rows = directions(table["vec"])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not table["two"][0].as_py()
        if alone:
            right = left
        links = linked(rows[left], rows[right], cosine)
        if alone:
            np.fill_diagonal(links, False)
        some, across = links.any(axis=1), links.any(axis=0)
        left, right, links = left[some], right[across], links[some][:, across]
        out = [(node[left], links @ copies[right])]
        if not alone:
            out.append((node[right], copies[left] @ links))
        else:
            np.fill_diagonal(links, True)  # a node is itself on both sides
        roots = _roots(links, node[left], node[right])
        return pa.table({
            "node": np.concatenate([o[0] for o in out]).astype(np.int64), "links": np.concatenate([o[1] for o in out]).astype(np.int64),
            "root": np.concatenate(roots[: len(out)]).astype(np.int64),
        })

    return run


def near_vectors(
    vectors: DataFrame,
    *,
    cosine: float = 0.9,
    cell_rows: int = 8_192,
    max_pivots: int = 1_024,
    block_rows: int = 8_192,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(``id_col``, n_links long, component_id, kept boolean), a row for each row of ``vectors``.

    Rows are linked where the cosine of their vectors, in double precision, is ``cosine``
    or more (which must be over 0); component_id is the smallest id reachable by links.
    No candidate is left out: there is a pivot for each ``cell_rows`` distinct vectors,
    ``max_pivots`` at most (the driver and each task hold those, and only those), and
    cells of any size are compared in blocks of about ``block_rows``. Vectors that lie in
    all directions evenly are farther apart than any of this can tell, and cost the square
    of their number, in blocks; groups of near copies are counted without comparing them.

    Vectors that are null, empty or zero, or hold null, NaN or infinity, are linked with
    nothing; shorter vectors end in zeros. Equal vectors are linked. Repeated ids are rows
    of their own that share component and ``kept``. A row with a null id gets the smallest
    id of its component, null if there is none, and is ``kept`` only if that is null. An
    empty table gives an empty table. Other columns are ignored.
    """
    theta = math.acos(cosine)
    k1, k2 = hash128(F.col("vj_vec"))
    named = vectors.select(F.col(id_col).alias("vj_id"), F.col(vector_col).alias("vj_vec"))
    id_type = named.schema["vj_id"].dataType
    told = F.when(usable(F.col("vj_vec")), F.struct(k1.alias("a"), k2.alias("b")))
    keyed = named.withColumn("k", told).select("vj_id", F.col("k.a").alias("k1"), F.col("k.b").alias("k2"), "vj_vec")
    with passing(vectors.sparkSession) as kept:
        by_vector = _classes(keyed, theta, cosine, cell_rows, max_pivots, block_rows)
        kept.append(by_vector)
    found = look_up(keyed.drop("vj_vec"), by_vector, ["k1", "k2"], "copies", F.xxhash64("vj_id"))
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vj_id")).cast(id_type)
    return found.withColumn("component_id", component).select(
        F.col("vj_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.col("vj_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _classes(keyed: DataFrame, theta: float, cosine: float, cell_rows: int, max_pivots: int, block_rows: int) -> DataFrame:
    """(k1, k2, copies, n_links, component_id), written, for each distinct usable vector."""
    nodes = (
        keyed.filter("k1 is not null")
        .groupBy("k1", "k2")
        .agg(F.first("vj_vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("vj_id").alias("least"))
        .select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "copies", "least", "vec")
    )
    nodes = materialize(nodes, "nodes")
    n, dims = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    count = min(max_pivots, max(1, -(-n // cell_rows)))
    first = [r[0] for r in nodes.orderBy("k1", "k2").limit(count).select("vec").collect()]  # max_pivots at most
    pivots = directions(pa.array(first, pa.list_(pa.float64())), dims) if first else np.zeros((1, dims))

    vec = T.StructField("vec", nodes.schema["vec"].dataType)
    node = [T.StructField("node", T.LongType()), T.StructField("copies", T.LongType()), vec]
    schema = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("dist", T.DoubleType()), *node])
    homes = materialize(nodes.select("node", "copies", "vec").mapInArrow(_homes(pivots), schema), "homes")
    radii = np.full(len(pivots), -math.inf)
    for home, dist in homes.groupBy("home").agg(F.max("dist")).collect():  # a row a pivot
        radii[home] = dist
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("own", T.BooleanType()), T.StructField("ring", T.IntegerType()), *node])
    placed = materialize(homes.mapInArrow(_placed(pivots, radii, theta), schema), "placed")

    # Rings: at most two for each pivot and half theta, so these tables are bounded.
    rings = placed.groupBy("cell", "own", "ring").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("w"), F.min("node").alias("hub"))
    rings = materialize(rings.withColumn("chunks", F.ceil(F.col("n") / F.lit(float(block_rows))).cast("int")), "rings")
    pairs = _pairs(placed, rings).groupBy("cell", "r", "c", "own2", "s", "c2").applyInArrow(_compare(cosine), "node long, links long, root long")

    # Nodes within half theta of a pivot are all linked: they are counted, and hang on one.
    heart = rings.filter("ring = 0").groupBy("cell").agg(
        F.sum(F.when(F.col("own"), F.col("w")).otherwise(0)).alias("w_own"), F.sum(F.when(F.col("own"), 0).otherwise(F.col("w"))).alias("w_far"),
        F.min(F.when(F.col("own"), F.col("hub"))).alias("hub"),
    ).filter("w_own > 0")
    links = F.when(F.col("own"), F.col("w_own") - F.col("copies") + F.col("w_far")).otherwise(F.col("w_own"))
    inner = placed.filter("ring = 0").join(F.broadcast(heart), "cell").select("node", links.alias("links"), F.col("hub").alias("root"))
    told = materialize(pairs.unionByName(inner), "links")

    roots = components(told.select(F.col("node").alias("u"), F.col("root").alias("v")))
    totals = told.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = (
        nodes.drop("vec").join(totals, "node", "left").join(roots.distinct(), "node", "left")
        .withColumn("root", F.coalesce("root", "node")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    )
    rooted = materialize(rooted.select("node", "k1", "k2", "copies", "least", "root", "n_links"), "rooted")
    smallest = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")), "smallest")
    out = look_up(rooted, smallest, ["root"], "size", F.col("node"))
    return materialize(out.select("k1", "k2", "copies", "n_links", "component_id"), "by_vector")


def _pairs(placed: DataFrame, rings: DataFrame) -> DataFrame:
    """Rows of ``placed`` once for each pair of blocks that they are compared in: the first
    block (r, c) is of the cell's own nodes, the second (own2, s, c2) of own or copied ones.
    A ring is a part of a cell, a chunk a part of a ring; rings three apart need no comparison."""
    here = rings.select("cell", "own", "ring", "chunks")
    other = rings.select(F.col("cell").alias("cell2"), F.col("own").alias("own2"), F.col("ring").alias("ring2"), F.col("chunks").alias("chunks2"))
    meets = here.join(
        other,
        (F.col("cell") == F.col("cell2")) & (F.abs(F.col("ring") - F.col("ring2")) <= 2) & (F.col("own") | F.col("own2")) & (F.greatest("ring", "ring2") > 0),
    )
    meets = meets.groupBy("cell", "own", "ring", "chunks").agg(F.collect_list(F.struct("own2", "ring2", "chunks2")).alias("others"))
    meets = meets.withColumnsRenamed({"cell": "m_cell", "own": "m_own", "ring": "m_ring"})
    on = (F.col("cell") == F.col("m_cell")) & (F.col("own") == F.col("m_own")) & (F.col("ring") == F.col("m_ring"))
    mine, theirs = F.struct("ring", "chunk"), F.struct(F.col("o.ring2").alias("ring"), F.col("chunk2").alias("chunk"))
    both = F.col("own") & F.col("o.own2")
    leads = F.when(both, mine <= theirs).otherwise(F.col("own"))
    a, b = F.when(leads, mine).otherwise(theirs), F.when(leads, theirs).otherwise(mine)
    return (
        placed.join(F.broadcast(meets), on)
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("o", F.explode("others"))
        .withColumn("chunk2", F.explode(F.sequence(F.lit(0), F.col("o.chunks2") - 1)))
        .select(
            "cell", a["ring"].alias("r"), a["chunk"].alias("c"), both.alias("own2"), b["ring"].alias("s"), b["chunk"].alias("c2"),
            F.when(leads, 0).otherwise(1).alias("side"), (~both | (mine != theirs)).alias("two"), "node", "copies", "vec",
        )
    )

