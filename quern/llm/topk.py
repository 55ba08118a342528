"""Exact top-k by inner product: term-at-a-time accumulation over blocks.

Candidates fall into blocks of bounded size. For a block, every dimension has a postings
list; a query row scatters its non-zero weights times the postings into a dense array of
scores, one term after another. Each block gives its k best by partition selection, and
a last step merges the blocks of a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialize

#: Sums that may reach this are accumulated in whole numbers of any length.
LIMIT = (1 << 63) - 1
#: Added to such a sum, so that its bytes sort as the number does; no sum of doubles is longer.
_OFFSET = 1 << 2200


def quantize(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) for every component, as doubles, which hold it exactly for a power of
    two; null where the vector or a component is null or not finite."""
    usable = vector.isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf"))
    )
    # floor() would return a long; x minus what is left behind the point is the same and exact.
    return F.when(usable, F.transform(vector, lambda x: _floor(x.cast("double") * scale)))


def _floor(x: Column) -> Column:
    left = x % 1.0
    return x - left - F.when(left < 0, 1.0).otherwise(0.0)


def _dense(rows: pd.Series) -> np.ndarray:
    """A row of weights for each vector; short vectors end in zeros."""
    lengths = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    out = np.zeros((len(rows), int(lengths.max(initial=0))))
    for n in np.unique(lengths):
        if n:
            at = np.flatnonzero(lengths == n)
            out[at, :n] = np.stack([rows.iloc[i] for i in at])
    return out


def _postings(weights: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each dimension the rows it occurs in and their weights; a list that holds over
    half of the rows is kept dense."""
    out = []
    for d in range(weights.shape[1]):
        column = weights[:, d]
        rows = np.flatnonzero(column)
        out.append((slice(None), column.copy()) if 2 * len(rows) > len(column) else (rows, column[rows]))
    return out


def accumulate(query: np.ndarray, postings: list, scores: np.ndarray) -> None:
    """Scores of one sparse query row against a block, term at a time, into ``scores``."""
    scores[:] = 0  # int64, or object: whole numbers of any length
    for d in np.flatnonzero(query[: len(postings)]):
        rows, weights = postings[d]
        scores[rows] += query[d] * weights


def select_top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, ties to the smaller id, in order."""
    at = np.arange(len(scores))
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > bar)
        ties = np.flatnonzero(scores == bar)
        rest = k - len(above)
        if len(ties) > rest:
            ties = ties[np.argpartition(ids[ties], rest - 1)[:rest]]
        at = np.concatenate([above, ties])
    return at[np.lexsort((ids[at], -scores[at]))]


def _exact(weights: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in weights], object).reshape(weights.shape)


def _block(k: int):
    """The k best candidates of a block for each query. A score beyond 64 bits is cut to them,
    and ``over`` keeps its true value in bytes that sort alike."""

    def run(_key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        ids, rows = candidates["tk_id"].to_numpy(), candidates["tk_row"].to_numpy()
        weights, asked = _dense(candidates["tk_w"]), _dense(queries["tk_w"])
        largest = [float(np.abs(w).max(initial=0)) for w in (weights, asked)]
        fits = largest[0] * largest[1] * max(1, min(weights.shape[1], asked.shape[1])) < LIMIT / 2 and max(largest) < LIMIT / 2
        weights, asked = (w.astype(np.int64) if fits else _exact(w) for w in (weights, asked))
        postings = _postings(weights)
        scores = np.zeros(len(ids), np.int64 if fits else object)
        out = []
        for query_id, row_id, query in zip(queries["tk_id"].to_numpy(), queries["tk_row"].to_numpy(), asked, strict=True):
            accumulate(query, postings, scores)
            others = np.flatnonzero(rows != row_id)
            best = others[select_top(scores[others], ids[others], k)]
            for i in best:
                score = int(scores[i])
                over = None if fits or abs(score) < LIMIT else (score + _OFFSET).to_bytes(280)
                out.append((query_id, row_id, ids[i], max(-LIMIT, min(LIMIT, score)), over))
        return pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "score", "over"])

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    scale: int = 256,
    block_rows: int = 16_384,
    query_rows: int = 2_048,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): each query's k best other rows.

    Queries are the rows for which ``is_query`` holds; candidates are all rows but the
    query's own. Each query block meets each candidate block once; both have a bounded
    number of rows, so a task's memory does not grow with the table.

    Vectors that are null or hold nulls, NaN or infinity, and rows with a null id, take no
    part. Vectors of different lengths meet on their common dimensions. Empty vectors
    score 0. Ties go to the smaller id, and rows with equal ids and scores each hold a rank.
    Weights are not clipped: blocks whose sums might pass 64 bits are added up in numbers of
    any length and ranked by those; only the ``score`` they return is cut to 64 bits. Queries
    without another row get no rows; an empty table gives an empty table. Other columns
    are ignored.
    """
    rows = materialize(vectors.select(
        F.col(id_col).cast("long").alias("tk_id"), quantize(F.col(vector_col), scale).alias("tk_w"),
        F.monotonically_increasing_id().alias("tk_row"), is_query.alias("tk_q"),
    ).filter("tk_id is not null and tk_w is not null"), "vectors")
    n, q = rows.agg(F.count(F.lit(1)), F.count_if("tk_q")).first()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-q // query_rows))

    def spread(count: int) -> Column:
        return F.pmod(F.xxhash64("tk_row"), F.lit(count)).cast("int")

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    candidates = rows.select("tk_id", "tk_row", "tk_w", spread(blocks).alias("cb"), each(query_blocks).alias("qb"))
    queries = rows.filter("tk_q").select("tk_id", "tk_row", "tk_w", spread(query_blocks).alias("qb"), each(blocks).alias("cb"))
    partial = (
        candidates.groupBy("cb", "qb")
        .cogroup(queries.groupBy("cb", "qb"))
        .applyInPandas(_block(k), "query_id long, query_row long, vec_id long, score long, over binary")
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc_nulls_last("over"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
