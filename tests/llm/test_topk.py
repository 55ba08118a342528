import math
import random

from helpers import SF, connect, same_rows
from pyspark.sql import functions as F

from quern.llm.queries import ORACLE, QUERIES
from quern.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k):
    ok = [(i, r, [math.floor(256 * x) for x in v]) for r, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, qr, q in ok:
        if qi % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, cr, c in ok if cr != qr)[:k]
            out += [(qi, n + 1, ci, max(-(2**63) + 1, min(2**63 - 1, -s))) for n, (s, ci) in enumerate(scored)]
    return sorted(out)


def got(spark, rows, k=3, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, k=k, **options).collect())


def test_random_vectors_in_small_blocks_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(0, 400, 5)]
    assert got(spark, rows, block_rows=17, query_rows=2) == brute(rows, 3)


def test_nothing_is_clipped(spark):
    large = [(0, [3e5, 4e5]), (1, [3e5, 4e5]), (2, [5e5, 5e5]), (3, [-5e5, 1.0])]
    assert [r[2] for r in got(spark, large)] == [2, 1, 3] and got(spark, large) == brute(large, 3)
    huge = [(0, [1e30, 2.0]), (1, [1e30, 1.0]), (2, [3e30, 0.0]), (3, [2e30, 0.0]), (4, [-1e30, 0.0]), (50, [-2e200, 1.0]), (51, [1.0, 1.0])]
    for options in ({}, {"block_rows": 2}):
        assert got(spark, huge, **options) == brute(huge, 3)
        assert [r[2] for r in got(spark, huge, **options) if r[0] == 0] == [2, 3, 1]


def test_nulls_ties_repeats_short_vectors_and_an_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 1.0]), (0, [1.0, 1.0]), (7, [1.0, 1.0]), (6, [1.0, 1.0]), (5, [2.0]), (50, []), (8, None), (9, [None, 1.0]), (10, [nan, 1.0]), (11, [inf, 0.0]),
        (None, [9.0, 9.0]), (100, [-0.001, 0.003]),
    ]
    assert got(spark, rows) == brute(rows, 3)
    assert got(spark, []) == []
    assert got(spark, [(50, [1.0])]) == []
    clash = spark.createDataFrame([(0, [1.0], 5), (1, [1.0], 6)], SCHEMA + ", tk_id int")
    assert [tuple(r) for r in top_k(clash, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 65536)]


def test_the_query_equals_sql(spark):
    same_rows(QUERIES["op10_topk"](spark, SF), connect().execute(ORACLE["op10_topk"]))
