import math
import random

import pytest
from helpers import SF, connect, same_rows

from quern.llm.queries import ORACLE, QUERIES
from quern.llm.vector_join import near_vectors

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, bar=0.9):
    def norm(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        top = max(abs(x) for x in v)
        v = [x / top for x in v]
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v]

    unit = [norm(v) for _, v in rows]
    near = [
        [j for j, b in enumerate(unit) if i != j and a is not None and b is not None and sum(x * y for x, y in zip(a, b)) >= bar] for i, a in enumerate(unit)
    ]
    out = []
    for i, (own, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        root = min(ids, default=None)
        out.append((own, len(near[i]), root, own == root))
    return sorted(out, key=str)


def got(spark, rows, **options):
    return sorted((tuple(r) for r in near_vectors(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=str)


def clusters(rng, dims, groups, size, loose, alone):
    rows = []
    for _ in range(groups):
        centre = [rng.gauss(0, 1) for _ in range(dims)]
        rows += [[x + rng.gauss(0, loose) for x in centre] for _ in range(size)]
    rows += [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(alone)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("dims,loose,cells", [(3, 0.3, 5), (8, 0.25, 9), (24, 0.35, 1000)])
def test_clusters_equal_all_pairs_whatever_the_cells(spark, dims, loose, cells):
    rows = clusters(random.Random(dims), dims, 6, 25, loose, 60)
    want = brute(rows)
    assert sum(r[1] for r in want) > 50
    assert got(spark, rows, cell_rows=cells, block_rows=7) == want


def test_other_bars(spark):
    rows = clusters(random.Random(1), 5, 5, 12, 0.4, 40)
    assert got(spark, rows, cosine=0.5, cell_rows=11, block_rows=8) == brute(rows, 0.5)


def test_many_near_copies_are_counted(spark):
    rng = random.Random(2)
    rows = [(i, [1.0 + rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)]) for i in range(3000)] + [(9000 + i, [-1.0, i / 10]) for i in range(30)]
    found = dict((r[0], r[1:]) for r in got(spark, rows, cell_rows=500, block_rows=64))
    assert {found[i] for i in range(3000)} == {(2999, 0, False), (2999, 0, True)} and found[9000][1] == 9000


def test_nulls_zeros_repeats_short_vectors_and_an_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0]), (5, [1.0, 0.0]), (4, [2.0]), (7, [0.0, 1.0]), (None, [0.0, 3.0]), (None, [-1.0, 0.0]), (8, None), (9, [0.0, 0.0]), (10, []), (11, [nan, 1.0]),
        (12, [inf, 1.0]), (13, [None, 1.0]), (14, [1e300, 1e300]), (15, [1e-300, 1e-300]), (1, None), (1, [1.0, 1.0]),
    ]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, cell_rows=1, block_rows=1) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(3, None)]) == [(3, 0, 3, True)]
    clash = spark.createDataFrame([(0, [1.0], 5, 6), (1, [1.0], 6, 7)], SCHEMA + ", node int, k1 int")
    assert sorted(tuple(r) for r in near_vectors(clash).collect()) == [(0, 1, 0, True), (1, 1, 0, False)]


def test_a_cosine_at_the_bar_counts_in_double(spark):
    rows = [(0, [1.0, 0.0]), (1, [9.0, math.sqrt(19.0)]), (2, [0.9 - 1e-9, -math.sqrt(1 - 0.9**2)])]
    assert got(spark, rows) == brute(rows)


def test_the_query_equals_sql(spark):
    same_rows(QUERIES["op13_embedding_dedup"](spark, SF), connect().execute(ORACLE["op13_embedding_dedup"]))
