import json
import random

from pyspark.sql import functions as F

from quern.operators import nested

SCHEMA = "node string, parent string, depth int, title string"


def brute(rows, top, levels):
    def item(node, left):
        kids = sorted((r for r in rows if r[1] == node[0] and r[2] == node[2] + 1), key=lambda r: (r[3], r[0])) if left != 0 else []
        return {"node": node[0], "title": node[3], "children": [item(k, None if left is None else left - 1) for k in kids]}

    return {r[0]: item(r, levels) for r in rows if r[2] == top}


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.node: json.loads(r.json) for r in nested.fold(df, F.struct("node", "title"), [F.col("title")], **options).collect()}


def site(rng, depth=6):
    rows, level = [], [("h", None, 0, "h")]
    for d in range(1, depth + 1):
        rows += level
        level = [(f"{p[0]}/{i}", p[0], d, rng.choice(("b", "a", 'q"uote\\', "ü"))) for p in level for i in range(rng.randint(0, 3) or (d < 3))]
    return rows + level


def test_a_site_of_depth_six_equals_recursion(spark):
    rows = site(random.Random(2))
    assert max(r[2] for r in rows) == 6
    for options in ({"top": 0}, {"top": 1, "levels": 2}, {"top": 3, "levels": 1}, {"top": 6}, {"top": 2, "levels": 0}):
        assert got(spark, rows, **options) == brute(rows, options["top"], options.get("levels"))


def test_children_of_no_node_of_another_depth_and_none_at_all(spark):
    rows = [("a", None, 0, "x"), ("b", "a", 2, "far"), ("c", "gone", 1, "lost"), (None, "a", 1, "null"), ("d", "a", 1, "near")]
    assert got(spark, rows) == {"a": {"node": "a", "title": "x", "children": [{"node": "d", "title": "near", "children": []}]}}
    assert got(spark, []) == {} and got(spark, rows, top=9) == {}
