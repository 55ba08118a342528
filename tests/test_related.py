import random

import duckdb

from quern import catalog


def test_related_pages_equal_brute_force(spark, tmp_path):
    """Against the SQL, which scores all pairs of a site: siblings far apart, parents, children, tags, slugs and segments."""
    rng, rows = random.Random(3), []
    for i in range(400):
        path = [rng.choice(["en", "fr", "docs"]), rng.choice("abc"), "-".join(rng.choice(["red", "blue", "big", "old", str(rng.randrange(40))]) for _ in range(rng.randrange(1, 5)))]
        path = path[: rng.randrange(0, 4)] + [rng.choice("abc")] * (rng.random() < 0.2)
        html = "<img >" * rng.choice([0, 5]) + "w " * rng.choice([3, 600])
        rows.append((i, f"http://{rng.choice(['a.com', 'b.com'])}/{'/'.join(path)}", html))
    rows += [(900, "http://c.com/en/---", ""), (901, "http://c.com/fr/---", ""), (902, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.QUERIES["related_pages"](spark, str(tmp_path)).select("host", "route", "place", "related", "score").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT host, route, place, related, score FROM ({catalog.ORACLE['related_pages']})").fetchall()
    assert len(want) > 500
    assert sorted(map(tuple, got)) == sorted(want)
