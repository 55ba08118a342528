import duckdb
from pyspark.sql import functions as F

from quern import catalog
from quern.operators import graph, rules


def pages(spark, path, urls, html=""):
    rows = [(i, u, html) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_ancestors_of_a_chain_of_twelve(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, 13)], "node string, parent string")
    got = {r.node: r.trail for r in graph.ancestors(chain).collect()}
    assert got == {f"n{i}": [f"n{j}" for j in range(i - 1, 0, -1)] for i in range(1, 13)}
    assert graph.ancestors(chain.limit(0)).collect() == []


def test_sections_of_every_name_are_counted(spark, tmp_path):
    at = pages(spark, tmp_path, ["http://a.com/de/1", "http://a.com/de/2", "http://a.com/es/x/y", "http://a.com/top"])
    assert dict(catalog.QUERIES["section_child_counts"](spark, at).collect()) == {"a.com/de": 2, "a.com/es": 1, "a.com/es/x": 1}


def test_orphans(spark, tmp_path):
    at = pages(
        spark, tmp_path,
        ["http://a.com/", "http://a.com/en/", "http://a.com/en/1", "http://a.com/de/2", "http://a.com/fr/3/", "http://a.com/x/[...all]", "http://a.com/x/y/z", "http://b.com/en/1"],
        '<a href="/fr/3?q=1">three</a>',
    )
    assert {r.page for r in catalog.QUERIES["orphan_pages"](spark, at).collect()} == {"a.com/de/2", "a.com/fr/3", "a.com/x/[...all]", "a.com/x/y/z", "b.com/en/1"}
    got = {r.host + r.route for r in catalog.QUERIES["orphan_routes"](spark, at).collect()}
    assert got == {"a.com/de/2", "b.com/en/1"}  # a catch-all covers itself too


def test_a_score_does_not_follow_the_order_of_values(spark, tmp_path):
    """Their mean is 16.05: halves go up."""
    values = [20.65, 20.48, 0.71, 13.33, 25.08], [25.08, 20.48, 13.33, 20.65, 0.71]
    for i, v in enumerate(values):
        spark.createDataFrame([(1, "view", x) for x in v], "user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/{i}/events.parquet")
        assert [tuple(r) for r in catalog.QUERIES["certification_score"](spark, f"{tmp_path}/{i}").collect()] == [(1, 16.1)]


def test_scores_of_odd_values_equal_sql(spark, tmp_path):
    """Values that are missing, no numbers, infinite or larger than a long."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "view", nan), (1, "click", 1.0), (2, "view", inf), (3, "view", -inf), (3, "click", inf), (4, "view", 1e300), (5, "view", -9.3e18), (6, "view", None), (7, "view", None), (7, "click", 3.0),
        (None, "view", 2.0), (8, "error", 2.0), (9, None, 2.0), (10, "view", -0.05), (11, "view", 1e17), (12, "view", 4.9e15), (13, "signup", 20.05), (14, "view", -inf),
    ]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = [(r.user_id, r.score) for r in catalog.QUERIES["certification_score"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, con.execute(catalog.ORACLE["certification_score"]).fetchall()))


def test_words_of_titles_end_as_in_sql(spark, tmp_path):
    """An accented letter ends a word, a line feed does not end a text, the long s is an s."""
    titles = ["éour mission", "our mission", "sour mission", "faqé", "why?\n", "ſtories of muſings"]
    spark.createDataFrame([(i * 5 + 3, "http://a.com/x", f"<title>{t}</title>") for i, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = [(r[0], r[1], r[2], r[3]) for r in con.execute(catalog.ORACLE["content_types"]).fetchall()]
    got = [(r.page_id, r.kind, r.confidence, r.others) for r in catalog.QUERIES["content_types"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    score = lambda t: rules.content_scores(*map(F.lit, ("/x", t, "", 1, 0, 1, "article")))["BLOG"]
    found = spark.range(1).select(*(score(t).alias(str(i)) for i, t in enumerate(("éour way", "sour way", "muſings", "none")))).first()
    assert [round(x - found[3], 6) for x in found] == [0.25, 0.0, 0.25, 0.0]


def test_site_statistics_equal_sql_with_accents(spark, tmp_path):
    titles = ["égallery", "éreport", "édocumentation", "étutorial", "éfaq"]
    spark.createDataFrame([(i * 5 + 3, "http://a.com/x", f"<title>{t}</title>") for i, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = {(r.histogram, r.value, r.pages) for r in catalog.QUERIES["site_graph_stats"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute("SELECT histogram, value, pages FROM (" + catalog.ORACLE["site_graph_stats"] + ")").fetchall())
    assert ("type", "GALLERY", 1) in got


def test_site_statistics_equal_sql_on_odd_pages(spark, tmp_path):
    """Pages without URL or HTML, images in capitals, with line feeds or never closed, descriptions of other forms."""
    html = [
        "<IMG src=x><img\nsrc=y><img\tz>", '<img src="a<img src=b>', "<imgx><img >" + "<img >" * 9, "<img/>x", "", None, " a\n\tb ", "word " * 1200 + "<table>",
        "\u00a0 <p>\u3000 x\u00a0 y", "\n\u2003\n\u00a0x", "<meta content='our mission is told here' name='description'><title>x", '<META NAME="description" CONTENT="how to get a portfolio of our work">',
    ]
    urls = ["http://a.com/en/5", None, "", "no url", "\u00a0http://a.com/en/7\u3000"]
    rows = [(i * 9 + k, urls[k % 5], h) for k in range(9) for i, h in enumerate(html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("layout_assignments", "content_types", "site_graph_stats", "unused_routes"):
        got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted(con.execute(catalog.ORACLE[name]).fetchall(), key=str), name


def test_navigation_tells_the_order_of_its_pages(spark, tmp_path):
    """By title, then by number; a page without HTML has no title and comes last."""
    rows = [(4, "http://a.com/x", "<title>b</title>"), (3, "http://a.com/y", "<title>a</title>"), (2, "http://a.com/z/w", "<title>0</title>"), (1, "http://a.com/q", "<title>b</title>"), (0, "http://a.com/n", None), (9, "http://b.com/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.QUERIES["navigation_trees"](spark, str(tmp_path))
    con.execute(f"CREATE TABLE o AS {catalog.ORACLE['navigation_trees']}")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM o").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r.host: r.primary_order for r in got.collect()} == {"a.com": "3,1,4,0", "b.com": None}
