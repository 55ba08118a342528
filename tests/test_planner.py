import random
import re

import duckdb

from quern import catalog
from quern.operators import merge, planner
from quern.operators.grams import meetings


def pairs(spark, hays, needles):
    found = meetings(spark.createDataFrame([(x,) for x in hays], "hay string"), spark.createDataFrame([(x,) for x in needles], "needle string"))
    return {tuple(r) for r in found.collect()}


def test_meetings_equal_the_nested_loop(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abÄ😀") for _ in range(rng.randint(1, 9)))
    hays, needles = [word() for _ in range(300)], [word() for _ in range(300)]
    want = {(h, n) for h in hays for n in needles if n in h}
    assert len(want) > 500 and pairs(spark, [*hays, None, ""], [*needles, None, ""]) == want
    assert pairs(spark, [], needles) == set() and pairs(spark, hays, []) == set()
    long = "x" * 400 + "needle" + "y" * 400
    assert pairs(spark, [long], ["needle", long, "xyz", "xn"]) == {(long, "needle"), (long, long), (long, "xn")}


def own(path):
    path = re.sub(r":(\w+)", r"[\1]", path)
    return re.sub(r"\[\[?\.{0,3}(\w+)\]?\]", r"[\1]", path).rstrip("/")


def parts(path):
    return [s for s in path.split("/") if s]


def fits(a, b):
    a, b = parts(own(a)), parts(own(b))
    return len(a) == len(b) and all(x[0] == "[" or y[0] == "[" or x == y for x, y in zip(a, b))


def brute(apis, pages):
    asked = {"/api/" + "/".join(parts(p)) for p in pages if "[" not in p and parts(p)}
    out = []
    for i, path in apis:
        mine = [s for s in parts(own(path)) if s != "api"]
        near = any((m[0] != "[" and m in s) or s in m for p in pages for s in parts(p) if s != "api" for m in mine)
        serves = near or any(fits(path, n) for n in asked)
        out.append((i, path, "IGNORE", 0.82 if serves else 0.95, serves))
    return sorted(out + [(None, n, "CREATE", 0.65, False) for n in asked if not any(fits(p, n) for _, p in apis)], key=str)


def endpoints(spark, apis, pages):
    return sorted((tuple(r) for r in planner.endpoint_matches(spark.createDataFrame(apis, "id long, path string"), spark.createDataFrame([(p,) for p in pages], "path string")).collect()), key=str)


def test_endpoints_equal_the_nested_loop(spark):
    rng = random.Random(5)
    words = ["blog", "posts", "post", "a", "api", "docs", "work", "**", "*", "Über", "zz9"]
    made = lambda extra, n, top="": top + "/" + "/".join(rng.choice(words + extra) for _ in range(rng.randint(1, n)))
    pages = [made(["x:y", "[q]"], 3) for _ in range(40)] + ["/", ""]
    apis = [(i, made([":id", "[slug]", "[[...rest]]", "[...all]", "qq", "vv"], 3, rng.choice(["/api", ""])) + rng.choice(["", "/"])) for i in range(120)] + [(900, "/"), (901, "/kkk/jjj")]
    want = brute(apis, pages)
    assert len({r[2:] for r in want}) == 3
    assert endpoints(spark, apis, pages) == want
    assert endpoints(spark, apis, []) == brute(apis, []) and endpoints(spark, [], pages) == brute([], pages)
    assert endpoints(spark, [(1, None), (2, "/qq")], [None, "/blog"]) == brute([(2, "/qq")], ["/blog"])


def test_many_endpoints_that_all_share_a_segment(spark):
    apis, pages = [(i, f"/api/item-{i}/:id") for i in range(2000)], [f"/shop/item-{i}/x" for i in range(1000, 3000)]
    got = endpoints(spark, apis, pages)
    serving = {r[0] for r in got if r[4]}
    held = {f"item-{i}" for i in range(1000, 3000)}
    assert serving == {i for i in range(2000) if i >= 1000 or any(f"item-{i}{d}" in held for d in [*range(10), *(f"{x:02}" for x in range(100)), *(f"{x:03}" for x in range(1000))])}
    assert sum(r[2] == "CREATE" for r in got) == 2000


FOUND = "ord int, id long, name string, slots array<string>"


def layouts(spark, found, assigned):
    rows = planner.layout_matches(spark.createDataFrame(found, FOUND), spark.createDataFrame([(a,) for a in assigned], "layout string")).collect()
    return {(r.layout, r.id): tuple(r)[1:4] + tuple(r)[5:] for r in rows}


def test_layouts(spark):
    full = ["header", "footer", "nav"]
    found = [(1, 11, "BlogPostGrid", full), (2, 12, "ArticleLayout", full), (3, 13, "docs", ["nav"]), (4, 14, "Hero", None), (5, 15, "hero", full), (6, 16, "odd", []), (7, 17, None, [])]
    got = layouts(spark, found, ["ArticleLayout"] * 3 + ["DocumentationLayout", "LandingLayout", "PortfolioLayout", "MinimalLayout", "Other", None])
    lacks = lambda *s: [planner.MISSING[x] for x in s]
    gone = lambda name: (None, "ARCHIVE", 0.55, name, None, None)
    assert got == {
        ("ArticleLayout", 12): (3, "EXTEND", 0.92, "ArticleLayout", 6, []),
        ("DocumentationLayout", 13): (1, "UPDATE", 0.6, "docs", 1, lacks("header", "footer", "sidebar")),
        ("LandingLayout", 14): (1, "UPDATE", 0.6, "Hero", 1, lacks("header", "footer", "nav")),
        ("PortfolioLayout", None): (1, "CREATE", 0.85, None, None, None), ("MinimalLayout", None): (1, "CREATE", 0.85, None, None, None),
        (None, 11): gone("BlogPostGrid"), (None, 15): gone("hero"), (None, 16): gone("odd"), (None, 17): gone(None),
    }
    assert layouts(spark, [], ["GalleryLayout"]) == {("GalleryLayout", None): (1, "CREATE", 0.85, None, None, None)}
    assert layouts(spark, found[-2:], []) == {(None, 16): gone("odd"), (None, 17): gone(None)}


def test_unused_routes(spark):
    routes = spark.createDataFrame([(1, "/a", False, False), (2, "/b", False, True), (3, "/api/c", True, True), (4, "/d", False, False)], "ord int, pattern string, api boolean, orphan boolean")
    used = spark.createDataFrame([(4,), (4,), (None,)], "ord int")
    assert sorted(map(tuple, planner.unused_routes(routes, used).collect())) == [(1, "/a", "ARCHIVE", 0.6), (2, "/b", "ARCHIVE", 0.7), (3, "/api/c", "IGNORE", 0.99)]


def test_unused_routes_of_equal_patterns(spark):
    """Only the first of equal patterns is used; a catch-all is by any route that starts as it does."""
    patterns = spark.createDataFrame([(i, "/en/[id]", "EXTEND") for i in range(1, 400)] + [(500, "/de/[...all]", "CREATE")], "ord int, pattern string, action string")
    pages = spark.createDataFrame([(i, f"/en/{i}") for i in range(400)] + [(900, "/devices")], "id int, route string")
    routes = patterns.selectExpr("ord", "pattern", "false as api", "false as orphan")
    left = planner.unused_routes(routes, merge.pattern_matches(pages, patterns))
    assert sorted(r.ord for r in left.collect()) == list(range(2, 400))


def test_unused_routes_of_pages_without_url(spark, tmp_path):
    """They are at the root, as in SQL, and make no route without a pattern."""
    urls = [None, "http://a.com/en/1", None, "http://a.com/de/2", "http://b.com/de/3.html", None, "http://b.com/fr/3"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("unused_routes", "route_matches"):
        got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted(con.execute(catalog.ORACLE[name]).fetchall(), key=str)


def test_a_bracket_opens_a_segment_closed_or_not(spark, tmp_path):
    urls = {4: "/x/[y", 5: "/x/q", 7: "/x/r", 8: "/[z/q", 13: "/w/q", 16: "/w]/q"}
    spark.createDataFrame([(i, f"http://a.com{u}") for i, u in urls.items()], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("unused_routes", "route_matches"):
        got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted(con.execute(catalog.ORACLE[name]).fetchall(), key=str)


def test_routes_of_one_form_are_dealt(spark):
    """All routes fit one open pattern and one catch-all; each finds the first, whatever its task."""
    pages = spark.createDataFrame([(i, f"/a{i}/b{i}") for i in range(300)] + [(300, "/only/[x]"), (301, "/z/y/x")], "id int, route string")
    patterns = spark.createDataFrame([(7, "/[p]/[q]", "A"), (9, "/[r]/[s]", "A"), (8, "/[...all]", "B"), (50, "/a5/b5", "C"), (60, "/only/[x]", "D")], "ord int, pattern string, action string")
    got = {r.route: r.b.ord for r in merge.first_matches(pages, patterns).collect()}
    assert got == {f"/a{i}/b{i}": 7 for i in range(300)} | {"/a5/b5": 50, "/only/[x]": 60, "/z/y/x": 8}
