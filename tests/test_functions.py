"""Functions on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quern.functions import markup, media, paths, text, urls, versions
from quern.operators import frameworks, layouts, merge

HTML = "html string, url string"


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


@pytest.mark.parametrize("base, href, want", [
    ("http://A.com/a/b?q#f", "c", "http://a.com/a/c"), ("http://a.com/a/b/", "../c?x=1#y", "http://a.com/a/c?x=1#y"), ("http://a.com", "c", "http://a.com/c"),
    ("http://a.com/a", "?p=2", "http://a.com/a?p=2"), ("http://a.com/a?z", "#t", "http://a.com/a?z#t"), ("https://a.com/a", "//B.org/./x/../y", "https://b.org/y"),
    ("http://a.com/a", "/../../x/.", "http://a.com/x/"), ("http://a.com/a?b#c", "", "http://a.com/a?b"), ("http://a.com:8080/a", "b", "http://a.com:8080/b"),
    ("http://a.com/", "mailto:x@y.z", "mailto:x@y.z"), ("no url", "b", None), ("no url", "HTTP://B.com", "http://b.com/"), (None, "/x", None), ("http://a.com/", None, None),
])
def test_resolve(spark, base, href, want):
    assert values(spark, [(base, href)], "b string, h string", urls.resolve(F.col("b"), F.col("h"))) == [want]


def test_hosts_links_and_pages_of_lists(spark):
    one = lambda u, e: values(spark, [(u,)], "u string", e(F.col("u")))[0]
    assert one("http://u:p@A.com:81/x", urls.host) == "a.com" and one("http://u:p@A.com:81/x", urls.authority) == "u:p@a.com:81"
    own = lambda c: urls.is_page_link(c, F.lit("a.com"))
    assert [one(u, own) for u in ("http://a.com/x", "http://a.com/x.PDF", "http://a.com/Feed/1", "http://b.com/", None)] == [True, False, False, False, False]
    second = lambda c: urls.is_page_of_list(c, F.lit(2))
    assert [one(u, second) for u in ("http://a/?pg=2", "http://a/page/2", "http://a/b/2/", "http://a/?page=22", "http://a/12")] == [True, True, True, False, False]
    both = values(spark, [("http://a.com/x/", "y/?utm_source=z#q")], "b string, h string", urls.resolve_normalized(F.col("b"), F.col("h")))
    assert both == ["http://a.com/x/y"]


def test_html_without_anything_and_null(spark):
    rows = [("", "http://a.com/"), (None, "http://a.com/"), ("<p>only text", "http://a.com/")]
    for e in (markup.images, markup.embeds, markup.resources):
        assert values(spark, rows, HTML, F.coalesce(F.size(e(F.col("html"), F.col("url"))), F.lit(0))) in ([0, 0, 0], [0, -1, 0])
    assert values(spark, rows, HTML, markup.next_page(F.col("html"), F.col("url"))) == [None] * 3
    assert values(spark, rows, HTML, F.coalesce(F.size(markup.structured_data(F.col("html"))), F.lit(0)))[0] == 0


def test_images_in_order_and_once(spark):
    html = """<head><meta property='og:image' content='/o.png'><meta content="/t.png" name="twitter:image:src"></head>
      <img data-lazy-src="/l.png" src="/blank.gif"><img SRC='/o.png'><picture><source srcset="/p.png 2x, /q.png"><img src="/f.png"></picture>
      <img srcset="data:image/png;base64,AA, /s.png 10w"><div style="background: url( '/b.png' )"></div><noscript><img src="/n.png"></noscript>"""
    got = values(spark, [(html, "http://a.com/x/")], HTML, markup.images(F.col("html"), F.col("url")))[0]
    assert [(i.url.rsplit("/", 1)[1], i.method) for i in got] == [
        ("o.png", "og_meta"), ("t.png", "twitter_meta"), ("n.png", "noscript_src"), ("p.png", "srcset_best"), ("l.png", "lazy"), ("f.png", "src"), ("s.png", "srcset_best"),
        ("b.png", "css_background_inline"),
    ]


def test_srcsets_placeholders_colours_and_cookies(spark):
    best = lambda s: values(spark, [(s,)], "s string", markup.best_of_srcset(F.col("s")))[0]
    assert [best(s) for s in ("a 1x, b 2.5x", "a, b", "a 5w, b 50w, c 50w", "", None, "data:x 9w")] == ["b", "a", "b", None, None, None]
    held = lambda s: values(spark, [(s,)], "s string", markup.is_placeholder(F.col("s")))[0]
    assert [held(s) for s in ("", None, "about:blank", "x/Spacer.png", "data:image/gif;base64,R0", "/a.png")] == [True] * 5 + [False]
    assert values(spark, [("a{color:#FFF;b:#a1B2c3;c:#12345}",)], "s string", markup.css_colors(F.col("s"))) == [["#fff", "#a1b2c3"]]
    jar = "a=1; Expires=Thu, 18 Jun 2026; path=/, b=2;x, 3=4"
    assert values(spark, [(jar,)], "s string", markup.cookies(F.col("s"))) == [["a=1", "b=2"]]
    tags = '<meta name="A" content="1"><meta content="2" name="a"><meta name="b">'
    assert values(spark, [(tags,)], "s string", markup.meta_tags(F.col("s"))) == [{"a": "2"}]


def test_structured_data_arrays_and_errors(spark):
    html = """<script type="application/ld+json">[{"@context": "c", "@type": "A"}, {"@type": "B"}]</script><script type='application/ld+json'> </script>
      <script type="application/ld+json">{"x": {"y": 1}}</script><script type="application/ld+json">nonsense</script>"""
    got = values(spark, [(html,)], "s string", markup.structured_data(F.col("s")))[0]
    assert [tuple(g) for g in got] == [("A", True), ("B", False), ("Unknown", False), ("ParseError", False)]


@pytest.mark.parametrize("html, want", [
    ('<link rel="next" href="/2">', "http://a.com/2"), ('<a href="/n">Next page</a>', "http://a.com/n"), ('<a href="/n" aria-label="next">…</a>', "http://a.com/n"),
    ('<a href="http://b.com/n">next</a><a href="/l?page=4">4</a>', "http://a.com/l?page=4"), ('<a href="/l?page=9">9</a>', None),
])
def test_next_page(spark, html, want):
    assert values(spark, [(html, "http://a.com/l?page=3")], HTML, markup.next_page(F.col("html"), F.col("url"))) == [want]


@pytest.mark.parametrize("pattern, path, captured, structural", [
    ("/a/**", "/a/b/c", True, True), ("/a/**", "/a", False, True), ("/a/*", "/a/b", True, True), ("/a/*", "/a/b/c", False, True), ("/:x/b", "/a/b", True, True),
    ("/a/b", "/a/c", False, False), ("/", "/", True, True), ("/**", "/", False, True),
])
def test_path_patterns(spark, pattern, path, captured, structural):
    p, t = (paths.segments(F.col(c)) for c in "pt")
    row = spark.createDataFrame([(pattern, path)], "p string, t string").select(paths.wildcard_captures(p, t), paths.structural_match(p, t)).first()
    assert tuple(row) == (captured, structural)


def test_bracket_patterns(spark):
    rows = [("/a/b", "/a/[x]"), ("/a/b/c", "/a/[x]"), ("/docs/a/b", "/docs/[...all]"), ("/docs", "/docs/[[...all]]"), ("/x", "/docs/[...all]")]
    assert values(spark, rows, "t string, p string", paths.matches(F.col("t"), F.col("p"))) == [True, False, True, True, False]


def test_versions_hashes_and_lengths(spark):
    rows = [("v1.2.3",), ("2",), ("1.x.9",), ("",)]
    assert values(spark, rows, "v string", versions.bump(F.col("v"), F.lit("minor"))) == ["1.3.0", "2.1.0", "1.1.0", "0.1.0"]
    assert values(spark, rows, "v string", versions.is_version(F.col("v"))) == [True, False, False, False]
    assert values(spark, [("1.2.3", "1.3.0"), ("2.0", "2")], "a string, b string", versions.compare(F.col("a"), F.col("b"))) == [-1, 0]
    # 31 * (31 * 97 + 98) + 99 = 96354 = 0x17862
    assert values(spark, [("abc",)], "s string", versions.graph_id(F.col("s"))) == ["sg-00017862"]
    assert values(spark, [([],), (["#ab", "#c"],)], "c array<string>", versions.palette_hash(F.col("c"))) == ["000000", "00017862"]
    assert values(spark, [("12px",), ("1.5rem",), (" 2em ",), ("7",), ("3%",)], "v string", versions.pixels(F.col("v"))) == [12.0, 24.0, 32.0, 7.0, None]


def test_colours(spark):
    rows = [("#F80",), ("rgb(1, 2,3)",), ("RGBA(255,255,255,.5)",), ("red",), (None,)]
    assert values(spark, rows, "c string", text.normalize_color(F.col("c"))) == ["#ff8800", "#010203", "#ffffff", None, None]
    palette = (["#000000", "#1e0000", "#1d0000", "#ffffff"],)
    got = values(spark, [palette], "c array<string>", text.merged_colors(F.col("c")))[0]
    assert [(g.hex, g.n) for g in got] == [("#000000", 2), ("#1e0000", 1), ("#ffffff", 1)]
    assert values(spark, [(["#000000"], ["#000000"]), ([], ["#000000"])], "a array<string>, b array<string>", text.palette_similarity(F.col("a"), F.col("b"))) == [100, 0]
    assert values(spark, [("#ff0000",)], "c string", text.color_scale(F.col("c")))[0]["500"] == "#ff0000"


def test_media(spark):
    assert values(spark, [("http://a/b.JPEG?x",), ("http://a/b",)], "u string", media.mime_of(F.col("u"))) == ["image/jpeg", None]
    rows = [(bytes.fromhex("89504e47"), None), (b"<?xml version='1'?><svg/>", ""), (b"zz", "Text/Plain; x"), (b"", None)]
    assert values(spark, rows, "c binary, h string", media.sniff(F.col("c"), F.col("h"))) == ["image/png", "image/svg+xml", "text/plain", "application/octet-stream"]


def test_frameworks_of_pages_and_code(spark):
    html = '<meta name="generator" content="WordPress"><link href="/wp-content/a.css"><div data-reactroot id="__NEXT_DATA__"><script src="/_next/x.js">'
    row = spark.createDataFrame([(html,), ("",), (None,)], "html string").select(frameworks.detect(frameworks.scores(frameworks.signals(F.col("html")))).alias("d")).collect()
    # 90 + 65; next 85 + 60; react 55 cut to 16
    assert [(r.d.framework, r.d.score, r.d.confidence, r.d.others) for r in row] == [("wordpress", 155, 0.392, ["nextjs"]), ("unknown", 0, 0.0, []), ("unknown", 0, 0.0, [])]
    files = spark.createDataFrame([("b", "artisan", None), ("b", "composer.json", '{"require": {"laravel/framework": "11"}}'), ("c", "readme", "")], "base string, path string, content string")
    assert {r.base: (r.framework, r.score) for r in frameworks.detect_codebase(files).collect()} == {"b": ("laravel", 90), "c": ("unknown", 0)}


def test_route_collisions_by_kind(spark):
    schema = "id long, path string, methods array<string>, api boolean"
    prime = spark.createDataFrame(
        [(1, "/a", ["GET"], True), (2, "/b/**", ["GET"], False), (3, "/c/:id", ["GET"], False), (4, "/d", ["GET"], False), (5, "/e", ["POST"], False), (6, "/api", ["ANY"], True), (7, "/f/g", ["GET"], False)], schema
    )
    back = spark.createDataFrame(
        [(10, "/a", ["GET"], False), (11, "/b/x", ["GET"], False), (12, "/c/:name", ["PUT"], False), (13, "/e", ["GET"], False), (14, "/api/x/y", ["GET"], True), (15, "/f/*", ["GET"], False)], schema
    )
    got = {r.id: (r.resolution, r.kind, r.other) for r in layouts.collisions(prime, back).collect()}
    assert got == {
        1: ("BLOCK", "exact", 10), 2: ("BLOCK", "wildcard", 11), 3: ("MERGE", "parameter", 12), 4: ("SAFE", None, None), 5: ("MERGE", "exact", 13), 6: ("RENAME", "api", 14),
        7: ("RENAME", "wildcard", 15),
    }


def test_merge_of_nothing(spark):
    found = spark.createDataFrame([], "ord int, name string")
    layouts_ = spark.createDataFrame([("MinimalLayout", "FAQ")], "layout string, content string")
    got = {r.name: (r.action, r.confidence) for r in merge.component_matches(found, merge.needed_components(layouts_)).collect()}
    assert got["InlineMedia"] == ("CREATE", 0.9) and got["Accordion"] == ("CREATE", 0.75)
    routes = spark.createDataFrame([(1, "/x")], "id int, route string")
    assert tuple(merge.pattern_matches(routes, spark.createDataFrame([], "ord int, pattern string, action string")).first()) == (1, "/x", None, None, None)


def test_pattern_matches_by_form(spark):
    """Equal patterns count as one; a catch-all takes all that starts as it does; forms mix."""
    routes = spark.createDataFrame([(1, "/en/a"), (2, "/english"), (3, "/de/x/c"), (4, "/de//x/c/"), (5, "/[q]"), (6, None), (7, "/"), (8, "/de/y/d")], "id int, route string")
    patterns = [(9, "/en/[...rest]", "A"), (7, "/[a]/x/[b]", "B"), (8, "/de/[a]/c", "C"), (3, "/[q]", "D"), (10, "/de/x/c", "E"), (11, "/", "F"), (12, "/[[...all]]", "G")]
    many = patterns + [(20 + i, "/en/[id]", "H") for i in range(500)]
    got = {r.id: r.ord for r in merge.pattern_matches(routes, spark.createDataFrame(many, "ord int, pattern string, action string")).collect()}
    assert got == {1: 9, 2: 3, 3: 10, 4: 7, 5: 3, 6: None, 7: 11, 8: 12}
    known = merge._known(spark.createDataFrame(many, "ord int, pattern string, action string"))
    assert known.filter("key = '/en/'").select("way", "b.ord").collect() == [("form", 20)]
    got = merge.pattern_matches(routes, spark.createDataFrame([(9, "/en/[...rest]", "A")], "ord int, pattern string, action string")).filter("ord = 9")
    assert sorted(r.id for r in got.collect()) == [1, 2]
