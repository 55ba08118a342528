import pytest
from pyspark.sql import functions as F

from quern.functions import markup
from quern.operators import palette
from quern.operators.page_tree import _Tree, element_text, page_trees
from quern.plans.pages import cards


def shape(html):
    t = _Tree(html)
    return [(e[0], e[2], e[3]) for e in t.elements]


def test_nested_unclosed_and_stray_tags():
    assert shape("<div><p>a<p>b</div><p>c") == [("div", -1, 2), ("p", 0, 1), ("p", 0, 2), ("p", -1, 3)]
    assert shape("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [("ul", -1, 5), ("li", 0, 1), ("li", 0, 4), ("ul", 2, 4), ("li", 3, 4), ("li", 0, 5)]
    assert shape("</div><div><b></div></b><i>") == [("div", -1, 1), ("b", 0, 1), ("i", -1, 2)]
    assert shape("<div><li>a</div><a>b") == [("div", -1, 1), ("li", 0, 1), ("a", -1, 2)]
    assert shape("<img><br/><input>") == [("img", -1, 0), ("br", -1, 1), ("input", -1, 2)]
    assert shape("<table><tr><td>1<td>2<tr><td>3</table>") == [("table", -1, 5), ("tr", 0, 3), ("td", 1, 2), ("td", 1, 3), ("tr", 0, 5), ("td", 4, 5)]
    assert shape("<script>if (a<b) '<div>'</script><!-- <p> --><a>") == [("script", -1, 0), ("a", -1, 1)]
    assert shape("a < b <1> <a href='>'>x</a>") == [("a", -1, 0)]


def test_attributes_text_and_entities():
    t = _Tree("""<A HREF="/a?x=1&amp;y=2" title='it"s' data-x=plain checked HREF="/no">T &amp; <b>U</b>&nbsp;</A>""")
    assert dict(t.elements[0][1]) == {"href": "/a?x=1&y=2", "title": 'it"s', "data-x": "plain", "checked": ""}
    assert "".join(t.pieces) == "T & U\xa0"


def test_containers_by_name_class_and_nesting(spark):
    html = """<body><div class="post"><p>The outer description, long enough.</p><ul><li><a href="/1">one</a></li>
      <li><img src="i.png"><a href="/2"> two </a><p>Short.</p></li></ul></div><a href="/3">three</a><a class="card" href="/4"><img data-src="/4.png"><span class="summary">%s</span></a>
      <article><a href="/5"></a><div><img data-lazy-src="/5.png"></div></article><a href="/1">again</a><a>none</a><a href="http://other.org/">x</a></body>""" % ("é" * 300)
    rows = {r.link[-2:]: (r.title, r.description, r.image) for r in cards(spark.createDataFrame([(1, "http://h.org/d/", html)], "page_id long, url string, html string")).collect()}
    assert rows == {
        "/1": ("one", None, None), "/2": ("two", None, "http://h.org/d/i.png"), "/3": ("three", None, None), "/4": ("é" * 200, "é" * 200, "http://h.org/4.png"),
        "/5": ("http://h.org/5", None, "http://h.org/5.png"),
    }


def test_trees_of_nulls_empty_and_long_pages_and_clashing_names(spark):
    long = '<div class="item"><a href="/x">x</a><img src="1">' * 20_000
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "no tags", 7), (4, long, 8)], "page_id long, html string, elements int")
    t = page_trees(df)
    assert t.columns == ["page_id", "elements", "pieces"]
    found = {r.page_id: (r.n, r.p) for r in t.select("page_id", F.size("elements").alias("n"), F.size("pieces").alias("p")).collect()}
    assert found == {1: (0, 0), 2: (0, 0), 3: (0, 1), 4: (60_000, 20_000)}
    one = t.filter("page_id = 4").select(F.col("elements")[59_998].alias("e"), element_text(F.col("pieces"), F.col("elements")[59_997]).alias("x")).first()
    assert (one.e.name, one.e.box, one.x) == ("a", 59_997, "x") and page_trees(df.limit(0)).count() == 0


@pytest.mark.parametrize("html,want", [
    ('<img src="data:x"><img src="a.png"><img src="./a.png"><img data-src="b.png">', dict(discovered=3, duplicates=1, lazy=1, final=2)),
    ('<picture><source srcset="a.png 1x, b.png 2x"><source src="c.png"></picture>', dict(discovered=2, picture=2, srcset=1, final=2)),
    ('<noscript><img src="n.png"></noscript><div style="background:url(n.png)"></div>', dict(discovered=2, noscript=1, backgrounds=1, duplicates=1, final=1)),
    (f'<img src="data:image/png;base64,{"A" * 300}"><meta property="og:image" content="o.png">', dict(discovered=2, data_uris=1, og=1, final=1)),
    (None, dict(discovered=0)),
])
def test_image_reports(spark, html, want):
    r = spark.createDataFrame([(html,)], "html string").select(markup.image_report(F.coalesce("html", F.lit("")), F.lit("http://h.org/")).alias("r")).first().r.asDict()
    assert r == dict.fromkeys(r, 0) | want and r["discovered"] == r["data_uris"] + r["invalid"] + r["duplicates"] + r["final"]


def test_embed_reports(spark):
    html = '<video src="a.mp4"><source src="b.mp4"></video><iframe src="https://www.youtube.com/embed/abcdefghijk"></iframe><iframe src="https://www.youtube.com/embed/abcdefghijk#t"></iframe><iframe src="/own"></iframe><a href="s.mp3">s</a><audio src="s.mp3"></audio>'
    r = spark.range(1).select(markup.embed_report(F.lit(html), F.lit("http://h.org/")).alias("r")).first().r.asDict()
    assert r == dict(total=5, no_canonical=1, by_provider={"native_video": 2, "native_audio": 1, "youtube": 1, "unknown_iframe": 1}, videos=2, audios=1, frames=3, sounds=1, unsupported=1, duplicates=2, errors=0)


def test_roles_of_colours_by_share(spark):
    uses = [("h", "#3366cc")] * 30 + [("h", "#ff2200")] * 2 + [("h", "#778899")] * 4 + [("h", "#fafafa")] * 20 + [("h", None)] + [("g", "#ff2200")]
    found = {(r.host, r.color): r.role for r in palette.roles(spark.createDataFrame(uses, "host string, color string"), "host").collect()}
    assert found == {("h", "#3366cc"): "primary", ("h", "#ff2200"): "accent", ("h", "#778899"): "secondary", ("h", "#fafafa"): "background", ("g", "#ff2200"): "primary"}
