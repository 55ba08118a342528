"""Queries over a whole site: navigation, categories, assets, duplicates, search index, bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import markup, paths, text, urls
from quern.operators import frontier, graph, nested
from quern.operators.keywords import keyword_overlap
from quern.plans.web import LINKS_SQL, RICH_SQL, page_links, rich_pages, sql_host, sql_normalize, sql_resolve, sql_route
from quern.registry import query
from quern.scratch import materialize
from quern.sources.tables import table

PARTS_SQL = f"WITH p AS (SELECT page_id, url, html, {sql_host('url')} AS host, list_filter(string_split({sql_route('url')}, '/'), lambda s: s <> '') AS parts, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = urls.route(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", "html", urls.host(F.col("url")).alias("host"), urls.segments(route).alias("parts"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title")
    )


MENU_SQL = PARTS_SQL + """, k AS (SELECT p.*, unnest(range(1, len(parts) + 1)) AS k FROM p WHERE url IS NOT NULL),
a AS (SELECT host, host || '/' || array_to_string(parts[1:k], '/') AS node, host || CASE WHEN k > 1 THEN '/' || array_to_string(parts[1:k - 1], '/') ELSE '' END AS parent, CAST(k AS INTEGER) AS depth,
  CASE WHEN k = len(parts) THEN title END AS title, coalesce(TRY_CAST(nullif(regexp_extract(CASE WHEN k = len(parts) THEN url END, '[?&]page=([0-9]+)', 1), '') AS BIGINT), 999) AS place, CASE WHEN k = len(parts) THEN page_id END AS page_id, parts[k] AS slug FROM k),
n AS (SELECT host, node, parent, depth, min(slug) AS slug, coalesce(arg_min(title, page_id), min(slug)) AS title, coalesce(arg_min(place, page_id), 999) AS place FROM a GROUP BY host, node, parent, depth),
j AS (SELECT *, '{"node":' || to_json(node) || ',"title":' || to_json(title) || ',"depth":' || depth || ',"children":[' AS head FROM n),
"""


def menu_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, node, parent, depth, slug, title, place): every path of a site, with the title and the
    page number of its first page; a path without a page has its last segment as title."""
    p = parts(spark, sf_dir).filter("url is not null and size(parts) > 0")
    k = p.select("*", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"))
    upto = lambda n: F.concat_ws("/", F.array("host"), F.slice("parts", F.lit(1), n))
    own = F.col("k") == F.size("parts")
    number = F.nullif(F.regexp_extract("url", "[?&]page=([0-9]+)", 1), F.lit("")).cast("long")
    a = k.select(
        "host", upto(F.col("k")).alias("node"), upto(F.col("k") - 1).alias("parent"), F.col("k").alias("depth"), F.get("parts", F.col("k") - 1).alias("slug"),
        F.when(own, F.struct("page_id", "title", F.coalesce(number, F.lit(999)).alias("place"))).alias("page"),
    )
    g = a.groupBy("host", "node", "parent", "depth").agg(F.min("slug").alias("slug"), F.min("page").alias("page"))
    return g.select("host", "node", "parent", "depth", "slug", F.coalesce("page.title", "slug").alias("title"), F.coalesce("page.place", F.lit(999)).alias("place"))


@query(MENU_SQL + """c3 AS (SELECT parent, string_agg(head || ']}', ',' ORDER BY place, title, node) AS kids FROM j WHERE depth = 3 GROUP BY parent),
c2 AS (SELECT j.parent, string_agg(head || coalesce(kids, '') || ']}', ',' ORDER BY place, title, node) AS kids FROM j LEFT JOIN c3 ON c3.parent = j.node WHERE depth = 2 GROUP BY j.parent),
s AS (SELECT * FROM j WHERE depth = 2 QUALIFY row_number() OVER (PARTITION BY host ORDER BY node) <= 50)
SELECT 'primary' AS menu, host, node, head || coalesce(kids, '') || ']}' AS json FROM j LEFT JOIN c2 ON c2.parent = j.node WHERE depth = 1
UNION ALL SELECT 'secondary', host, node, head || coalesce(kids, '') || ']}' FROM s LEFT JOIN c3 ON c3.parent = s.node""")
def navigation_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each site's menus with the items nested in them: the primary menu has all paths
    of depth 1 with two levels below, the secondary fifty of depth 2 with one."""
    n = materialize(menu_nodes(spark, sf_dir), "menu")
    item, order = F.struct("node", "title", "depth"), [F.col("place"), F.col("title")]
    first = F.row_number().over(Window.partitionBy("host").orderBy("node"))  # fifty a host: Spark limits before it shuffles
    second = n.filter("depth = 2").withColumn("i", first).filter("i <= 50").select("host", F.col("node").alias("n2"))
    primary = nested.fold(n, item, order, top=1, levels=2).select(F.lit("primary").alias("menu"), F.substring_index("node", "/", 1).alias("host"), "node", "json")
    lower = nested.fold(n, item, order, top=2, levels=1).join(second, F.col("node") == F.col("n2"))
    return primary.unionByName(lower.select(F.lit("secondary").alias("menu"), "host", "node", "json"))


@query(MENU_SQL + """f AS (SELECT *, '{"route":' || to_json(regexp_replace(node, '^[^/]*', '')) || ',"title":' || to_json(title) || ',"slug":' || to_json(slug) || ',"depth":' || depth || ',"children":[' AS h FROM n WHERE depth <= 2 AND slug NOT IN ('privacy', 'terms', 'es')),
c2 AS (SELECT parent, string_agg(h || ']}', ',' ORDER BY node) AS kids FROM f WHERE depth = 2 GROUP BY parent)
SELECT host, node, h || coalesce(kids, '') || ']}' AS json FROM f LEFT JOIN c2 ON c2.parent = f.node WHERE depth = 1""")
def prime_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed routes down to depth 2, nested, by route; those that a footer or nothing lists are
    left out with what is below them (a fixture: privacy, terms and all of /es)."""
    n = menu_nodes(spark, sf_dir).filter("depth <= 2 and slug not in ('privacy', 'terms', 'es')")
    item = F.struct(F.regexp_replace("node", "^[^/]*", "").alias("route"), "title", "slug", "depth")
    return nested.fold(n, item, [F.col("node")], top=1, levels=1).select(F.substring_index("node", "/", 1).alias("host"), "node", "json")


@query(PARTS_SQL + """, c AS (SELECT host, page_id, title, len(parts) AS depth, row_number() OVER (PARTITION BY host, len(parts) ORDER BY page_id) AS i FROM p)
SELECT host, count(*) FILTER (WHERE depth = 1) AS primary_items, least(50, count(*) FILTER (WHERE depth = 2)) AS secondary_items, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY title, page_id) FILTER (WHERE depth = 1) AS primary_order,
  CAST(max(depth) AS INTEGER) AS max_depth FROM c GROUP BY host""")
def navigation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's navigation: pages one level deep by title, and of the next level fifty at most
    (a menu's length). Titles are compared by code point; only numbers of pages are gathered in
    the row of a site. The items with what is below them are rows of ``navigation_menus``."""
    p = parts(spark, sf_dir).select("host", "page_id", "title", F.size("parts").alias("depth"))
    g = p.groupBy("host").agg(F.count_if(F.col("depth") == 1).alias("primary_items"), F.least(F.lit(50), F.count_if(F.col("depth") == 2)).alias("secondary_items"), F.max("depth").alias("max_depth"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.asc_nulls_last("title"), F.asc_nulls_last("page_id")))
    first = p.filter("depth = 1").select(F.col("host").alias("_host"), F.struct(place.alias("i"), "page_id").alias("o")).groupBy("_host").agg(F.sort_array(F.collect_list("o")).alias("o"))
    order = F.array_join(F.transform("o", lambda x: x["page_id"].cast("string")), ",")
    return g.join(first, F.col("host").eqNullSafe(F.col("_host")), "left").select("host", "primary_items", "secondary_items", order.alias("primary_order"), "max_depth")


@query(PARTS_SQL + """, s AS (SELECT page_id, list_transform(list_filter(parts, lambda x: NOT regexp_matches(x, '^[0-9]+$') AND NOT regexp_matches(x, '[.](html?|php|aspx?)$', 'i')), lambda x: replace(replace(lower(x), '-', ' '), '_', ' '))[1:4] AS c FROM p),
e AS (SELECT page_id, unnest(range(1, len(c) + 1)) AS k, c FROM s), g AS (SELECT array_to_string(c[1:k], '/') AS category, CAST(k - 1 AS INTEGER) AS depth, count(*) AS pages FROM e GROUP BY 1, 2)
SELECT category, depth, pages, depth = 0 AND pages / (SELECT count(*) FROM p)::DOUBLE >= 0.15 AS featured FROM g WHERE pages >= 2""")
def category_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by path with two pages at least; at the top those with 15 % of all are featured."""
    kept = F.filter("parts", lambda s: ~s.rlike("^[0-9]+$") & ~s.rlike(r"(?i)\.(html?|php|aspx?)$"))
    c = parts(spark, sf_dir).select(F.slice(F.transform(kept, lambda s: F.translate(F.lower(s), "-_", "  ")), 1, 4).alias("c"))
    e = c.filter(F.size("c") > 0).select("c", F.explode(F.sequence(F.lit(1), F.size("c"))).alias("k"))
    g = e.groupBy(F.array_join(F.slice("c", F.lit(1), F.col("k")), "/").alias("category"), (F.col("k") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("pages"))
    total = table(spark, sf_dir, "pages").count()
    return g.filter("pages >= 2").withColumn("featured", (F.col("depth") == 0) & (F.col("pages") / F.lit(max(total, 1)) >= 0.15))


@query(f"""{PARTS_SQL} SELECT lower(url) AS path, count(*) AS pages, min(page_id) AS first_page FROM p GROUP BY 1 HAVING count(*) > 1""")
def duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "pages").groupBy(F.lower("url").alias("path")).agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))
    return g.filter("pages > 1")


@query(rf"""
WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace({sql_route('url')}, '[^/]+$', '[id]') WHEN 1 THEN regexp_replace({sql_route('url')}, '[^/]+$', '[slug]') WHEN 2 THEN '/docs/[...rest]' ELSE {sql_route('url')} END AS route FROM pages),
k AS (SELECT *, regexp_replace(route, '\[[^\]/]*\]+', '[*]', 'g') AS shape FROM r)
SELECT shape, count(*) AS routes, min(page_id) AS kept, CASE WHEN count(DISTINCT route) = 1 THEN 'exact-path' ELSE 'param-collision' END AS reason FROM k GROUP BY shape HAVING count(*) > 1
""")
def duplicate_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that collide once their parameters are taken alike; the first of each stays."""
    route, k = urls.route(F.col("url")), F.col("page_id") % 4
    made = F.when(k == 0, F.regexp_replace(route, "[^/]+$", "[id]")).when(k == 1, F.regexp_replace(route, "[^/]+$", "[slug]")).when(k == 2, "/docs/[...rest]").otherwise(route)
    r = table(spark, sf_dir, "pages").select("page_id", made.alias("route"))
    per = r.groupBy(paths.open_shape(F.col("route")).alias("shape"), "route").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    g = per.groupBy("shape").agg(F.sum("n").alias("routes"), F.min("first").alias("kept"), F.count(F.lit(1)).alias("forms")).filter("routes > 1")
    return g.select("shape", "routes", "kept", F.when(F.col("forms") == 1, "exact-path").otherwise("param-collision").alias("reason"))


@query(rf"""
{RICH_SQL}, i AS (SELECT page_id, {sql_normalize(sql_resolve('trim(url)', "unnest(regexp_extract_all(html, '<img src=\"(/img/[^\"]*)\"', 1))"), False)} AS asset FROM pages_rich)
SELECT asset, min(page_id) AS canonical_page, count(*) AS uses, CAST(count(*) - 1 AS BIGINT) AS duplicates, CAST((count(*) - 1) * 120 AS BIGINT) AS wasted_kb FROM i GROUP BY asset
""")
def asset_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a site by normalised URL: the first use stands, the others repeat it (120 KB each)."""
    src = F.filter(markup.values(F.col("html"), "img", "src"), lambda s: s.startswith("/img/"))
    i = rich_pages(spark, sf_dir).select("page_id", F.explode(F.transform(src, lambda s: urls.normalize(urls.resolve(F.trim("url"), s), ("",)))).alias("asset"))
    g = i.groupBy("asset").agg(F.min("page_id").alias("canonical_page"), F.count(F.lit(1)).alias("uses"))
    return g.withColumns({"duplicates": F.col("uses") - 1, "wasted_kb": (F.col("uses") - 1) * 120})


@query(rf"""
WITH s AS (SELECT page_id, {sql_route('url')} AS route, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS plain, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages),
m AS (SELECT page_id, title FROM s WHERE page_id % 3 > 0)
SELECT s.page_id, s.route, coalesce(m.title, 'Untitled') AS title, substr(plain, 1, 200) AS excerpt FROM s LEFT JOIN m USING (page_id)
""")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a site's search index: titles from a manifest (two in three pages), excerpts of
    200 code points, as the index defines them."""
    plain = text.squeeze(F.regexp_replace("html", "<[^>]+>", " "))
    p = table(spark, sf_dir, "pages")
    s = p.select("page_id", urls.route(F.col("url")).alias("route"), F.substring(plain, 1, 200).alias("excerpt"))
    m = p.filter("page_id % 3 > 0").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return s.join(m, "page_id", "left").select("page_id", "route", F.coalesce("title", F.lit("Untitled")).alias("title"), "excerpt")


@query("""
WITH n AS (SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS node FROM documents), o AS (SELECT 'jobs/j1/media/' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) || '/a.bin' AS key FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'jobs/j1/x/' || doc_id FROM documents WHERE doc_id % 10 = 0),
k AS (SELECT key, regexp_extract(key, '/([0-9a-f]{16})/', 1) AS node FROM o)
SELECT doc_id, k.key, CASE WHEN k.key IS NULL THEN 'missing' WHEN doc_id IS NULL THEN 'orphan' ELSE 'bound' END AS state FROM n FULL JOIN (SELECT * FROM k) k ON k.node = n.node
""")
def object_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest nodes and stored objects, by the node id in an object's key: bound, missing or orphan."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    node = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16)
    n = d.select("doc_id", node.alias("node"))
    keys = d.filter("doc_id % 3 != 0").select(F.concat(F.lit("jobs/j1/media/"), node, F.lit("/a.bin")).alias("key"))
    keys = keys.unionAll(d.filter("doc_id % 10 = 0").select(F.concat(F.lit("jobs/j1/x/"), F.col("doc_id").cast("string"))))
    k = keys.select("key", F.nullif(F.regexp_extract("key", "/([0-9a-f]{16})/", 1), F.lit("")).alias("node"))
    state = F.when(F.col("key").isNull(), "missing").when(F.col("doc_id").isNull(), "orphan").otherwise("bound")
    return n.join(k, "node", "full_outer").select("doc_id", "key", state.alias("state"))


_KINDS = ("user", "post", "order", "invoice", "upload", "chat", "category", "find", "cart", "blog")


@query(rf"""
WITH p AS (SELECT page_id AS page, list_distinct(list_filter(list_append(regexp_split_to_array(lower({sql_route('url')}), '[^a-z0-9àâäçéèêëîïôöûüßñóíúá]+'), {list(_KINDS)}[page_id % 10 + 1]), lambda w: w <> '')) AS words FROM pages),
e AS (SELECT p_partkey AS endpoint, list_distinct(['api', {list(_KINDS)}[p_partkey % 10 + 1] || CASE p_partkey % 2 WHEN 0 THEN 's' ELSE '' END, CAST(p_partkey AS VARCHAR)]) AS words FROM part),
f(family, names) AS (VALUES ('user', ['user', 'users']), ('post', ['post', 'posts', 'blog']), ('order', ['order', 'orders', 'cart']), ('payment', ['invoice', 'invoices']), ('file', ['upload', 'uploads']), ('message', ['chat']), ('tag', ['category']), ('search', ['find'])),
pw AS (SELECT page, unnest(words) AS word FROM p), ew AS (SELECT endpoint, unnest(words) AS word FROM e),
s AS (SELECT page, endpoint, count(*) * 10 AS score FROM pw JOIN ew USING (word) GROUP BY 1, 2
  UNION ALL SELECT page, endpoint, CAST(sum(k) * 5 AS BIGINT) FROM (SELECT page, family, count(*) AS k FROM pw JOIN f ON list_contains(names, word) GROUP BY 1, 2) JOIN (SELECT DISTINCT endpoint, family FROM ew JOIN f ON list_contains(names, word)) USING (family) GROUP BY 1, 2),
t AS (SELECT page, endpoint, CAST(sum(score) AS BIGINT) AS score FROM s GROUP BY 1, 2)
SELECT page, arg_max(endpoint, (score, -endpoint)) AS endpoint, max(score) AS score FROM t GROUP BY page
""")
def endpoint_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The endpoint (from parts) that shares most words with each page."""
    kind = lambda k: F.get(F.array(*map(F.lit, _KINDS)), (k % 10).cast("int"))
    words = F.filter(F.split(F.lower(urls.route(F.col("url"))), "[^a-z0-9àâäçéèêëîïôöûüßñóíúá]+"), lambda w: w != "")
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.array_append(words, kind(F.col("page_id"))).alias("words"))
    k = F.col("p_partkey")
    plural = F.concat(kind(k), F.when(k % 2 == 0, "s").otherwise(""))
    e = table(spark, sf_dir, "part").select(k.alias("endpoint"), F.array(F.lit("api"), plural, k.cast("string")).alias("words"))
    return keyword_overlap(p, e)


@query("""
WITH u AS (SELECT l_orderkey AS page, l_suppkey AS component FROM lineitem GROUP BY 1, 2), c AS (SELECT o_orderkey AS page FROM orders WHERE o_orderkey % 50 = 0), a AS (SELECT DISTINCT component FROM u JOIN c USING (page))
SELECT u.page, count(*) AS components FROM u JOIN a USING (component) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page = u.page) GROUP BY u.page
""")
def propagated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (orders) that share a component (supplier) with changed pages, changed ones aside."""
    u = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("component")).distinct()
    c = table(spark, sf_dir, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("page"))
    a = u.join(c, "page", "left_semi").select("component").distinct()
    return u.join(a, "component", "left_semi").join(c, "page", "left_anti").groupBy("page").agg(F.count(F.lit(1)).alias("components"))


@query("SELECT l_suppkey AS endpoint, count(DISTINCT l_orderkey) AS pages, min(l_orderkey) AS first_page FROM lineitem GROUP BY 1")
def usage_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages (orders) use each endpoint (supplier); lists of pages are the pairs themselves."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("endpoint"), F.col("l_orderkey").alias("page")).distinct()
    return pairs.groupBy("endpoint").agg(F.count(F.lit(1)).alias("pages"), F.min("page").alias("first_page"))


@query("""
SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(o_orderkey % 1000) AS BIGINT) AS kb FROM orders GROUP BY 1
""")
def priority_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey") % 1000).alias("kb"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'HIGH' WHEN l_quantity > 20 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM lineitem WHERE l_linenumber >= 3 AND l_partkey % 4 <> 0
""")
def lazy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media (order lines) from the third place on that do not load lazily yet, by size."""
    q = F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber >= 3 and l_partkey % 4 != 0")
    return lines.select("l_orderkey", "l_linenumber", F.when(q > 40, "HIGH").when(q > 20, "MEDIUM").otherwise("LOW").alias("priority"))


@query(PARTS_SQL + """ SELECT page_id, CAST(row_number() OVER (PARTITION BY host ORDER BY coalesce(CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 4 END, 0), CASE WHEN page_id % 5 = 0 THEN '' ELSE lpad(CAST(page_id % 100 AS VARCHAR), 3, '0') END DESC, title, page_id) AS INTEGER) AS place FROM p""")
def node_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a site in order of page number, newest first, then title; missing ones come as 0 and ''."""
    k = F.col("page_id")
    number = F.coalesce(F.when(k % 3 != 0, k % 4), F.lit(0))
    published = F.when(k % 5 == 0, "").otherwise(F.lpad((k % 100).cast("string"), 3, "0"))
    w = Window.partitionBy("host").orderBy(number, published.desc(), "title", "page_id")
    return parts(spark, sf_dir).select("page_id", F.row_number().over(w).alias("place"))


@query("""
WITH a AS (SELECT doc_id, 'http://s/' || doc_id % 500 AS url, doc_id AS ord FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id, 'http://s/' || doc_id % 700, doc_id + 1000000 FROM documents WHERE doc_id % 3 = 0)
SELECT url, arg_min(doc_id, ord) AS doc_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY url
""")
def merged_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of two jobs one after another, each URL once, by its first place."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    link = lambda n: F.concat(F.lit("http://s/"), (F.col("doc_id") % n).cast("string"))
    a = d.filter("doc_id % 2 = 0").select("doc_id", link(500).alias("url"), F.col("doc_id").alias("ord"))
    b = d.filter("doc_id % 3 = 0").select("doc_id", link(700).alias("url"), (F.col("doc_id") + 1000000).alias("ord"))
    return a.unionByName(b).groupBy("url").agg(F.min_by("doc_id", "ord").alias("doc_id"))


@query("""
WITH a AS (SELECT doc_id, 'u' || doc_id AS url FROM documents), c AS (SELECT 'u' || doc_id AS url FROM labels) SELECT doc_id FROM a WHERE url NOT IN (SELECT url FROM c)
""")
def resume_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a job that no checkpoint lists as completed."""
    url = F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url")
    return table(spark, sf_dir, "documents").select("doc_id", url).join(table(spark, sf_dir, "labels").select(url).distinct(), "url", "left_anti").select("doc_id")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS type, CAST(floor(l_quantity / 50.0 * 20 + 0.5) * 5 AS INTEGER) AS width, CAST(floor(l_extendedprice / 10000 + 0.5) * 100 AS INTEGER) AS height FROM lineitem)
SELECT type, width, height, count(*) AS regions, count(DISTINCT l_orderkey) AS pages, count(DISTINCT l_orderkey) >= 0.5 * (SELECT count(DISTINCT l_orderkey) FROM r) AS is_global FROM r GROUP BY 1, 2, 3
""")
def component_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of pages (order lines) by type and shape: relative width and height to the next 100."""
    width = (F.floor(F.col("l_quantity") / 50.0 * 20 + 0.5) * 5).cast("int")
    height = (F.floor(F.col("l_extendedprice") / 10000 + 0.5) * 100).cast("int")
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("type"), width.alias("width"), height.alias("height"))
    total = r.agg(F.countDistinct("l_orderkey")).first()[0]
    g = r.groupBy("type", "width", "height").agg(F.count(F.lit(1)).alias("regions"), F.countDistinct("l_orderkey").alias("pages"))
    return g.withColumn("is_global", F.col("pages") >= 0.5 * total)


@query(rf"""{LINKS_SQL}, e AS (SELECT {sql_normalize('url')} AS parent, {sql_normalize('link')} AS child, {sql_host('url')} AS own, link FROM made),
a AS (SELECT DISTINCT parent, child FROM e WHERE regexp_matches(link, '^https?://', 'i') AND {sql_host('link')} = own AND NOT regexp_matches({sql_route('link')}, '{urls.BLOCKED_EXTENSION}') AND NOT regexp_matches({sql_route('link')}, '{urls.BLOCKED_PATH}')),
f AS (SELECT DISTINCT {sql_normalize('url')} AS node, 0 AS depth FROM pages WHERE page_id % 10 = 0), g AS (SELECT * FROM f UNION SELECT child, 1 FROM a JOIN f ON parent = node), h AS (SELECT * FROM g UNION SELECT child, 2 FROM a JOIN g ON parent = node AND depth = 1), i AS (SELECT * FROM h UNION SELECT child, 3 FROM a JOIN h ON parent = node AND depth = 2)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM i GROUP BY node""")
def frontier_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth first over the links that a crawl admits, three levels from every tenth page."""
    pages = rich_pages(spark, sf_dir)
    links = page_links(pages).filter(urls.skip_reason(F.col("link"), urls.host(F.col("url"))).isNull())
    edges = links.select(urls.normalize(F.col("url")).alias("parent"), urls.normalize(F.col("link")).alias("child"))
    roots = pages.filter("page_id % 10 = 0").select(urls.normalize(F.col("url")).alias("node"))
    return graph.levels(edges, roots, max_depth=3)


@query(rf"""{LINKS_SQL}, r AS (SELECT 'route-link' AS kind, page_id, link AS target FROM made UNION SELECT 'route-layout', page_id, ['Article', 'Grid', 'Landing'][page_id % 3 + 1] FROM pages
  UNION SELECT 'route-component', page_id, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) FROM pages_rich)
SELECT kind, count(*) AS edges, count(DISTINCT target) AS targets FROM r GROUP BY kind""")
def relationship_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from pages to links, layouts (by number) and components (classes), once each."""
    pages = rich_pages(spark, sf_dir)
    layout = F.get(F.array(*map(F.lit, ("Article", "Grid", "Landing"))), (F.col("page_id") % 3).cast("int"))
    classes = F.explode(text.extract_all(F.col("html"), 'class="([^"]*)"'))
    kinds = {
        "route-link": page_links(pages).select("page_id", F.col("link").alias("target")),
        "route-layout": pages.select("page_id", layout.alias("target")),
        "route-component": pages.select("page_id", classes.alias("target")),
    }
    every = None
    for kind, df in kinds.items():
        e = df.select(F.lit(kind).alias("kind"), "page_id", "target")
        every = e if every is None else every.unionByName(e)
    return every.distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("target").alias("targets"))


_ADMIT_SQL = f"""CASE WHEN lower(regexp_extract(link, '^([A-Za-z]+):', 1)) IN ('mailto', 'javascript', 'tel', 'sms', 'data', 'ftp', 'file', 'callto', 'skype', 'viber', 'whatsapp', 'tg') THEN 'protocol'
  WHEN NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN 'protocol' WHEN {sql_host('link')} <> {sql_host('url')} THEN 'external'
  WHEN regexp_matches({sql_route('link')}, '{urls.BLOCKED_EXTENSION}') THEN 'extension' WHEN regexp_matches({sql_route('link')}, '{urls.BLOCKED_PATH}') THEN 'path' END"""
FRONTIER_SQL = rf"""{RICH_SQL}, own AS (SELECT {sql_normalize('url')} AS node, min(page_id) AS page_id FROM pages WHERE url IS NOT NULL GROUP BY 1),
h AS (SELECT p.page_id, own.node, trim(p.url) AS url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)))) AS place FROM pages_rich p JOIN own USING (page_id)),
m AS (SELECT page_id, node, url, place, {sql_resolve('url', 'href')} AS link FROM h), l AS (SELECT page_id, node, place, {sql_normalize('link')} AS link, {_ADMIT_SQL} AS reason FROM m),
s AS (SELECT {sql_host('url')} AS crawl, min(page_id) AS page_id FROM pages WHERE url IS NOT NULL GROUP BY 1), r AS (SELECT crawl, node AS seed, node FROM s JOIN own USING (page_id)),
c AS (SELECT crawl, seed, place, link, reason FROM r JOIN l USING (node)), f AS (SELECT crawl, link, min(place) AS first FROM c WHERE link <> seed AND reason IS NULL GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY crawl ORDER BY first) + 1 AS turn FROM f QUALIFY turn <= 6), z AS (SELECT crawl, first AS last FROM a WHERE turn = 6),
j AS (SELECT c.crawl, CASE WHEN c.link = seed OR place > first THEN 'duplicate' WHEN place > last AND first IS DISTINCT FROM place THEN 'budget' ELSE reason END AS reason FROM c LEFT JOIN a USING (crawl, link) LEFT JOIN z USING (crawl))
"""


def crawls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A crawl of each host from its first page: six pages at most and one level."""
    pages = rich_pages(spark, sf_dir).filter("url is not null")
    own = pages.groupBy(urls.normalize(F.col("url")).alias("node")).agg(F.min("page_id").alias("page_id"))
    seeds = pages.groupBy(urls.host(F.col("url")).alias("crawl")).agg(F.min("page_id").alias("page_id")).join(own, "page_id").select("crawl", "node")
    held = pages.join(own, "page_id").select("node", F.trim("url").alias("url"), F.posexplode(markup.hrefs(F.col("html"))).alias("place", "href"))
    link = held.select("node", "place", "url", urls.resolve(F.col("url"), F.col("href")).alias("link"))
    links = link.select("node", "place", urls.normalize(F.col("link")).alias("link"), urls.skip_reason(F.col("link"), urls.host(F.col("url"))).alias("reason"))
    return frontier.crawl(seeds, links, max_pages=6, max_depth=1)


@query(FRONTIER_SQL + "SELECT crawl, seed AS node, 0 AS depth, CAST(1 AS BIGINT) AS turn FROM r UNION ALL SELECT crawl, link, 1, turn FROM a")
def crawl_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages a crawl with a budget visits, in the order of its queue."""
    return crawls(spark, sf_dir)[0]


@query(FRONTIER_SQL + "SELECT crawl, reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY ALL UNION ALL SELECT crawl, 'depth', count(*) FROM a JOIN l ON l.node = a.link GROUP BY crawl")
def crawl_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each crawl left links out."""
    return crawls(spark, sf_dir)[1]
