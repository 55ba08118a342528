"""Queries that relate tables: existence, orphans, patterns, neighbours, sets, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text, urls
from quern.operators import graph, match, related
from quern.plans.scoring import WORDS_SQL
from quern.plans.web import sql_host, sql_normalize, sql_route
from quern.registry import query
from quern.sources.tables import table, upsert


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)
""")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' and o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
SELECT o_orderkey, n_name, r_name, coalesce(k, 0) AS lines FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey
""")
def dashboard_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    returned = t("lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("k"))
    places = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))  # a few rows: Spark broadcasts them by size
    jobs = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(places, F.col("n_nationkey") == F.col("c_nationkey"))
    return jobs.join(returned, "o_orderkey", "left").select("o_orderkey", "n_name", "r_name", F.coalesce("k", F.lit(0)).alias("lines"))


SHAPE_SQL = r"regexp_replace({0}, '/(\[[^\]]*\]|[0-9]+(\.html)?)', '/*', 'g')"
ROUTES_SQL = f"WITH r AS (SELECT page_id, {sql_host('url')} AS host, {sql_route('url')} AS route, {SHAPE_SQL.format(sql_route('url'))} AS shape FROM pages)"


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = urls.route(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), route.alias("route"), match.shape(route).alias("shape"))


PATTERNS = ((1, "/en/*", "ARTICLE"), (2, "/fr/*", "ARTICLE"), (3, "/en/*/", "LISTING"), (4, "/es/*", "GUIDE"))


@query(ROUTES_SQL + f""", p(ord, pattern, kind) AS (VALUES {", ".join(map(str, PATTERNS))})
SELECT page_id, min(ord) AS ord, coalesce(arg_min(kind, ord), 'IGNORE') AS action FROM r LEFT JOIN p ON r.shape = p.pattern GROUP BY page_id""")
def pattern_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pattern that fits a route: an equi-join on shapes, not a loop over patterns."""
    p = spark.createDataFrame(PATTERNS, "ord int, pattern string, kind string")
    best = routes(spark, sf_dir).join(p, F.col("shape") == F.col("pattern"), "left").groupBy("page_id").agg(F.min("ord").alias("ord"), F.min_by("kind", "ord").alias("k"))
    return best.select("page_id", "ord", F.coalesce("k", F.lit("IGNORE")).alias("action"))


@query(ROUTES_SQL + "SELECT shape, count(*) AS pages, count(DISTINCT host) AS hosts, count(DISTINCT route) AS routes FROM r GROUP BY shape HAVING count(*) > 1")
def route_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = routes(spark, sf_dir).groupBy("shape").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("host").alias("hosts"), F.countDistinct("route").alias("routes"))
    return g.filter("pages > 1")


@query(ROUTES_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY host, shape ORDER BY page_id) AS i FROM r)
SELECT a.page_id, b.page_id AS related, CAST(b.i - a.i AS INTEGER) AS distance FROM n a JOIN n b ON a.host = b.host AND a.shape = b.shape AND b.i - a.i BETWEEN 1 AND 5""")
def related_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next five siblings of a page (same host and shape), by windows: rows grow by five
    a page, not with the square of a site."""
    w = Window.partitionBy("host", "shape").orderBy("page_id")
    ahead = F.array(*(F.struct(F.lead("page_id", i).over(w).alias("related"), F.lit(i).alias("distance")) for i in range(1, 6)))
    return routes(spark, sf_dir).withColumn("ahead", ahead).select("page_id", F.explode("ahead").alias("s")).select("page_id", "s.*").filter("related is not null")


@query(f"""
WITH cms AS (SELECT page_id AS ord, url FROM pages), site AS (SELECT page_id + 1000000000 AS ord, regexp_replace(url, '[?#].*$', '') AS url FROM pages),
u AS (SELECT ord, url, {sql_normalize('url')} AS norm_url FROM (SELECT * FROM cms UNION ALL SELECT * FROM site))
SELECT norm_url, arg_min(url, ord) AS url FROM u GROUP BY norm_url
""")
def merged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of two listings, once each; the first listing's form wins."""
    pages = table(spark, sf_dir, "pages")
    cms = pages.select(F.col("page_id").alias("ord"), "url")
    site = pages.select((F.col("page_id") + 1000000000).alias("ord"), F.regexp_replace("url", "[?#].*$", "").alias("url"))
    both = cms.unionAll(site).withColumn("norm_url", urls.normalize(F.col("url")))
    return both.groupBy("norm_url").agg(F.min_by("url", "ord").alias("url"))


@query("""
WITH t AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS tags FROM orders GROUP BY o_custkey),
n AS (SELECT o_custkey, tags, lead(tags) OVER (ORDER BY o_custkey) AS other FROM t)
SELECT c_custkey, len(list_intersect(a.tags, b.tags)) * 100.0::DOUBLE / len(list_distinct(list_concat(a.tags, b.tags))) AS jaccard,
  len(list_intersect(a.tags, b.tags)) / greatest(len(a.tags), len(b.tags))::DOUBLE AS overlap
FROM customer JOIN t a ON a.o_custkey = c_custkey JOIN t b ON b.o_custkey = c_custkey + 1
""")
def tag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("tags"))  # five priorities at most
    a = t.select(F.col("o_custkey").alias("c_custkey"), F.col("tags").alias("a"))
    b = t.select((F.col("o_custkey") - 1).alias("c_custkey"), F.col("tags").alias("b"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(a, "c_custkey").join(b, "c_custkey")
    return c.select("c_custkey", match.jaccard_percent(F.col("a"), F.col("b")).alias("jaccard"), match.overlap(F.col("a"), F.col("b")).alias("overlap"))


@query("""
WITH s AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2), q AS (SELECT source, lang, n / (sum(n) OVER (PARTITION BY source))::DOUBLE AS p FROM s),
g AS (SELECT lang, count(*) / (SELECT count(*) FROM documents WHERE source IS NOT NULL)::DOUBLE AS p FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT source, CAST(round(1 - sum(abs(coalesce(q.p, 0) - g.p)) / 2, 6) AS DOUBLE) AS similarity
FROM (SELECT DISTINCT source FROM q) CROSS JOIN g LEFT JOIN q USING (source, lang) GROUP BY source
""")
def distribution_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near each source's mix of languages is to the whole's."""
    n = table(spark, sf_dir, "documents").filter("source is not null").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    per = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
    whole = n.groupBy("lang").agg(F.sum("n").alias("m"))
    total = whole.agg(F.sum("m")).first()[0]  # one number
    near = per.join(whole, "lang").withColumn("q", F.col("m") / F.lit(total))
    # A language that a source lacks adds q; all q of the others are one less what is held.
    d = near.groupBy("source").agg((F.sum(F.abs(F.col("p") - F.col("q"))) + 1 - F.sum("q")).alias("d"))
    return d.select("source", F.round(1 - F.col("d") / 2, 6).alias("similarity"))


@query("""
SELECT o_custkey AS source, o_orderpriority AS target, max(o_totalprice) AS confidence, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY 1, 2
""")
def decision_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision a key: the most confident, the first on a tie."""
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("target"), F.col("o_totalprice").alias("confidence"), "o_orderkey")
    return match.best_per_key(d, ["source", "target"], F.struct("confidence", -F.col("o_orderkey")), ["confidence", "o_orderkey"])


@query("""
SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer
""")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-or-replace by key: an anti join and a union."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return upsert(c, c.filter("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0)), "c_custkey")


@query("""
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3
""")
def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("o_orderdate"), F.col("o_orderkey")]
    o = table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)))
    return o.filter("place <= 3").select("o_orderkey", "place")


@query("""
SELECT doc_id, CAST(ntile AS INTEGER) AS chunk FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // ((SELECT count(*) FROM documents) // 8 + 1) AS ntile FROM documents)
""")
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight slices in order of id, by ranks that no single task computes."""
    from quern.operators.ordered import ranked_total

    docs = table(spark, sf_dir, "documents").select("doc_id")
    size = docs.count() // 8 + 1
    r = ranked_total(docs, "doc_id", [], F.lit(0))
    return r.select("doc_id", F.floor((F.col("rank") - 1) / size).cast("int").alias("chunk"))


NODES_SQL = f"""
WITH RECURSIVE p AS (SELECT DISTINCT {sql_host('url')} AS host, list_filter(string_split({sql_route('url')}, '/'), lambda s: s <> '') AS parts FROM pages),
n AS (SELECT DISTINCT host || '/' || array_to_string(parts[1:k], '/') AS node, host || CASE WHEN k > 1 THEN '/' || array_to_string(parts[1:k - 1], '/') ELSE '' END AS parent, host
  FROM p, unnest(range(1, len(parts) + 1)) AS u(k)),
"""


def site_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, host): every path of a site and the path above; hosts are the roots."""
    p = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), urls.segments(urls.route(F.col("url"))).alias("parts"))
    k = p.filter(F.size("parts") > 0).select("host", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"))

    def upto(n):
        return F.concat_ws("/", F.array("host"), F.slice("parts", 1, n))

    return k.select(upto(F.col("k")).alias("node"), upto(F.col("k") - 1).alias("parent"), "host").distinct()


@query(NODES_SQL + """b AS (SELECT DISTINCT host AS node, 0 AS depth FROM p UNION ALL SELECT n.node, b.depth + 1 FROM b JOIN n ON n.parent = b.node WHERE b.depth < 5)
SELECT node, min(depth) AS depth FROM b GROUP BY node""")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = site_nodes(spark, sf_dir)
    roots = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("node"))
    return graph.levels(nodes.select("parent", F.col("node").alias("child")), roots)


@query(NODES_SQL + """c AS (SELECT node, parent, node AS trail FROM n UNION ALL SELECT c.node, n.parent, n.node || '>' || c.trail FROM c JOIN n ON n.node = c.parent)
SELECT node, arg_max(trail, length(trail)) AS trail FROM c GROUP BY node""")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way to each node, from the top and with the node itself."""
    nodes = site_nodes(spark, sf_dir).select("node", "parent")
    way = F.array_append(F.reverse("trail"), F.col("node"))
    return graph.ancestors(nodes).select("node", F.array_join(way, ">").alias("trail"))


@query(NODES_SQL + "x AS (SELECT 1) SELECT parent, count(*) AS children FROM n WHERE parent <> host GROUP BY parent")
def section_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many children each node below a root has."""
    return site_nodes(spark, sf_dir).filter("parent != host").groupBy("parent").agg(F.count(F.lit(1)).alias("children"))


CRAWLED_SQL = f"""
WITH s AS (SELECT page_id, html, {sql_host('url')} AS host, list_filter(string_split({sql_route('url')}, '/'), lambda s: s <> '') AS parts FROM pages WHERE url IS NOT NULL),
p AS (SELECT *, '/' || array_to_string(parts, '/') AS route, CASE WHEN len(parts) > 0 THEN '/' || array_to_string(parts[1:len(parts) - 1], '/') END AS parent FROM s)
"""


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with host, segments, route without a slash at its end, and the route above."""
    pages = table(spark, sf_dir, "pages").filter("url is not null")
    p = pages.select("page_id", "html", urls.host(F.col("url")).alias("host"), urls.segments(urls.route(F.col("url"))).alias("parts"))
    route = F.concat(F.lit("/"), F.array_join("parts", "/"))
    return p.withColumn("route", route).withColumn("parent", urls.parent_route(route))


@query(CRAWLED_SQL + """SELECT p.page_id, p.host || p.route AS page, 'broken_parent_ref' AS reason
FROM p WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p q WHERE q.host = p.host AND q.route = p.parent)""")
def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages whose parent was not crawled. Parent and depth both follow from the
    URL, so that a page below the root always names a parent one level above."""
    p = crawled(spark, sf_dir).select("page_id", "host", "route", "parent")
    held = p.select(F.col("host").alias("held_host"), F.col("route").alias("held")).distinct()
    x = p.filter("parent is not null").join(held, (F.col("host") == F.col("held_host")) & (F.col("parent") == F.col("held")), "left")
    return x.filter("held is null").select("page_id", F.concat("host", "route").alias("page"), F.lit("broken_parent_ref").alias("reason"))


TAGS_SQL = f"""list_filter([CASE WHEN len(regexp_extract_all(html, '<img[\\s>]')) > 3 THEN 'media-rich' END, CASE WHEN {WORDS_SQL} > 500 THEN 'long-form' END], lambda t: t IS NOT NULL)"""


@query(CRAWLED_SQL + f""", r AS (SELECT host, route, any_value(parent) AS parent, any_value(parts) AS parts, min(page_id) AS ord, arg_max({TAGS_SQL}, page_id) AS tags FROM p GROUP BY host, route),
g AS (SELECT *, coalesce(parts[-1], 'home') AS slug, CASE WHEN route = '/' THEN 'homepage' ELSE 'unknown' END AS category FROM r),
f AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(slug, '[-_/]'), lambda w: w <> '')) AS words FROM g),
x AS (SELECT a.host, a.route, b.route AS related, b.ord, a.parent AS ap, b.parent AS bp, a.category AS ac, b.category AS bc, len(list_intersect(a.tags, b.tags)) AS shared, len(a.parts) AS depth,
  len(list_filter(range(1, len(a.parts) + 1), lambda i: coalesce(a.parts[i] = b.parts[i], false))) AS places,
  CASE WHEN a.slug = b.slug THEN 1.0::DOUBLE WHEN len(a.words) = 0 OR len(b.words) = 0 THEN 0.0::DOUBLE
    ELSE len(list_intersect(a.words, b.words))::DOUBLE / greatest(len(a.words), len(b.words)) END AS alike FROM f a JOIN f b ON a.host = b.host AND a.route <> b.route),
y AS (SELECT host, route, related, ord, CAST(CASE WHEN ap = bp THEN 40 ELSE 0 END + CASE WHEN bp = route THEN 30 ELSE 0 END + CASE WHEN ap = related THEN 25 ELSE 0 END
  + CASE WHEN ac <> 'unknown' AND ac = bc THEN 20 ELSE 0 END + 10 * shared + CASE WHEN alike > 0.5 THEN floor(alike * 15 + 0.5) ELSE 0 END + CASE WHEN depth > 1 THEN 5 * places ELSE 0 END AS INTEGER) AS score FROM x)
SELECT host, route, CAST(row_number() OVER (PARTITION BY host, route ORDER BY score DESC, ord) AS INTEGER) AS place, related, score
FROM y WHERE score >= 15 QUALIFY row_number() OVER (PARTITION BY host, route ORDER BY score DESC, ord) <= 5""")
def related_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five related pages of every route of a host. The tables hold no stencil
    types, so the categories and tags are those that follow without them."""
    html = F.col("html")
    media = F.when(F.regexp_count(html, F.lit(r"<img[\s>]")) > 3, "media-rich")
    long = F.when(F.size(text.words(F.regexp_replace(html, "<[^>]+>", " "))) > 500, "long-form")
    p = crawled(spark, sf_dir).withColumn("tags", F.array_compact(F.array(media, long)))
    r = p.groupBy("host", "route").agg(F.any_value("parent").alias("parent"), F.any_value("parts").alias("parts"), F.min("page_id").alias("ord"), F.max_by("tags", "page_id").alias("tags"))
    slug = urls.slug(F.col("route"))
    words = F.array_distinct(F.filter(F.split(slug, "[-_/]"), lambda w: w != ""))
    category = F.when(F.col("route") == "/", "homepage").otherwise("unknown")
    return related.related(r.withColumn("slug", slug).withColumn("words", words).withColumn("category", category))


CATCH_ALL = r"/\[{1,2}\.{1,3}[A-Za-z0-9_]+\].*$"
HREF = r'<a\s[^>]*href="([^"]*)"'


@query(CRAWLED_SQL + f""", h AS (SELECT host, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href FROM p),
l AS (SELECT CASE WHEN href LIKE '/%' AND href NOT LIKE '//%' THEN host ELSE {sql_host('href')} END AS host,
  list_filter(string_split(CASE WHEN href LIKE '/%' AND href NOT LIKE '//%' THEN regexp_extract(href, '^[^?#]*') ELSE {sql_route('href')} END, '/'), lambda s: s <> '') AS parts FROM h),
t AS (SELECT DISTINCT host, '/' || array_to_string(parts, '/') AS route FROM l),
r AS (SELECT DISTINCT host, route, parent FROM p), c AS (SELECT host, route, regexp_replace(route, '{CATCH_ALL}', '') AS prefix FROM r WHERE regexp_matches(route, '{CATCH_ALL}'))
SELECT host, route FROM r WHERE route NOT IN ('/', '/index') AND NOT regexp_matches(route, '^/api(/|$)')
  AND NOT EXISTS (SELECT 1 FROM t WHERE t.host = r.host AND t.route = r.route)
  AND NOT EXISTS (SELECT 1 FROM r q WHERE q.host = r.host AND q.route = r.parent)
  AND NOT EXISTS (SELECT 1 FROM r q WHERE q.host = r.host AND q.parent = r.route)
  AND NOT EXISTS (SELECT 1 FROM c WHERE c.host = r.host AND starts_with(r.route, c.prefix) AND r.route <> c.prefix)""")
def orphan_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that no link leads to, without crawled parent or children and under no catch-all."""
    p = crawled(spark, sf_dir)
    href, own = F.col("href"), F.col("href").startswith("/") & ~F.col("href").startswith("//")
    path = F.when(own, F.regexp_extract("href", "^[^?#]*", 0)).otherwise(urls.route(href))
    links = p.select("host", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    targets = links.select(F.when(own, F.col("host")).otherwise(urls.host(href)).alias("host"), F.concat(F.lit("/"), F.array_join(urls.segments(path), "/")).alias("route")).distinct()
    r = p.select("host", "route", "parent").distinct()
    parents = r.select("host", F.col("route").alias("parent"))
    above = r.select("host", F.col("parent").alias("route")).filter("route is not null").distinct()
    found = r.filter(~F.col("route").isin("/", "/index") & ~F.col("route").rlike("^/api(/|$)"))
    found = found.join(targets, ["host", "route"], "left_anti").join(parents, ["host", "parent"], "left_anti").join(above, ["host", "route"], "left_anti")
    c = r.filter(F.col("route").rlike(CATCH_ALL)).select(F.col("host").alias("c_host"), F.regexp_replace("route", CATCH_ALL, "").alias("prefix"))
    covered = (F.col("host") == F.col("c_host")) & F.startswith("route", F.col("prefix")) & (F.col("route") != F.col("prefix"))
    return found.join(c, covered, "left_anti").select("host", "route")


@query("""
WITH a(name, kind, required) AS (VALUES ('c_custkey', 'bigint', true), ('c_name', 'varchar', true), ('c_phone', 'varchar', true), ('c_acctbal', 'integer', false)),
b(name, kind) AS (VALUES ('c_custkey', 'bigint'), ('c_name', 'varchar'), ('c_acctbal', 'double'), ('c_nationkey', 'integer'))
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'KEEP' WHEN b.name IS NULL AND required THEN 'ADD_APPROVE' WHEN b.name IS NULL THEN 'ADD'
  WHEN a.kind = b.kind THEN 'NONE' WHEN b.kind = 'double' AND a.kind = 'integer' THEN 'BLOCK' ELSE 'MUTATE' END AS action FROM a FULL JOIN b ON a.name = b.name
""")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a wished schema asks of a table's own; narrowing a type loses data and is blocked."""
    names = {"long": "bigint", "string": "varchar", "integer": "integer", "double": "double"}
    fields = {f.name: names[f.dataType.typeName()] for f in table(spark, sf_dir, "customer").schema}
    own = spark.createDataFrame([(k, v) for k, v in fields.items() if k != "c_mktsegment"], "name string, held string")
    wished = spark.createDataFrame(
        [("c_custkey", "bigint", True), ("c_name", "varchar", True), ("c_phone", "varchar", True), ("c_acctbal", "integer", False)],
        "name string, kind string, required boolean",
    )
    action = (
        F.when(F.col("kind").isNull(), "KEEP").when(F.col("held").isNull() & F.col("required"), "ADD_APPROVE").when(F.col("held").isNull(), "ADD")
        .when(F.col("kind") == F.col("held"), "NONE").when((F.col("held") == "double") & (F.col("kind") == "integer"), "BLOCK").otherwise("MUTATE")
    )
    return wished.join(own, "name", "full_outer").select("name", action.alias("action"))
