"""Queries of the merge planner over pages: endpoints and layouts. Parts stand in for a code base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import urls
from quern.operators import merge, planner
from quern.plans.merge import layout_assignments, route_patterns
from quern.plans.web import page_route, sql_route
from quern.registry import ORACLE, query
from quern.sources.tables import table

_OWN_SQL = r"regexp_replace(regexp_replace(regexp_replace(path, ':(\w+)', '[\1]', 'g'), '\[\[?\.{0,3}(\w+)\]?\]', '[\1]', 'g'), '/+$', '')"
_PIECES = "list_filter(string_split({}, '/'), lambda s: s <> '')"


@query(rf"""
WITH a AS (SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN '/api/en/:id' WHEN 1 THEN '/api/' || split_part(p_name, ' ', 1) || '/[slug]/' WHEN 2 THEN '/api/fr/' || p_partkey % 150 WHEN 3 THEN '/v' || p_size || '/' || split_part(p_name, ' ', 2)
  WHEN 4 THEN '/api/de/[[...rest]]' WHEN 5 THEN '/api/' || p_brand ELSE '/x-es-' || p_size END AS path FROM part),
o AS (SELECT id, path, {_OWN_SQL} AS own FROM a), p AS (SELECT DISTINCT {sql_route('url')} AS path FROM pages WHERE url IS NOT NULL),
w AS (SELECT DISTINCT '/api/' || array_to_string({_PIECES.format('path')}, '/') AS path FROM p WHERE NOT contains(path, '[') AND len({_PIECES.format('path')}) > 0), n AS (SELECT path, {_OWN_SQL} AS own FROM w),
c AS (SELECT DISTINCT o.own, n.path FROM (SELECT DISTINCT own FROM o) o JOIN n ON len({_PIECES.format('o.own')}) = len({_PIECES.format('n.own')})
  AND len(list_filter(list_zip({_PIECES.format('o.own')}, {_PIECES.format('n.own')}), lambda z: NOT (starts_with(z[1], '[') OR starts_with(z[2], '[') OR z[1] = z[2]))) = 0),
g AS (SELECT DISTINCT own, unnest({_PIECES.format('own')}) AS s FROM o), h AS (SELECT DISTINCT unnest({_PIECES.format('path')}) AS s FROM p),
t AS (SELECT DISTINCT own FROM g JOIN h ON g.s <> 'api' AND h.s <> 'api' AND (NOT starts_with(g.s, '[') AND contains(h.s, g.s) OR contains(g.s, h.s))),
k AS (SELECT id, path, own IN (SELECT own FROM c) OR own IN (SELECT own FROM t) AS serves FROM o)
SELECT id, path, 'IGNORE' AS action, CAST(CASE WHEN serves THEN 0.82 ELSE 0.95 END AS DOUBLE) AS confidence, serves FROM k
UNION ALL SELECT NULL, path, 'CREATE', 0.65, false FROM w WHERE path NOT IN (SELECT path FROM c)
""")
def needed_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which endpoints of a code base (paths from parts) serve the pages, and which are to be made."""
    k, name = F.col("p_partkey"), F.split("p_name", " ")
    say = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    path = (
        F.when(k % 7 == 0, "/api/en/:id").when(k % 7 == 1, say("/api/", F.get(name, 0), "/[slug]/")).when(k % 7 == 2, say("/api/fr/", (k % 150).cast("string")))
        .when(k % 7 == 3, say("/v", F.col("p_size").cast("string"), "/", F.coalesce(F.get(name, 1), F.lit("")))).when(k % 7 == 4, "/api/de/[[...rest]]")
        .when(k % 7 == 5, say("/api/", F.col("p_brand"))).otherwise(say("/x-es-", F.col("p_size").cast("string")))
    )
    apis = table(spark, sf_dir, "part").select(k.alias("id"), path.alias("path"))
    pages = table(spark, sf_dir, "pages").filter("url is not null").select(urls.route(F.col("url")).alias("path"))
    return planner.endpoint_matches(apis, pages)


_WORDS_SQL = ", ".join(f"('{k}', {list(v)}, {[s for s in planner.LAYOUT_SLOTS[k]] or ['x'][:0]}::VARCHAR[])" for k, v in planner.LAYOUT_WORDS.items())


@query(rf"""
WITH n AS (SELECT layout, count(*) AS pages FROM ({ORACLE['layout_assignments']}) GROUP BY layout), y(layout, words, needs) AS (VALUES {_WORDS_SQL}),
f AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'SingleArticle' WHEN 1 THEN 'hero-' || split_part(p_name, ' ', 1) WHEN 2 THEN 'DocumentationLayout' WHEN 3 THEN 'photo-' || split_part(p_name, ' ', 2) WHEN 4 THEN 'ListShell' ELSE p_name END AS name,
  ['header', 'footer', 'nav', 'sidebar'][1:p_size % 5] AS slots FROM part),
s AS (SELECT y.layout, id, name, slots, len(list_filter(words, lambda w: contains(lower(name), w))) + CASE WHEN lower(name) = lower(y.layout) THEN 5 ELSE 0 END + CASE WHEN ends_with(lower(name), replace(lower(y.layout), 'layout', '')) THEN 2 ELSE 0 END AS score FROM f, y),
b AS (SELECT layout, id, name, slots, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY layout ORDER BY score DESC, id) = 1),
d AS (SELECT n.layout, n.pages, id, name, score, CASE WHEN id IS NOT NULL THEN list_filter(needs, lambda x: NOT list_contains(slots, x)) END AS lacks FROM n JOIN y USING (layout) LEFT JOIN b USING (layout))
SELECT layout, pages, CASE WHEN id IS NULL THEN 'CREATE' WHEN len(lacks) = 0 THEN 'EXTEND' ELSE 'UPDATE' END AS action,
  CAST(CASE WHEN id IS NULL THEN 0.85 WHEN len(lacks) = 0 THEN CASE WHEN score >= 3 THEN 0.92 ELSE 0.75 END ELSE CASE WHEN score >= 3 THEN 0.8 ELSE 0.6 END END AS DOUBLE) AS confidence, id, name, score,
  array_to_string(list_transform(lacks, lambda x: CASE WHEN x = 'sidebar' THEN 'missing <aside/sidebar>' ELSE 'missing <' || x || '>' END), ', ') AS missing FROM d
UNION ALL SELECT NULL, NULL, 'ARCHIVE', 0.55, id, name, NULL, NULL FROM f WHERE id NOT IN (SELECT id FROM d WHERE id IS NOT NULL)
""")
def layout_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a code base's layouts (names and slots from parts) do for the layouts of pages."""
    k, name = F.col("p_partkey"), F.split("p_name", " ")
    made = (
        F.when(k % 6 == 0, "SingleArticle").when(k % 6 == 1, F.concat(F.lit("hero-"), F.get(name, 0))).when(k % 6 == 2, "DocumentationLayout")
        .when(k % 6 == 3, F.concat(F.lit("photo-"), F.coalesce(F.get(name, 1), F.lit("")))).when(k % 6 == 4, "ListShell").otherwise(F.col("p_name"))
    )
    slots = F.slice(F.array(*map(F.lit, ("header", "footer", "nav", "sidebar"))), F.lit(1), (F.col("p_size") % 5).cast("int"))
    found = table(spark, sf_dir, "part").select(k.alias("ord"), k.alias("id"), made.alias("name"), slots.alias("slots"))
    matched = planner.layout_matches(found, layout_assignments(spark, sf_dir).select("layout"))
    return matched.withColumn("missing", F.array_join("missing", ", "))


_MATCHED = ORACLE["route_matches"].rsplit("\nSELECT r.id", 1)[0]


@query(_MATCHED + """
SELECT ord, pattern, CASE WHEN ord % 5 = 0 THEN 'IGNORE' ELSE 'ARCHIVE' END AS action, CAST(CASE WHEN ord % 5 = 0 THEN 0.99 WHEN ord % 3 = 0 THEN 0.7 ELSE 0.6 END AS DOUBLE) AS confidence
FROM p WHERE ord NOT IN (SELECT ord FROM b)
""")
def unused_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of a code base that no page comes to; some are APIs, some orphans."""
    r = table(spark, sf_dir, "pages").select(page_route(F.col("url")).alias("route"), F.col("page_id").alias("id"))
    patterns = route_patterns(spark, r)
    routes = patterns.select("ord", "pattern", (F.col("ord") % 5 == 0).alias("api"), (F.col("ord") % 3 == 0).alias("orphan"))
    return planner.unused_routes(routes, merge.first_matches(r, patterns).select("b.ord"))
