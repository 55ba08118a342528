"""Queries that validate sites. A page is a node; what the tables lack (parents by id, assets'
state, layouts' confidence) follows from its URL, its text and its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text, urls
from quern.operators import validator
from quern.plans.scoring import WORDS_SQL
from quern.plans.web import sql_host, sql_route
from quern.registry import query
from quern.sources.tables import table

NODES_SQL = f"""WITH g AS (SELECT page_id, {sql_host('url')} AS site, lower({sql_route('url')}) AS route, url, list_filter(string_split({sql_route('url')}, '/'), lambda s: s <> '') AS parts, {WORDS_SQL} AS words FROM pages WHERE url IS NOT NULL),
n AS (SELECT *, len(parts) AS depth, CASE WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts) - 1], '/') WHEN len(parts) = 1 THEN '' END AS parent, array_to_string(parts, '/') AS node, page_id % 11 <> 0 AS content FROM g),
o AS (SELECT n.*, p.node IS NULL AND n.depth > 0 AS orphan FROM n LEFT JOIN (SELECT DISTINCT site, node FROM n) p ON p.site = n.site AND p.node = n.parent),
m AS (SELECT site, count(*) AS nodes, count(*) FILTER (WHERE content) AS content, count(*) FILTER (WHERE content AND page_id % 17 > 0) AS routed, count(*) FILTER (WHERE content AND page_id % 17 > 0 AND regexp_matches(route, '[^a-z0-9_/-]')) AS unsafe,
  count(*) FILTER (WHERE depth = 0) AS fallback, count(*) FILTER (WHERE orphan) AS orphans, count(*) FILTER (WHERE depth = 1) AS primary_items, count(*) FILTER (WHERE words < 50) AS minimal,
  count(*) FILTER (WHERE content AND depth < 2) AS uncategorized, count(*) FILTER (WHERE words < 100) AS unsure_kinds FROM o GROUP BY site),
c AS (SELECT site, sum(k - 1) AS collisions FROM (SELECT site, route, count(*) AS k FROM n WHERE content AND page_id % 17 > 0 GROUP BY ALL HAVING k > 1) GROUP BY site),
d AS (SELECT site, count(*) AS duplicate_paths FROM (SELECT site, regexp_replace(lower(url), '/$', '') AS u, count(*) AS k FROM n GROUP BY ALL HAVING k > 1) GROUP BY site),
a AS (SELECT site, count(*) AS assets, count(*) FILTER (WHERE page_id % 6 = 0) AS missing, count(*) FILTER (WHERE page_id % 9 = 0) AS orphan_assets, count(*) FILTER (WHERE page_id % 8 = 0) AS unbound FROM n GROUP BY site),
da AS (SELECT site, count(*) AS duplicate_assets FROM (SELECT site, words % 40 AS w, count(*) AS k FROM n GROUP BY ALL HAVING k > 1) GROUP BY site),
x AS (SELECT m.*, coalesce(collisions, 0) AS collisions, coalesce(duplicate_paths, 0) AS duplicate_paths, assets, missing, orphan_assets, unbound, coalesce(duplicate_assets, 0) AS duplicate_assets FROM m LEFT JOIN c USING (site) LEFT JOIN d USING (site) JOIN a USING (site) LEFT JOIN da USING (site)),
i AS (
  SELECT site, 'routes' AS section, 'warning' AS severity, 'ROUTE_COLLISIONS' AS code, collisions AS n FROM x WHERE collisions > 0
  UNION ALL SELECT site, 'routes', 'error', 'MISSING_ROUTES', content - routed FROM x WHERE routed < content
  UNION ALL SELECT site, 'routes', 'warning', 'UNSAFE_ROUTE_CHARS', unsafe FROM x WHERE unsafe > 0
  UNION ALL SELECT site, 'routes', 'warning', 'FALLBACK_ROUTES', fallback FROM x WHERE fallback > 0
  UNION ALL SELECT site, 'navigation', CASE WHEN 2 * orphans > nodes THEN 'error' ELSE 'warning' END, CASE WHEN 2 * orphans > nodes THEN 'HIGH_ORPHAN_RATIO' ELSE 'ELEVATED_ORPHAN_COUNT' END, orphans FROM x WHERE 5 * orphans > nodes
  UNION ALL SELECT site, 'navigation', 'error', 'BROKEN_PARENT_REFS', orphans FROM x WHERE orphans > 0
  UNION ALL SELECT site, 'navigation', 'warning', 'DUPLICATE_PATHS', duplicate_paths FROM x WHERE duplicate_paths > 0
  UNION ALL SELECT site, 'navigation', 'warning', 'EMPTY_PRIMARY_NAV', nodes FROM x WHERE primary_items = 0 AND nodes > 5
  UNION ALL SELECT site, 'assets', CASE WHEN 10 * missing > 3 * assets THEN 'error' ELSE 'warning' END, CASE WHEN 10 * missing > 3 * assets THEN 'HIGH_MISSING_ASSET_RATIO' ELSE 'MISSING_ASSETS' END, missing FROM x WHERE missing > 0
  UNION ALL SELECT site, 'assets', 'warning', 'DUPLICATE_ASSETS', duplicate_assets FROM x WHERE duplicate_assets > 0
  UNION ALL SELECT site, 'assets', 'warning', 'ORPHAN_ASSETS', orphan_assets FROM x WHERE orphan_assets > 0
  UNION ALL SELECT site, 'assets', 'warning', 'UNRESOLVED_BINDINGS', unbound FROM x WHERE unbound > 0
  UNION ALL SELECT site, 'layouts', 'warning', 'EXCESSIVE_MINIMAL_LAYOUTS', minimal FROM x WHERE 10 * minimal > 3 * content
  UNION ALL SELECT site, 'categories', 'warning', 'HIGH_UNCATEGORIZED_RATIO', uncategorized FROM x WHERE content > 0 AND 2 * uncategorized > content
  UNION ALL SELECT site, 'classification', 'warning', 'LOW_CLASSIFICATION_CONFIDENCE', unsure_kinds FROM x WHERE 10 * unsure_kinds > 4 * content)
"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").filter("url is not null")
    route, k = urls.route(F.col("url")), F.col("page_id")
    g = p.select("page_id", urls.host(F.col("url")).alias("site"), "url", F.lower(route).alias("path"), urls.segments(route).alias("parts"), F.size(text.words(F.regexp_replace("html", "<[^>]+>", " "))).alias("words"))
    depth = F.size("parts")
    kind = F.when(k % 11 != 0, "ARTICLE")
    nodes = g.select(
        "site", F.array_join("parts", "/").alias("node"), F.when(depth > 0, F.array_join(F.slice("parts", F.lit(1), F.greatest(depth - 1, F.lit(0))), "/")).alias("parent"), depth.alias("depth"), "url", (k % 11 != 0).alias("content"),
        F.when(k % 17 > 0, F.col("path")).alias("route"), F.when(depth == 0, "node_id_fallback").otherwise("url").alias("source"), F.when(F.col("words") < 50, "MinimalLayout").otherwise("ArticleLayout").alias("layout"),
        F.lit(0.75).alias("layout_confidence"), F.when(depth >= 2, F.get("parts", 0)).alias("category"), kind.alias("kind"), F.when(F.col("words") < 100, 0.2).otherwise(0.8).alias("kind_confidence"),
    )
    assets = g.select("site", (F.col("words") % 40).alias("checksum"), (k % 6 == 0).alias("missing"), F.when(k % 9 == 0, 0).otherwise(1).alias("uses"), (k % 8 != 0).alias("bound"))
    categories = nodes.filter("category is not null").groupBy("site", "category").agg(F.count(F.lit(1)).alias("pages"))
    return validator.measures(nodes, assets, categories)


@query(NODES_SQL + "SELECT site, section, severity, code, CAST(n AS BIGINT) AS n FROM i")
def site_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded issues of each site."""
    return validator.issues(measured(spark, sf_dir))


@query(NODES_SQL + """SELECT m.site, CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 'FAIL' WHEN count(section) > 0 THEN 'PARTIAL_PASS' ELSE 'PASS' END AS grade,
  count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, max(m.content) > 0 AND count(*) FILTER (WHERE severity = 'error' AND section IN ('routes', 'layouts', 'classification')) = 0 AS renderable
  FROM m LEFT JOIN i USING (site) GROUP BY m.site""")
def site_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade of each site, and whether it can be rendered."""
    return validator.report(measured(spark, sf_dir)).drop("grades")
