"""Why pages changed between two crawls, by all that a page holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import markup, text, urls
from quern.functions.binding import bound
from quern.operators import diff
from quern.plans.extract import images_sql
from quern.plans.web import CONTENT_SQL, RICH, RICH_SQL, sql_normalize
from quern.registry import query
from quern.sources.tables import table

#: A fixture, the same text in Spark and DuckDB: the day of publication of a page, and the later
#: crawl, where some pages have a further image, lost one, or have another title, description, day or length.
_DAY = "'<meta property=\"article:published_time\" content=\"2024-01-' || (page_id % 20 + 10) || '\">'"
_LATER = f"""replace(replace(replace(html, CASE WHEN page_id % 6 = 0 THEN '<noscript><img src="/img/plain-' || page_id || '.jpg"></noscript>' ELSE '<no such tag>' END, ''),
 CASE WHEN page_id % 10 = 0 THEN '<title>' ELSE '<no such tag>' END, '<title>New: '), CASE WHEN page_id % 9 = 0 THEN 'About page' ELSE '<no such tag>' END, 'Of page')
 || CASE WHEN page_id % 4 = 0 THEN '<img src="/img/added.jpg">' ELSE '' END || CASE WHEN page_id % 11 = 0 THEN '<p>' || repeat('further words ', 200) || '</p>' ELSE '' END || CASE WHEN page_id % 13 = 0 THEN '' ELSE {_DAY} END"""

_SQL = rf"""
{RICH_SQL}, crawl AS (SELECT page_id * 2 AS page_id, url, html || {_DAY} AS html FROM pages_rich UNION ALL SELECT page_id * 2 + 1, url, {_LATER} FROM pages_rich WHERE page_id % 7 <> 0),
{images_sql("crawl")},
held AS (SELECT page_id, list(DISTINCT image) AS images FROM r WHERE image IS NOT NULL GROUP BY page_id),
node AS (SELECT page_id % 2 AS crawl, {sql_normalize('url')} AS norm_url, {CONTENT_SQL.format('html')} AS hash, coalesce(images, []) AS images,
  CAST(len(list_filter(string_split(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')), ' '), lambda w: w <> '')) AS BIGINT) AS words,
  regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(regexp_extract(html, '<meta [^>]*name="description"[^>]*>'), 'content="([^"]*)"', 1) AS about, regexp_extract(html, '<meta property="article:published_time" content="([^"]*)"', 1) AS day
  FROM crawl LEFT JOIN held USING (page_id) QUALIFY row_number() OVER (PARTITION BY page_id % 2, {sql_normalize('url')} ORDER BY page_id DESC) = 1),
g AS (SELECT b.norm_url, a.words AS old, b.words - a.words AS more_words, len(list_filter(b.images, lambda i: NOT list_contains(a.images, i))) AS images_added, len(list_filter(a.images, lambda i: NOT list_contains(b.images, i))) AS images_gone,
  a.title <> b.title AS retitled, a.about <> b.about OR a.day <> b.day AS told FROM node a JOIN node b ON a.norm_url = b.norm_url AND a.crawl = 0 AND b.crawl = 1 WHERE a.hash <> b.hash),
w AS (SELECT norm_url, more_words, images_added, images_gone, list_filter(['contentHashChanged', CASE WHEN retitled THEN 'titleChanged' END, CASE WHEN images_added + images_gone > 0 THEN 'imageSetChanged' END, CASE WHEN told THEN 'metadataChanged' END,
  CASE WHEN old > 0 AND abs(more_words) / old::DOUBLE > 0.1 THEN 'structureChanged' END], lambda x: x IS NOT NULL) AS reasons FROM g)
"""


def _manifest(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    told = lambda t: F.struct(markup.content_of(t, "description").alias("description"), markup.content_of(t, "article:published_time", "property").alias("published"))
    nodes = pages.select(
        "page_id", urls.normalize(F.col("url")).alias("norm_url"), text.content_hash(html).alias("hash"), F.regexp_extract(html, "<title>([^<]*)", 1).alias("title"),
        bound(markup.tags(html, "meta"), told).alias("told"), markup.image_urls(html, F.trim("url")).alias("images"), F.size(text.words(F.regexp_replace(html, "<[^>]+>", " "))).cast("long").alias("words"),
    )
    return diff.last_by_key(nodes, "norm_url", F.col("page_id")).select("*", "told.*").drop("page_id", "told")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(RICH).alias("html"))
    before = rich.withColumn("html", F.expr(f"html || {_DAY}"))
    after = rich.filter("page_id % 7 != 0").withColumn("html", F.expr(_LATER))
    return diff.page_changes(_manifest(before), _manifest(after), "norm_url")


@query(_SQL + "SELECT norm_url, array_to_string(reasons, ',') AS reasons, more_words, images_added, images_gone FROM w")
def page_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each changed page counts as changed: content, title, images, metadata, structure."""
    return _changes(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ","))


@query(_SQL + "SELECT reason, count(*) AS pages, count(*) FILTER (WHERE len(reasons) = 2) AS alone FROM (SELECT reasons, unnest(reasons) AS reason FROM w) GROUP BY reason")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by reason; alone: those with no other reason than their content."""
    each = _changes(spark, sf_dir).select(F.size("reasons").alias("n"), F.explode("reasons").alias("reason"))
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("n") == 2).alias("alone"))
