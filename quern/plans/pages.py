"""Queries over the tree of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import markup, urls
from quern.operators import palette
from quern.operators.page_tree import attr, element_text, page_trees
from quern.plans.web import RICH_SQL, rich_pages, sql_authority, sql_host, sql_resolve, sql_route
from quern.registry import query
from quern.sources.tables import table

#: Pages with cards behind them, as the tables' own links stand in bare lists: nested and
#: unclosed containers, and links outside of any. A fixture: the same text in Spark and DuckDB.
CARDS = """html || '<section class="big card"><h2>Head</h2><img data-src="/t/' || page_id || '.jpg"><a href="/card/' || page_id || '">Card &amp; more</a><p>Too short</p></section>'
 || '<div><p class="x">A description of page ' || page_id || ' that is <b>long</b> enough.</p><ul><li><a href="/deep/' || page_id || '">deep</a><li><p>Not this one</p><a href="/second/' || page_id || '"><img src="/i/' || page_id || '.png"></a></ul>'
 || '<a href="/wide/' || page_id || '">wide</a></div></div><a href="/free/' || page_id || '">free</a><a href="/card/' || page_id || '">again</a><script>"<a href=\\'/no\\'>"</script><!-- <a href="/none">x</a> -->'
 || '<article><a href="/left/' || page_id || '">left</a><span class="summary">' || repeat('Words of a summary. ', 20) || '</span><img src="/left.png"><div><a href="/inner/' || page_id || '">inner</a>'"""
_CARDS_SQL = CARDS.replace("\\\\'", "''").replace("\\'", "''")


@query(rf"""
WITH p AS (SELECT page_id, trim(url) AS url, html, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hs, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS ts FROM pages),
l AS (SELECT page_id, url, unnest(range(len(hs))) AS pos, unnest(hs) AS href, replace(unnest(ts), '&amp;', '&') AS title, NULL AS image, NULL AS description FROM p
  UNION ALL SELECT page_id, url, 1000001, '/card/' || page_id, 'Card & more', '/t/' || page_id || '.jpg', NULL FROM p
  UNION ALL SELECT page_id, url, 1000002, '/deep/' || page_id, 'deep', NULL, NULL FROM p
  UNION ALL SELECT page_id, url, 1000003, '/second/' || page_id, '', '/i/' || page_id || '.png', NULL FROM p
  UNION ALL SELECT page_id, url, 1000004, '/wide/' || page_id, 'wide', '/i/' || page_id || '.png', 'A description of page ' || page_id || ' that is long enough.' FROM p
  UNION ALL SELECT page_id, url, 1000005, '/free/' || page_id, 'free', NULL, NULL FROM p
  UNION ALL SELECT page_id, url, 1000006, '/left/' || page_id, 'left', '/left.png', left(trim(repeat('Words of a summary. ', 20)), 200) FROM p
  UNION ALL SELECT page_id, url, 1000007, '/inner/' || page_id, 'inner', NULL, NULL FROM p),
m AS (SELECT page_id, url, pos, title, description, {sql_resolve('url', 'href')} AS link, CASE WHEN image IS NOT NULL THEN {sql_resolve('url', 'image')} END AS image FROM l)
SELECT page_id, link, left(coalesce(nullif(trim(title), ''), link), 200) AS title, description, image FROM m
WHERE {sql_authority('link')} = {sql_authority('url')} AND {sql_authority('url')} <> ''
  AND NOT regexp_matches({sql_route('link')}, '/(wp-admin|wp-json|wp-cron|xmlrpc\.php|feed|rss|atom|login|logout|signup|register|\.well-known)', 'i') AND NOT regexp_matches({sql_route('link')}, '{urls.NO_PAGE_EXTENSION}')
QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY pos) = 1
""")
def link_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page to pages of its host, each once, with the image and the description of
    the container around them: the nearest article, list item, division or card."""
    return cards(table(spark, sf_dir, "pages").select("page_id", "url", F.expr(CARDS).alias("html")))


def cards(pages: DataFrame) -> DataFrame:
    """(page_id, link, title, description, image) of (page_id, url, html)."""
    t = page_trees(pages.select("page_id", F.trim("url").alias("url"), "html"))
    element = lambda at: F.get("elements", at)  # noqa: E731  null for -1
    links = t.select("page_id", "url", "elements", "pieces", F.posexplode("elements").alias("pos", "a")).filter("a.name = 'a'")
    links = links.withColumns({"href": attr(F.col("a"), "href"), "box": element(F.col("a.box"))})
    links = links.withColumns({"image": element(F.col("box.image")), "about": element(F.col("box.about"))}).filter("href is not null")
    told = links.select(
        "page_id", "url", "pos", urls.resolve(F.col("url"), F.col("href")).alias("link"), element_text(F.col("pieces"), F.col("a")).alias("title"),
        urls.resolve(F.col("url"), attr(F.col("image"), "src", "data-src", "data-lazy-src")).alias("image"), F.when(F.col("about").isNotNull(), element_text(F.col("pieces"), F.col("about"))).alias("about"),
    )
    told = told.filter(urls.is_page_link(F.col("link"), urls.authority(F.col("url"))))
    once = told.groupBy("page_id", "link").agg(F.min_by(F.struct("title", "about", "image"), "pos").alias("c"))
    return once.select(
        "page_id", "link", F.left(F.coalesce(F.nullif("c.title", F.lit("")), "link"), F.lit(200)).alias("title"),
        F.when(F.length("c.about") > 20, F.left("c.about", F.lit(200))).alias("description"), "c.image",
    )


@query(rf"""
WITH e AS (SELECT page_id, regexp_extract_all(html, '<(li|div|article|nav|ul|footer|p)[ >]', 1) AS names, len(regexp_extract_all(html, '<li>')) AS items FROM pages)
SELECT page_id, CAST(len(list_filter(names, lambda n: n = 'p')) AS INTEGER) AS paragraphs, CAST(items AS INTEGER) AS items, CAST(1 AS INTEGER) AS articles FROM e
""")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paragraphs, list items and articles the tree of each page has."""
    t = page_trees(table(spark, sf_dir, "pages").select("page_id", "html"))
    n = lambda name: F.size(F.filter("elements", lambda e: e["name"] == name))
    return t.select("page_id", n("p").alias("paragraphs"), n("li").alias("items"), n("article").alias("articles"))


@query(rf"""{RICH_SQL}
SELECT page_id, 8 AS discovered, 0 AS data_uris, 0 AS invalid, 0 AS duplicates, 1 AS lazy, 1 AS srcset, 0 AS picture, 1 AS backgrounds, 1 AS noscript, 1 AS og, 8 AS final FROM pages_rich
""")
def image_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's images were found by and left out for."""
    return rich_pages(spark, sf_dir).select("page_id", markup.image_report(F.col("html"), F.trim("url")).alias("r")).select("page_id", "r.*")


@query(rf"""{RICH_SQL}
SELECT page_id, 3 AS total, CASE WHEN page_id % 8 = 7 THEN 1 ELSE 0 END AS no_canonical,
  CASE page_id % 8 WHEN 0 THEN 'native_video,unknown_audio,youtube' WHEN 1 THEN 'native_video,unknown_audio,vimeo' WHEN 2 THEN 'native_video,spotify,unknown_audio' WHEN 3 THEN 'loom,native_video,unknown_audio'
    WHEN 4 THEN 'dailymotion,native_video,unknown_audio' WHEN 5 THEN 'native_video,tiktok,unknown_audio' WHEN 6 THEN 'native_video,soundcloud,unknown_audio' ELSE 'native_video,unknown_audio,unknown_iframe' END AS providers,
  1 AS videos, 0 AS audios, CASE WHEN page_id % 8 IN (2, 6) THEN 0 ELSE 1 END AS frames, CASE WHEN page_id % 8 IN (2, 6) THEN 2 ELSE 1 END AS sounds,
  CASE WHEN page_id % 8 = 7 THEN 1 ELSE 0 END AS unsupported, 0 AS duplicates, 0 AS errors FROM pages_rich
""")
def embed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page embeds and by which providers."""
    r = rich_pages(spark, sf_dir).select("page_id", markup.embed_report(F.col("html"), F.trim("url")).alias("r")).select("page_id", "r.*")
    return r.withColumn("providers", F.array_join(F.array_sort(F.map_keys("by_provider")), ",")).drop("by_provider")


@query(rf"""
WITH c AS (SELECT {sql_host('url')} AS host, unnest(CASE page_id % 20 WHEN 7 THEN ['#ff2200'] ELSE [['#3366cc', '#fafafa', '#101010', '#778899'][page_id % 4 + 1], '#00aa77'] END) AS color FROM pages),
g AS (SELECT host, color, count(*) AS uses FROM c GROUP BY ALL), s AS (SELECT *, uses / sum(uses) OVER (PARTITION BY host)::DOUBLE AS share FROM g)
SELECT host, color, uses, CASE color WHEN '#fafafa' THEN 'background' WHEN '#101010' THEN 'text' WHEN '#3366cc' THEN CASE WHEN share >= 0.1 THEN 'primary' ELSE 'secondary' END
  WHEN '#778899' THEN CASE WHEN share >= 0.1 THEN 'primary' ELSE 'secondary' END ELSE CASE WHEN share < 0.05 THEN 'accent' WHEN share >= 0.1 THEN 'primary' ELSE 'secondary' END END AS role FROM s
""")
def site_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of a site by the share of its uses: primary from a tenth on, accents are rare."""
    own = F.get(F.array(*map(F.lit, ("#3366cc", "#fafafa", "#101010", "#778899"))), (F.col("page_id") % 4).cast("int"))
    styles = F.when(F.col("page_id") % 20 == 7, F.lit("color:#FF2200")).otherwise(F.concat(F.lit("color:"), own, F.lit(";border-color:#00AA77")))
    css = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), F.concat(F.lit('<i style="'), styles, F.lit('"></i>')).alias("html"))
    colors = css.select("host", F.explode(markup.css_colors(F.col("html"))).alias("color"))
    return palette.roles(colors, "host")
