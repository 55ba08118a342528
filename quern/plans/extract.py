"""Queries over what pages hold: images, embeds, resources, structured data, audits, frameworks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import markup, text, urls
from quern.operators import frameworks
from quern.plans.web import LINKS_SQL, RICH_SQL, rich_pages, sql_normalize, sql_resolve
from quern.registry import query
from quern.sources.tables import table

BEST_SQL = """list_sort(list_transform(list_filter(list_transform(string_split({0}, ','), lambda p: trim(p)), lambda p: p <> ''), lambda p, i:
  {{'w': coalesce(try_cast(nullif(regexp_extract(p, ' ([0-9]+)w$', 1), '') AS INTEGER), -1), 'd': coalesce(try_cast(nullif(regexp_extract(p, ' ([0-9.]+)x$', 1), '') AS DOUBLE), -1.0), 'i': -i, 'u': split_part(p, ' ', 1)}}), 'DESC')[1].u"""


@query(rf"""
{RICH_SQL}, s AS (SELECT page_id, unnest(regexp_extract_all(html, 'srcset="([^"]*)"', 1)) || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN ', /dense.jpg 3x' ELSE ', /wide.jpg 900w' END AS srcset FROM pages_rich)
SELECT page_id, srcset, {BEST_SQL.format('srcset')} AS best FROM s
""")
def srcset_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best image of each srcset: the widest, else the densest, else the first."""
    more = F.get(F.array(F.lit(""), F.lit(", /dense.jpg 3x"), F.lit(", /wide.jpg 900w")), (F.col("page_id") % 3).cast("int"))
    s = rich_pages(spark, sf_dir).select("page_id", F.explode(markup.values(F.col("html"), "img", "srcset")).alias("s")).select("page_id", F.concat("s", more).alias("srcset"))
    return s.withColumn("best", markup.best_of_srcset(F.col("srcset")))


def images_sql(source: str) -> str:
    """CTEs c and r (page_id, o, method, image): the images of pages (page_id, url, html) and what finds them, first methods first."""
    return rf"""c AS (
  SELECT page_id, url, 1 AS o, 0 AS i, unnest(regexp_extract_all(html, '<meta property="og:image" content="([^"]*)"', 1)[1:1]) AS raw, 'og_meta' AS method FROM {source}
  UNION ALL SELECT page_id, url, 3, 0, unnest(regexp_extract_all(html, '<link rel="preload" href="([^"]*)" as="image"', 1)), 'link_preload' FROM {source}
  UNION ALL SELECT page_id, url, 4, 0, unnest(regexp_extract_all(html, '<noscript><img src="([^"]*)"', 1)), 'noscript_src' FROM {source}
  UNION ALL SELECT page_id, url, 8, 0, unnest(regexp_extract_all(html, '<video [^>]*poster="([^"]*)"', 1)), 'video_poster' FROM {source}
  UNION ALL SELECT page_id, url, 9, 0, unnest(regexp_extract_all(html, '<img [^>]*data-src="([^"]*)"', 1)), 'lazy' FROM {source}
  UNION ALL SELECT page_id, url, 10, 0, unnest(list_filter(regexp_extract_all(replace(html, '<noscript><img', ''), '<img (?:[^>]* )?src="([^"]*)"', 1), lambda u: NOT starts_with(u, 'data:') AND NOT contains(u, 'spacer'))), 'src' FROM {source}
  UNION ALL SELECT page_id, url, 11, 0, {BEST_SQL.format("unnest(regexp_extract_all(html, 'srcset=\"([^\"]*)\"', 1))")}, 'srcset_best' FROM {source}
  UNION ALL SELECT page_id, url, 12, 0, unnest(regexp_extract_all(html, 'background-image:url[(]([^)]*)[)]', 1)), 'css_background_inline' FROM {source}
), r AS (SELECT page_id, o, method, {sql_normalize(sql_resolve('trim(url)', 'raw'), False)} AS image FROM c)"""


@query(f"""
{RICH_SQL}, {images_sql('pages_rich')}
SELECT page_id, image, arg_min(method, o) AS method FROM r GROUP BY page_id, image
""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rich_pages(spark, sf_dir).select("page_id", F.explode(markup.images(F.col("html"), F.trim("url"))).alias("i"))
    return found.select("page_id", F.col("i.url").alias("image"), "i.method")


@query(rf"""
{RICH_SQL}, e AS (
  SELECT page_id, {sql_resolve('trim(url)', "unnest(regexp_extract_all(html, '<video src=\"([^\"]*)\"', 1))")} AS embed, 'native_video' AS provider, 'video' AS media FROM pages_rich
  UNION ALL SELECT page_id, {sql_resolve('trim(url)', "unnest(regexp_extract_all(html, 'href=\"([^\"]*[.]mp3)\"', 1))")}, 'unknown_audio', 'audio' FROM pages_rich
  UNION ALL SELECT page_id, {sql_resolve('trim(url)', "unnest(regexp_extract_all(html, '<iframe (?:data-)?src=\"([^\"]*)\"', 1))")}, NULL, NULL FROM pages_rich
)
SELECT page_id, embed, coalesce(provider, CASE page_id % 8 WHEN 0 THEN 'youtube' WHEN 1 THEN 'vimeo' WHEN 2 THEN 'spotify' WHEN 3 THEN 'loom' WHEN 4 THEN 'dailymotion' WHEN 5 THEN 'tiktok' WHEN 6 THEN 'soundcloud' ELSE 'unknown_iframe' END) AS provider,
  coalesce(media, CASE WHEN page_id % 8 IN (2, 6) THEN 'audio' ELSE 'embed' END) AS media,
  CASE WHEN provider IS NOT NULL OR page_id % 8 = 6 THEN embed ELSE CASE page_id % 8 WHEN 0 THEN 'https://www.youtube.com/watch?v=abcdefghijk' WHEN 1 THEN 'https://vimeo.com/1234' WHEN 2 THEN 'https://open.spotify.com/track/9z'
    WHEN 3 THEN 'https://www.loom.com/share/af09' WHEN 4 THEN 'https://www.dailymotion.com/video/x8' WHEN 5 THEN 'https://www.tiktok.com/video/77' END END AS canonical FROM e
""")
def embed_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rich_pages(spark, sf_dir).select("page_id", F.explode(markup.embeds(F.col("html"), F.trim("url"))).alias("e"))
    return found.select("page_id", F.col("e.url").alias("embed"), "e.provider", "e.media", "e.canonical")


@query(rf"""
{RICH_SQL}, r AS (
  SELECT page_id, url, 1 AS o, 'style' AS kind, unnest(regexp_extract_all(html, '<link rel="stylesheet" href="([^"]*)"', 1)) AS raw FROM pages_rich
  UNION ALL SELECT page_id, url, 2, 'preload', unnest(regexp_extract_all(html, '<link rel="preload" href="([^"]*)" as=', 1)) FROM pages_rich
  UNION ALL SELECT page_id, url, 3, 'script', unnest(regexp_extract_all(html, '<script src="([^"]*)"', 1)) FROM pages_rich
  UNION ALL SELECT page_id, url, 4, 'image', unnest(regexp_extract_all(html, '<img [^>]*src="([^"]*)"', 1)) FROM pages_rich
  UNION ALL SELECT page_id, url, 5, 'srcset', unnest(['/s.jpg', '/l.jpg', '/m.jpg']) FROM pages_rich
  UNION ALL SELECT page_id, url, 7, 'css', unnest(regexp_extract_all(html, 'url[(]([^)]*)[)]', 1)) FROM pages_rich
  UNION ALL SELECT page_id, url, 10, 'media', unnest(regexp_extract_all(html, '<video src="([^"]*)"', 1)) FROM pages_rich
), m AS (SELECT page_id, o, kind, {sql_resolve('trim(url)', 'raw')} AS resource FROM r), k AS (SELECT page_id, resource, arg_min(kind, o) AS kind FROM m GROUP BY 1, 2)
SELECT kind, count(*) AS n, count(DISTINCT resource) AS resources FROM k GROUP BY kind
""")
def page_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rich_pages(spark, sf_dir).select(F.explode(markup.resources(F.col("html"), F.trim("url"))).alias("r"))
    return found.groupBy(F.col("r.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("r.url").alias("resources"))


@query(f"""
{RICH_SQL} SELECT CASE page_id % 4 WHEN 0 THEN 'Article' WHEN 1 THEN 'FAQPage' ELSE 'ParseError' END AS type, count(*) AS items, CAST(sum(CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid,
  count(DISTINCT page_id) AS pages FROM pages_rich WHERE page_id % 4 < 3 GROUP BY 1
""")
def structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD of the site by type: how many entries, how many of them valid, on how many pages."""
    items = rich_pages(spark, sf_dir).select("page_id", F.explode(markup.structured_data(F.col("html"))).alias("d"))
    return items.groupBy(F.col("d.type").alias("type")).agg(F.count(F.lit(1)).alias("items"), F.count_if("d.valid").alias("valid"), F.countDistinct("page_id").alias("pages"))


@query(rf"""
{LINKS_SQL}, n AS (SELECT page_id, min(link) FILTER (WHERE href LIKE 'list/%') AS next_page FROM made GROUP BY page_id)
SELECT page_id, next_page FROM n
""")
def next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next page of the list that a page belongs to."""
    return rich_pages(spark, sf_dir).select("page_id", markup.next_page(F.col("html"), F.trim("url")).alias("next_page"))


def seo(pages: DataFrame) -> DataFrame:
    """Title, description, canonical, robots, language and issues of (page_id, url, html)."""
    html = F.col("html")
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    metas = F.col("_metas")
    linked = F.get(F.filter(markup.tags(html, "link"), lambda t: F.lower(markup.attribute(t, "rel")) == "canonical"), 0)
    pages = pages.withColumn("_metas", markup.tags(html, "meta")).select(
        "page_id", "url", title.alias("title"), markup.content_of(metas, "description").alias("description"), markup.attribute(linked, "href").alias("canonical"),
        F.coalesce(markup.content_of(metas, "robots"), F.lit("")).alias("robots"), markup.attribute(F.get(markup.tags(html, "html"), 0), "lang").alias("lang"),
        markup.headings(html).alias("levels"), F.size(F.filter(markup.tags(html, "img"), lambda t: (F.coalesce(markup.attribute(t, "src"), markup.attribute(t, "data-src"), F.lit("")) != "") & markup.attribute(t, "alt").isNull())).alias("no_alt"),
        *(markup.content_of(metas, n, k).alias(c) for n, k, c in (("og:title", "property", "og_title"), ("og:description", "property", "og_description"), ("og:image", "property", "og_image"), ("twitter:card", "name", "card"), ("viewport", "name", "viewport"))),
        F.size(markup.structured_data(html)).alias("items"),
    )
    h1 = F.size(F.filter("levels", lambda x: x == 1))
    jumps = F.exists(F.sequence(F.lit(1), F.greatest(F.size("levels") - 1, F.lit(1))), lambda i: F.coalesce(F.get("levels", i) > F.get("levels", i - 1) + 1, F.lit(False)))
    about = F.length("description")
    issues = (
        F.when(F.col("title") == "", "MISSING_TITLE").when(F.length("title") < 10, "TITLE_TOO_SHORT").when(F.length("title") > 60, "TITLE_TOO_LONG"),
        F.when(about.isNull(), "MISSING_META_DESCRIPTION").when(about < 50, "DESCRIPTION_TOO_SHORT").when(about > 160, "DESCRIPTION_TOO_LONG"),
        F.when(F.col("canonical").isNull(), "MISSING_CANONICAL").when(F.col("canonical") != F.trim("url"), "CANONICAL_MISMATCH"),
        F.when(F.col("og_title").isNull(), "MISSING_OG_TITLE"), F.when(F.col("og_description").isNull(), "MISSING_OG_DESCRIPTION"), F.when(F.col("og_image").isNull(), "MISSING_OG_IMAGE"),
        F.when(F.col("card").isNull(), "MISSING_TWITTER_CARD"), F.when(F.col("viewport").isNull(), "MISSING_VIEWPORT"), F.when(F.col("lang").isNull(), "MISSING_LANG"),
        F.when(h1 == 0, "MISSING_H1").when(h1 > 1, "MULTIPLE_H1"), F.when(jumps, "HEADING_HIERARCHY"), F.when(F.col("no_alt") > 0, "IMAGES_MISSING_ALT"),
        F.when(F.col("items") == 0, "NO_STRUCTURED_DATA"),
    )
    indexable = ~(F.contains("robots", F.lit("noindex")) | F.contains("robots", F.lit("none")))
    return pages.withColumns({"indexable": indexable, "issues": F.array_compact(F.array(*issues))})


SEO_SQL = rf"""{RICH_SQL}, t AS (SELECT page_id, html, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract_all(html, '<h([1-6])[ >]', 1) AS hs FROM pages_rich),
i AS (SELECT page_id, unnest(list_filter([CASE WHEN title = '' THEN 'MISSING_TITLE' WHEN length(title) < 10 THEN 'TITLE_TOO_SHORT' WHEN length(title) > 60 THEN 'TITLE_TOO_LONG' END,
  'MISSING_OG_TITLE', 'MISSING_OG_DESCRIPTION', 'MISSING_VIEWPORT', 'IMAGES_MISSING_ALT', CASE WHEN NOT contains(html, '<html lang="') THEN 'MISSING_LANG' END,
  CASE len(list_filter(hs, lambda h: h = '1')) WHEN 0 THEN 'MISSING_H1' WHEN 1 THEN NULL ELSE 'MULTIPLE_H1' END,
  CASE WHEN len(list_filter(range(2, len(hs) + 1), lambda k: CAST(hs[k] AS INTEGER) > CAST(hs[k - 1] AS INTEGER) + 1)) > 0 THEN 'HEADING_HIERARCHY' END,
  CASE WHEN page_id % 4 = 3 THEN 'NO_STRUCTURED_DATA' END], lambda x: x IS NOT NULL)) AS code FROM t)"""


@query(SEO_SQL + " SELECT code, count(*) AS pages FROM i GROUP BY code")
def seo_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages have each issue."""
    return seo(rich_pages(spark, sf_dir)).select(F.explode("issues").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("pages"))


#: Severities of issues other than warnings.
CRITICAL = ("MISSING_TITLE", "MISSING_META_DESCRIPTION", "MISSING_H1")
NOTES = ("MISSING_TWITTER_CARD", "NO_STRUCTURED_DATA")


@query(SEO_SQL + rf""", h AS (SELECT page_id, lower(regexp_extract(trim(url), '://([^/?#@]*@)?([^/?#:]*)', 2)) AS host FROM pages),
c AS (SELECT host, count(*) FILTER (WHERE code IN ('MISSING_TITLE', 'MISSING_META_DESCRIPTION', 'MISSING_H1')) AS critical, count(*) FILTER (WHERE code NOT IN ('MISSING_TITLE', 'MISSING_META_DESCRIPTION', 'MISSING_H1', 'MISSING_TWITTER_CARD', 'NO_STRUCTURED_DATA')) AS warnings
  FROM i JOIN h USING (page_id) GROUP BY host),
d AS (SELECT host, count(*) FILTER (WHERE n > 1) AS titles FROM (SELECT host, title, count(*) AS n FROM t JOIN h USING (page_id) WHERE title <> '' GROUP BY 1, 2) GROUP BY host),
p AS (SELECT host, count(*) AS pages, count(*) * 3 AS no_alt FROM h GROUP BY host)
SELECT host, pages, critical, warnings, coalesce(titles, 0) AS duplicate_titles, greatest(0, least(100, 100 - critical * 15 - warnings * 5 - coalesce(titles, 0) * 8 - least(no_alt * 2, 20))) AS score
FROM p JOIN c USING (host) LEFT JOIN d USING (host)""")
def seo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's score: 100 less its issues, titles and descriptions that several pages share,
    and images without a text."""
    p = seo(rich_pages(spark, sf_dir)).withColumn("host", urls.host(F.col("url")))
    code = lambda codes: F.size(F.filter("issues", lambda i: i.isin(*codes)))
    per = p.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(code(CRITICAL)).alias("critical"), F.sum(F.size("issues") - code(CRITICAL + NOTES)).alias("warnings"), F.sum("no_alt").alias("no_alt")
    )

    def shared(c: str) -> DataFrame:
        per_value = p.filter(F.col(c) != "").groupBy("host", c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return per_value.groupBy("host").agg(F.count(F.lit(1)).alias(f"same_{c}"))

    per = per.join(shared("title"), "host", "left").join(shared("description"), "host", "left").na.fill(0, ["same_title", "same_description"])
    loss = F.col("critical") * 15 + F.col("warnings") * 5 + F.col("same_title") * 8 + F.col("same_description") * 5 + F.least(F.col("no_alt") * 2, F.lit(20))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - loss)).cast("long")
    return per.select("host", "pages", "critical", "warnings", F.col("same_title").alias("duplicate_titles"), score.alias("score"))


@query(f"""
{RICH_SQL}, s AS (SELECT page_id, page_id % 7 AS k, page_id % 5 AS h FROM pages_rich),
v AS (SELECT page_id, CASE k WHEN 0 THEN 90 + 65 + 20 + 30 ELSE 0 END AS wordpress, CASE k WHEN 1 THEN 85 + 65 + 60 ELSE 0 END + CASE WHEN h = 3 THEN 35 ELSE 0 END AS nextjs,
  CASE k WHEN 2 THEN 90 + 65 + 40 ELSE 0 END AS astro, CASE k WHEN 3 THEN 55 + 35 WHEN 5 THEN 30 ELSE 0 END AS react, CASE WHEN h = 0 THEN 90 ELSE 0 END AS express,
  CASE WHEN h = 1 THEN 85 + 30 ELSE 0 END + CASE WHEN k = 4 THEN 30 ELSE 0 END + CASE WHEN h = 2 AND k = 4 THEN 15 ELSE 0 END AS laravel FROM s),
b AS (SELECT *, list_sort([{{'s': wordpress, 'o': -1, 'n': 'wordpress'}}, {{'s': nextjs, 'o': -2, 'n': 'nextjs'}}, {{'s': astro, 'o': -3, 'n': 'astro'}}, {{'s': react, 'o': -4, 'n': 'react'}}, {{'s': express, 'o': -5, 'n': 'express'}}, {{'s': laravel, 'o': -6, 'n': 'laravel'}}], 'DESC') AS l FROM v)
SELECT page_id, CASE WHEN l[1].s >= 30 THEN l[1].n ELSE 'unknown' END AS framework, CAST(l[1].s AS INTEGER) AS score,
  CASE WHEN l[1].s >= 30 THEN round(least(1, l[1].s / CASE l[1].n WHEN 'wordpress' THEN 395 WHEN 'nextjs' THEN 335 WHEN 'astro' THEN 335 WHEN 'react' THEN 165 WHEN 'express' THEN 90 ELSE 255 END), 3) ELSE 0.0 END AS confidence,
  array_to_string(list_transform(list_filter(l[2:6], lambda x: x.s >= 30), lambda x: x.n), ',') AS others FROM b
""")
def framework_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page was made with, from its HTML and (by page number, as the tables hold none)
    response headers."""
    kind = F.col("page_id") % 5
    pages = rich_pages(spark, sf_dir).withColumns(
        {
            "powered_by": F.when(kind == 0, "Express").when(kind == 2, "PHP/8.2"),
            "set_cookie": F.when(kind == 1, "laravel_session=1; Expires=Thu, 18 Jun 2026; path=/, XSRF-TOKEN=2; path=/"),
            "header_names": F.when(kind == 3, F.array(F.lit("x-next-cache"))),
        }
    )
    pages = pages.withColumn("jar", markup.cookies(F.col("set_cookie")))
    found = frameworks.fingerprint(pages, F.col("html"), powered_by=F.col("powered_by"), cookies=F.col("jar"), header_names=F.col("header_names"))
    return found.select("page_id", F.col("found.framework").alias("framework"), "found.score", "found.confidence", F.array_join("found.others", ",").alias("others"))


@query(rf"""
{RICH_SQL}, c AS (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '#([0-9a-fA-F]{{6}})\b'), lambda x: lower(x))) AS color FROM pages_rich)
SELECT color, count(*) AS uses, count(DISTINCT page_id) AS pages FROM c GROUP BY color
""")
def css_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rich_pages(spark, sf_dir).select("page_id", F.explode(markup.css_colors(F.col("html"))).alias("color")).filter("length(color) = 7")
    return c.groupBy("color").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("page_id").alias("pages"))


@query(rf"""
{RICH_SQL} SELECT page_id, coalesce(regexp_extract(html, '<meta name="generator" content="([^"]*)"', 1), '') AS generator,
  CAST(len(list_distinct(regexp_extract_all(html, '<meta name="([^"]*)"', 1))) AS INTEGER) AS names,
  CAST(len(string_split(trim(regexp_replace(html, '<[^>]+>', '', 'g')), ' ')) AS INTEGER) AS pieces FROM pages_rich
""")
def meta_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named meta tags of each page; of a repeated name the last counts."""
    m = rich_pages(spark, sf_dir).select("page_id", "html", markup.meta_tags(F.col("html")).alias("m"))
    return m.select(
        "page_id", F.coalesce(F.try_element_at("m", F.lit("generator")), F.lit("")).alias("generator"), F.size("m").alias("names"),
        F.size(F.split(text.strip_tags(F.col("html")), " ")).alias("pieces"),
    )


_FILES = (
    ("package.json", '{"dependencies": {"next": "15", "react": "19", "react-dom": "19"}}'), ("pages/_app.tsx", "x"), ("astro.config.mjs", None), ("src/pages/a.astro", ""),
    ("server/index.js", "const app = express()"), ("routes/web.php", ""), ("artisan", ""), ("wp-config.php", ""), ("style.css", "/* Theme Name: T */"),
)


@query("""
WITH f AS (SELECT p_partkey % 40 AS base, p_partkey // 40 % 9 AS k FROM part), h AS (SELECT base, max(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS b, max(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS c, max(CASE WHEN k = 3 THEN 1 ELSE 0 END) AS d, max(CASE WHEN k = 4 THEN 1 ELSE 0 END) AS e,
  max(CASE WHEN k = 5 THEN 1 ELSE 0 END) AS f, max(CASE WHEN k = 6 THEN 1 ELSE 0 END) AS g, max(CASE WHEN k = 7 THEN 1 ELSE 0 END) AS h, max(CASE WHEN k = 8 THEN 1 ELSE 0 END) AS i FROM f GROUP BY base),
s AS (SELECT base, list_sort([{'s': 60 * a + 20 * b, 'o': 0, 'n': 'nextjs', 'm': 115}, {'s': 30 * a + 10 * b, 'o': -1, 'n': 'react', 'm': 80}, {'s': 20 * c + 20 * d, 'o': -2, 'n': 'astro', 'm': 100}, {'s': 20 * e + 10 * f, 'o': -3, 'n': 'express', 'm': 80}, {'s': 20 * g + 15 * f, 'o': -4, 'n': 'laravel', 'm': 125}, {'s': 60 * h + 20 * i, 'o': -5, 'n': 'wordpress', 'm': 160}], 'DESC') AS l FROM h)
SELECT base, CASE WHEN l[1].s >= 20 THEN l[1].n ELSE 'unknown' END AS framework, l[1].s AS score, CASE WHEN l[1].s >= 20 THEN round(l[1].s / l[1].m::DOUBLE, 3) ELSE 0.0 END AS confidence, array_to_string(list_transform(list_filter(l[2:6], lambda x: x.s >= 20), lambda x: x.n), ',') AS others FROM s
""")
def codebase_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The framework of each code base; files are a fixture, dealt to bases by part keys."""
    k = F.col("p_partkey")
    files = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(c).cast("string").alias("content")) for p, c in _FILES))
    f = table(spark, sf_dir, "part").select((k % 40).alias("base"), F.get(files, (F.floor(k / 40) % 9).cast("int")).alias("f")).select("base", "f.*")
    return frameworks.detect_codebase(f).withColumn("others", F.array_join("others", ","))


@query("""
WITH e AS (SELECT s_suppkey AS id, ['react', 'nextjs', 'laravel', 'other'][s_suppkey % 4 + 1] AS fw, [NULL, 'sqlite', 'postgres', 'oracle'][s_suppkey // 4 % 4 + 1] AS db, [NULL, 'r2', 's3'][s_suppkey % 3 + 1] AS st, ['cloudflare', 'own-host'][s_suppkey % 2 + 1] AS target, s_suppkey % 3 AS missing, ['high', 'medium', 'low'][s_suppkey // 2 % 3 + 1] AS conf FROM supplier),
s AS (SELECT *, 80 + CASE WHEN db IS NULL THEN 10 WHEN db = 'sqlite' THEN 5 ELSE -5 END + CASE WHEN st IS NULL THEN 5 WHEN st = 'r2' AND target = 'cloudflare' THEN 10 ELSE 0 END + CASE WHEN missing > 0 THEN -8 * missing ELSE 5 END
  + CASE fw WHEN 'react' THEN 5 WHEN 'laravel' THEN -10 ELSE 0 END + CASE conf WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 0 END + CASE WHEN target = 'own-host' THEN 5 ELSE 0 END AS raw FROM e),
c AS (SELECT *, CAST(greatest(0, least(100, raw)) AS INTEGER) AS score, CASE WHEN db IN ('postgres', 'oracle') THEN 1 ELSE 0 END + CASE WHEN fw = 'laravel' THEN 1 ELSE 0 END AS medium FROM s)
SELECT id, score, CASE WHEN missing > 0 THEN 'HIGH' WHEN medium >= 2 OR score < 60 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM c
""")
def deployment_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of deployments whose environments follow from supplier keys."""
    k = F.col("s_suppkey")
    pick = lambda values, at: F.get(F.array(*(F.lit(v).cast("string") for v in values)), (at % len(values)).cast("int"))
    risk = frameworks.deployment_risk(
        pick(("react", "nextjs", "laravel", "other"), k), pick((None, "sqlite", "postgres", "oracle"), F.floor(k / 4)), pick((None, "r2", "s3"), k), pick(("cloudflare", "own-host"), k),
        F.lit("own-host"), k % 3, pick(("high", "medium", "low"), F.floor(k / 2)),
    )
    return table(spark, sf_dir, "supplier").select(k.alias("id"), risk.alias("r")).select("id", "r.*")
