"""Queries over the small functions: versions, hashes, lengths, measures, types, labels, colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import markup, media, paths, text, urls, versions
from quern.plans.web import RICH_SQL, rich_pages, sql_resolve, sql_route
from quern.registry import query
from quern.sources.tables import table


@query(r"""
WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'v' ELSE '' END || p_size || '.' || p_partkey % 10 || CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '.x' ELSE '.' || p_partkey % 3 END AS version FROM part),
n AS (SELECT *, string_split(regexp_replace(version, '^v', ''), '.') AS p FROM v),
t AS (SELECT *, coalesce(try_cast(p[1] AS INTEGER), 0) AS a, coalesce(try_cast(p[2] AS INTEGER), 0) AS b, coalesce(try_cast(p[3] AS INTEGER), 0) AS c FROM n)
SELECT p_partkey, version, regexp_full_match(version, 'v?[0-9]+[.][0-9]+[.][0-9]+') AS valid, (a + 1) || '.0.0' AS major, a || '.' || (b + 1) || '.0' AS minor, a || '.' || b || '.' || (c + 1) AS patch,
  CASE WHEN a <> 10 THEN a - 10 WHEN b <> 5 THEN b - 5 ELSE c - 1 END AS against FROM t
""")
def semantic_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions made of part sizes and keys: valid or not, the next ones, and compared with 10.5.1."""
    key = F.col("p_partkey")
    tail = F.when(key % 7 == 0, "").when(key % 7 == 1, ".x").otherwise(F.concat(F.lit("."), (key % 3).cast("string")))
    v = F.concat(F.when(key % 4 == 0, "v").otherwise(""), F.col("p_size").cast("string"), F.lit("."), (key % 10).cast("string"), tail)
    p = table(spark, sf_dir, "part").select("p_partkey", v.alias("version"))
    c = F.col("version")
    return p.select(
        "p_partkey", "version", versions.is_version(c).alias("valid"), *(versions.bump(c, F.lit(k)).alias(k) for k in ("major", "minor", "patch")),
        versions.compare(c, F.lit("10.5.1")).alias("against"),
    )


_HASH_SQL = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296)"


@query(f"""
WITH h AS (SELECT page_id, url, {_HASH_SQL.format('url')} AS h, {_HASH_SQL.format("printf('%06x%06xaabbcc', page_id % 65536, page_id % 251)")} AS p FROM pages)
SELECT page_id, 'sg-' || printf('%08x', abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)) AS graph_id, printf('%08x', p) AS palette FROM h
""")
def rolling_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph ids of URLs and hashes of palettes."""
    color = lambda n: F.concat(F.lit("#"), F.lower(F.lpad(F.hex(n), 6, "0")))
    palette = F.array(color(F.col("page_id") % 65536), color(F.col("page_id") % 251), F.lit("#aabbcc"))
    return table(spark, sf_dir, "pages").select("page_id", versions.graph_id(F.col("url")).alias("graph_id"), versions.palette_hash(palette).alias("palette"))


@query("""
WITH l AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || 'px' WHEN 1 THEN ' ' || p_size / 4.0::DOUBLE || 'rem' WHEN 2 THEN p_size || '' WHEN 3 THEN p_size || '%' ELSE p_size || 'em' END AS length, p_size FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 4.0::DOUBLE WHEN 2 THEN p_size::DOUBLE WHEN 4 THEN p_size * 16.0::DOUBLE END AS px FROM l
""")
def css_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    value = (
        F.when(k == 0, F.concat(n, F.lit("px"))).when(k == 1, F.concat(F.lit(" "), (F.col("p_size") / 4.0).cast("string"), F.lit("rem"))).when(k == 2, n)
        .when(k == 3, F.concat(n, F.lit("%"))).otherwise(F.concat(n, F.lit("em")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", versions.pixels(value).alias("px"))


@query("""
SELECT p_partkey, CAST(least(100, greatest(0, floor(p_retailprice / 10 - 50 + 0.5))) AS BIGINT) AS clamped,
  CASE WHEN p_size % 10 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END ELSE least(1.0, (p_partkey % 2)::DOUBLE * 3 / (p_size % 10)) END AS ratio,
  CASE WHEN p_size % 7 = 0 AND p_partkey % 5 = 0 THEN 100 ELSE CAST(greatest(0, floor((1 - abs(p_size % 7 - p_partkey % 5) / 5.0::DOUBLE) * 100 + 0.5)) AS BIGINT) END AS proximity,
  floor(p_size * ((6 - (p_partkey % 5 + 1)) / 5.0::DOUBLE) * 0.5::DOUBLE * 1000 + 0.5) / 10 AS priority FROM part
""")
def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", versions.clamp(F.col("p_retailprice") / 10 - 50).alias("clamped"), versions.ratio(key % 2 * 3, size % 10).alias("ratio"),
        versions.proximity(size % 7, key % 5, 5).alias("proximity"), versions.optimizer_priority(size, key % 5 + 1, F.lit(0.5)).alias("priority"),
    )


@query(rf"""
{RICH_SQL}, r AS (SELECT page_id, {sql_resolve('trim(url)', "unnest(list_concat(regexp_extract_all(html, '<img [^>]*src=\"([^\"]*)\"', 1), regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)))")} AS u FROM pages_rich),
e AS (SELECT lower(regexp_extract(regexp_extract(u, '^[^?#]*'), '[.]([A-Za-z0-9]+)$', 1)) AS x FROM r),
m AS (SELECT CASE x WHEN 'jpg' THEN 'image/jpeg' WHEN 'webp' THEN 'image/webp' WHEN 'gif' THEN 'image/gif' WHEN 'png' THEN 'image/png' WHEN 'css' THEN 'text/css' WHEN 'mp3' THEN 'audio/mpeg' WHEN 'pdf' THEN 'application/pdf' WHEN 'html' THEN 'text/html' END AS mime FROM e)
SELECT mime, CASE WHEN mime LIKE 'image/%' THEN 'image' WHEN mime LIKE 'audio/%' THEN 'audio' WHEN mime = 'application/pdf' THEN 'document' ELSE 'unknown' END AS class,
  CASE WHEN mime LIKE 'image/%' THEN 'images' WHEN mime LIKE 'audio/%' THEN 'audio' WHEN mime = 'application/pdf' THEN 'documents' ELSE 'dom' END AS place, count(*) AS n FROM m GROUP BY 1
""")
def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages refer to, by MIME type, class and place of storage."""
    page = F.trim("url")
    refs = F.concat(markup.values(F.col("html"), "img", "src"), markup.values(F.col("html"), "a", "href"), markup.values(F.col("html"), "link", "href"))
    r = rich_pages(spark, sf_dir).select(F.explode(F.transform(refs, lambda u: urls.resolve(page, u))).alias("u")).select(media.mime_of(F.col("u")).alias("mime"))
    n = r.groupBy("mime").agg(F.count(F.lit(1)).alias("n")).withColumn("class", media.media_class(F.col("mime")))
    return n.select("mime", "class", media.storage_category(F.lit("asset"), F.col("class")).alias("place"), "n")


@query("""
SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'application/pdf' WHEN 5 THEN 'video/mp4' WHEN 6 THEN 'audio/mpeg'
  WHEN 7 THEN 'image/svg+xml' WHEN 8 THEN 'text/html' ELSE 'application/octet-stream' END AS mime FROM documents WHERE text IS NOT NULL
""")
def sniffed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIME types from first bytes, set before the documents' own, or a header."""
    first = ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "524946460000000057454250", "255044462D", "0000001866747970", "494433", "3C737667203E", "00", "00")
    head = F.unhex(F.get(F.array(*map(F.lit, first)), (F.col("doc_id") % 10).cast("int")))
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.concat(head, F.encode("text", "utf-8")).alias("content"))
    header = F.when(F.col("doc_id") % 10 == 8, "Text/HTML; charset=utf-8")
    return d.select("doc_id", media.sniff(F.col("content"), header).alias("mime"))


_TYPES = ("int", "bigint", "smallint", "text", "varchar", "char", "float", "double", "decimal", "json", "jsonb", "timestamp", "timestamptz", "boolean", "bool")


@query(f"""
WITH t AS (SELECT p_partkey, {list(_TYPES)}[p_partkey % 15 + 1] AS held, {list(_TYPES)}[p_partkey * 7 % 15 + 1] AS wished FROM part),
g AS (SELECT *, CASE WHEN held IN ('int', 'bigint', 'smallint') THEN 1 WHEN held IN ('text', 'varchar', 'char') THEN 2 WHEN held IN ('float', 'double', 'decimal') THEN 3 WHEN held LIKE 'bool%' THEN 4 WHEN held LIKE 'time%' THEN 5 ELSE 6 END AS a,
  CASE WHEN wished IN ('int', 'bigint', 'smallint') THEN 1 WHEN wished IN ('text', 'varchar', 'char') THEN 2 WHEN wished IN ('float', 'double', 'decimal') THEN 3 WHEN wished LIKE 'bool%' THEN 4 WHEN wished LIKE 'time%' THEN 5 ELSE 6 END AS b FROM t)
SELECT p_partkey, a = b AS compatible, held || '>' || wished IN ('bigint>int', 'bigint>smallint', 'int>smallint', 'text>varchar', 'text>char', 'varchar>char', 'float>int', 'double>int', 'decimal>int', 'jsonb>json', 'timestamptz>timestamp') AS loses FROM g
""")
def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one column type may take another's place, and whether data would be lost."""
    pick = lambda k: F.get(F.array(*map(F.lit, _TYPES)), (k % 15).cast("int"))
    held, wished = pick(F.col("p_partkey")), pick(F.col("p_partkey") * 7)
    return table(spark, sf_dir, "part").select("p_partkey", media.types_compatible(held, wished).alias("compatible"), media.loses_data(held, wished).alias("loses"))


_KINDS = ("job-failed", "stage-retrying", "diff-computed", "rollback-complete", "crawl-complete", "job-done")


@query(f"""
WITH k AS (SELECT event_id, {list(_KINDS)}[event_id % 6 + 1] AS kind FROM events)
SELECT event_id, kind, CASE event_id % 6 WHEN 2 THEN 'differential' WHEN 3 THEN 'recovery' WHEN 4 THEN 'coverage' ELSE 'pipeline' END AS subsystem, CASE event_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'info' END AS severity FROM k
""")
def event_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in their common envelope: subsystem and severity by kind."""
    from quern.streaming.events import envelope

    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 6).cast("int"))
    return envelope(table(spark, sf_dir, "events").withColumn("event_type", kind)).select("event_id", F.col("event").alias("kind"), "subsystem", "severity")


@query(rf"""
WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, list_filter(string_split({sql_route('url')}, '/'), lambda s: s <> '') AS parts, {sql_route('url')} AS route, ['HeroSection', 'ArticleLayout', 'GridLayout', 'FeatureBlock', 'NavigationLayout', 'Other'][page_id % 6 + 1] AS stencil FROM pages),
d AS (SELECT *, CAST(len(parts) AS INTEGER) AS depth, coalesce(parts[-1], 'home') AS slug, CASE WHEN page_id % 5 = 0 THEN '' ELSE title END AS own FROM p),
c AS (SELECT *, CASE WHEN depth = 0 OR page_id % 6 = 0 THEN 'homepage' ELSE ['homepage', 'article', 'listing', 'feature', 'navigation', 'unknown'][page_id % 6 + 1] END AS category FROM d)
SELECT page_id, category, CASE WHEN page_id % 6 = 4 OR depth = 0 OR (depth = 1 AND category IN ('listing', 'feature')) THEN 'primary' WHEN depth <= 2 THEN 'secondary' WHEN category = 'article' THEN 'footer' WHEN page_id % 2 = 1 THEN 'unlisted' ELSE 'breadcrumb' END AS place,
  CASE WHEN length(trim(own)) > 1 THEN trim(own) WHEN slug = 'home' OR depth = 0 THEN ['Home', 'Article', 'Index', 'Features', 'Site Map', 'Home'][page_id % 6 + 1]
    ELSE array_to_string(list_transform(string_split(regexp_replace(regexp_replace(slug, '[-_]+', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') END AS title,
  array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'for', 'and', 'are', 'was', 'been', 'with', 'from', 'that', 'this', 'its', 'page', 'post', 'article', 'www', 'http', 'https', 'index', 'home', 'default', 'main', 'content', 'section'))[1:6], ',') AS keywords,
  category || ',' || stencil || CASE WHEN page_id % 2 = 0 AND category <> 'navigation' THEN ',navigation' ELSE '' END || CASE WHEN page_id % 4 > 3 THEN ',media-rich' ELSE '' END || CASE WHEN depth = 0 THEN ',root' ELSE '' END AS tags
FROM c
""")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, category, place in the navigation, keywords and tags of pages; layouts by number,
    as the tables hold none."""
    stencils = F.array(*map(F.lit, ("HeroSection", "ArticleLayout", "GridLayout", "FeatureBlock", "NavigationLayout", "Other")))
    route = urls.route(F.col("url"))
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), route.alias("route"), F.size(urls.segments(route)).alias("depth"),
        urls.slug(route).alias("slug"), F.get(stencils, (F.col("page_id") % 6).cast("int")).alias("stencil"), (F.col("page_id") % 2 == 0).alias("nav"),
    )
    c = p.withColumn("category", text.page_category(F.col("stencil"), F.col("depth"), F.col("route")))
    own = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("title"))
    tags = text.page_tags(F.col("category"), F.col("stencil"), F.col("depth"), F.col("page_id") % 4, F.lit(0), {"navigation": F.col("nav")})
    return c.select(
        "page_id", "category", text.navigation_place(F.col("depth"), F.col("category"), F.col("nav"), F.col("stencil")).alias("place"),
        text.page_title(own, F.col("slug"), F.col("stencil"), F.col("depth")).alias("title"), F.array_join(text.title_keywords(F.col("title")), ",").alias("keywords"),
        F.array_join(tags, ",").alias("tags"),
    )


@query(r"""
WITH d AS (SELECT doc_id, coalesce(source, '') || ', ' || coalesce(lang, '') || ';' || upper(coalesce(lang, '')) || '|x y|' AS raw, coalesce(text, '') AS t FROM documents)
SELECT doc_id, array_to_string(list_filter([lower(trim(split_part(raw, ',', 1))), lower(trim(split_part(split_part(raw, ',', 2), ';', 1))), 'x y'], lambda w: w <> ''), ',') AS keywords,
  CAST(len(list_filter(list_distinct(regexp_split_to_array(lower(substr(t, 1, 200)), '[^a-zA-Z0-9]+')), lambda w: w <> '')) AS INTEGER) AS words,
  substr(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(substr(t, 1, 60)), '[^a-z0-9\s-]', '', 'g')), '[\s_]+', '-', 'g'), '-{2,}', '-', 'g'), '^-|-$', '', 'g'), 1, 80) AS slug
FROM d
""")
def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword lists brought to one form, distinct words of a title, and its slug in routes. A
    document's first 200 code points stand in for a title."""
    part = lambda c: F.coalesce(c, F.lit(""))
    raw = F.concat(part(F.col("source")), F.lit(", "), part(F.col("lang")), F.lit(";"), F.upper(part(F.col("lang"))), F.lit("|x y|"))
    t = part(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(text.keywords(raw), ",").alias("keywords"), F.size(text.word_set(F.substring(t, 1, 200))).alias("words"),
        text.route_slug(F.substring(t, 1, 60)).alias("slug"),
    )


_HEX_SQL = "printf('#%02x%02x%02x', (p_partkey * 37) % 256, (p_partkey * 91) % 256, (p_partkey * 151) % 256)"


def _hex(shift: int = 0):
    key = F.col("p_partkey") + shift
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex((key * m) % 256), 2, "0")) for m in (37, 91, 151)))


@query(f"""
WITH c AS (SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 91) % 256 AS g, (p_partkey * 151) % 256 AS b, ((p_partkey + 1) * 37) % 256 AS r2, ((p_partkey + 1) * 91) % 256 AS g2, ((p_partkey + 1) * 151) % 256 AS b2 FROM part),
d AS (SELECT *, sqrt(((r - r2) ** 2 + (g - g2) ** 2 + (b - b2) ** 2)::DOUBLE) AS d1, sqrt(((r - 255) ** 2 + (g - 255) ** 2 + (b - 255) ** 2)::DOUBLE) AS d2 FROM c)
SELECT p_partkey, round(d1, 6) AS distance, CAST(greatest(0, floor(100 - least(d1, d2) / 4.41::DOUBLE + 0.5)) AS BIGINT) AS similarity,
  CASE p_partkey % 3 WHEN 0 THEN printf('#%02x%02x%02x', r, g, b) WHEN 1 THEN printf('#%02x%02x%02x', r, g, b) END AS normal FROM d
""")
def color_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each colour to the next, likeness of its palette to the next one and white,
    and its normal form, written as digits, as rgb() or as something else."""
    own, after = _hex(), _hex(1)
    c = text.rgb(own)
    written = F.when(F.col("p_partkey") % 3 == 0, F.upper(own)).when(
        F.col("p_partkey") % 3 == 1, F.concat(F.lit("rgba( "), *(x for n in "rgb" for x in (c[n].cast("string"), F.lit(", "))), F.lit("0.5)"))
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(text.color_distance(text.rgb(own), text.rgb(after)), 6).alias("distance"),
        text.palette_similarity(F.array(own), F.array(after, F.lit("#ffffff"))).alias("similarity"), text.normalize_color(F.coalesce(written, F.lit("teal"))).alias("normal"),
    )


@query("""
WITH g AS (SELECT p_partkey, p_partkey % 101 AS l FROM part), s AS (SELECT p_partkey, CAST(floor(255 * (l / 100.0::DOUBLE) + 0.5) AS INTEGER) AS v FROM g)
SELECT p_partkey, printf('#%02x%02x%02x', v, v, v) AS gray, '#e6e6e6,#808080,#1a1a1a' AS tones, 0.0 + round(abs(p_partkey % 101 - 50) / 100.0::DOUBLE / sqrt(3.0::DOUBLE), 4) AS distance FROM s
""")
def color_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grays: hex of a lightness, tones 100, 500 and 900 of its scale, distance to the middle."""
    tone = (F.col("p_partkey") % 101).cast("int")
    gray = text.hsl_hex(F.lit(0), F.lit(0), tone)
    scale = text.color_scale(F.lit("#777777"))
    hsl = lambda light: F.struct(F.lit(0).alias("h"), F.lit(0).alias("s"), light.alias("l"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", gray.alias("gray"), F.concat_ws(",", *(F.try_element_at(scale, F.lit(k)) for k in ("100", "500", "900"))).alias("tones"),
        text.hsl_distance(hsl(tone), hsl(F.lit(50))).alias("distance"),
    )


@query("""
SELECT p_partkey, '#000000:' || CAST(2 + p_partkey % 2 AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN ',#ffffff:2' ELSE ',#ffffff:1' END AS merged FROM part
""")
def merged_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes whose near colours count for one another, in the order given."""
    last = F.when(F.col("p_partkey") % 2 == 0, "#ffffff").otherwise("#101010")
    merged = text.merged_colors(F.array(F.lit("#000000"), F.lit("#fff"), F.lit("#050505"), last))
    shown = F.transform(merged, lambda m: F.concat(F.when(m["hex"] == "#fff", "#ffffff").otherwise(m["hex"]), F.lit(":"), m["n"].cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(shown, ",").alias("merged"))


_PATTERNS_SQL = "(VALUES (1, '/en/**'), (2, '/*/:id'), (3, '/fr/x/*'), (4, '/:lang'))"


@query(rf"""
WITH r AS (SELECT page_id, list_filter(string_split({sql_route('url')}, '/'), lambda s: s <> '') AS t FROM pages), w(ord, pattern) AS {_PATTERNS_SQL},
x AS (SELECT page_id, ord, t, list_filter(string_split(pattern, '/'), lambda s: s <> '') AS p FROM r CROSS JOIN w)
SELECT page_id, ord, CASE WHEN p[-1] = '**' THEN len(t) >= len(p) AND t[1] = p[1] ELSE len(t) = len(p) AND len(list_filter(range(1, len(p) + 1), lambda i: NOT (p[i] = '*' OR starts_with(p[i], ':') OR p[i] = t[i]))) = 0 END AS captured,
  CASE WHEN len(t) = len(p) THEN len(list_filter(range(1, len(p) + 1), lambda i: NOT (p[i] IN ('*', '**') OR starts_with(p[i], ':') OR p[i] = t[i]))) = 0 ELSE p[-1] IN ('*', '**') AND len(t) >= len(p) - 1 END AS structural FROM x
""")
def route_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of four patterns capture a route, and which have a structure that may stand for it."""
    patterns = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(p).alias("pattern")) for i, p in ((1, "/en/**"), (2, "/*/:id"), (3, "/fr/x/*"), (4, "/:lang"))))
    r = table(spark, sf_dir, "pages").select("page_id", paths.segments(urls.route(F.col("url"))).alias("t"), F.explode(patterns).alias("w"))
    r = r.select("page_id", "w.ord", "t", paths.segments(F.col("w.pattern")).alias("p"))
    return r.select("page_id", "ord", paths.wildcard_captures(F.col("p"), F.col("t")).alias("captured"), paths.structural_match(F.col("p"), F.col("t")).alias("structural"))


@query("""
WITH x AS (SELECT p_partkey, (p_partkey * 13) % 101 AS score, (p_partkey * 7) % 100 AS security, ['css', 'image', 'api-endpoint', 'font'][p_partkey % 4 + 1] AS kind, ['same-domain', 'cdn', 'external', 'data-uri', 'subdomain'][p_partkey % 5 + 1] AS origin FROM part),
p AS (SELECT *, CASE WHEN security >= 85 THEN 'SKIP' WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' WHEN score >= 20 THEN 'LOW' ELSE 'SKIP' END AS priority FROM x)
SELECT p_partkey, priority, CASE WHEN priority = 'SKIP' OR p_partkey % 9 = 0 OR kind = 'api-endpoint' THEN 'SKIP' WHEN origin = 'data-uri' THEN 'DOWNLOAD'
  WHEN priority IN ('CRITICAL', 'HIGH', 'MEDIUM') AND origin IN ('same-domain', 'subdomain') THEN 'DOWNLOAD' WHEN priority IN ('CRITICAL', 'HIGH') AND origin = 'cdn' AND kind IN ('css', 'font') THEN 'DOWNLOAD'
  WHEN priority IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN 'REFERENCE' ELSE 'DEFER' END AS advice FROM p
""")
def resource_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority of resources and whether to download them; the figures follow from part keys."""
    key = F.col("p_partkey")
    kind = F.get(F.array(*map(F.lit, ("css", "image", "api-endpoint", "font"))), (key % 4).cast("int"))
    origin = F.get(F.array(*map(F.lit, ("same-domain", "cdn", "external", "data-uri", "subdomain"))), (key % 5).cast("int"))
    tags = F.when(key % 9 == 0, F.array(F.lit("analytics"))).otherwise(F.array().cast("array<string>"))
    p = table(spark, sf_dir, "part").select("p_partkey", media.resource_priority(key * 13 % 101, key * 7 % 100, F.lit(0)).alias("priority"), kind.alias("kind"), origin.alias("origin"), tags.alias("tags"))
    return p.select("p_partkey", "priority", media.download_advice(F.col("kind"), F.col("origin"), F.col("priority"), F.col("tags")).alias("advice"))
