"""Queries that compare two crawls. The later crawl is derived from the first: it lost
every seventh page, changed every fifth, retitled every tenth and found a copy of every
eleventh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import markup, text, urls
from quern.operators import diff
from quern.plans.web import CONTENT_SQL, sql_normalize
from quern.registry import query
from quern.sources.tables import table


def crawls(spark: SparkSession, sf_dir: str, *extra: str) -> tuple[DataFrame, DataFrame]:
    """Both crawls as (norm_url, hash), one row for each URL: the last page. ``extra`` names
    further columns (words, title, description), which are computed only where asked for."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    later = pages.filter("page_id % 7 != 0").withColumn("html", F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("<p>more words here</p>"))).otherwise(F.col("html")))
    later = later.withColumn("html", F.when(F.col("page_id") % 10 == 0, F.regexp_replace("html", "<title>", "<title>New: ")).otherwise(F.col("html")))
    found = pages.filter("page_id % 11 = 0").withColumn("url", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/copy")))
    values = {
        "words": F.size(text.words(F.regexp_replace("html", "<[^>]+>", " "))).cast("long"),
        "title": F.regexp_extract("html", "<title>([^<]*)", 1),
        "description": markup.meta_content(F.col("html"), "description"),
    }

    def manifest(df: DataFrame) -> DataFrame:
        nodes = df.select(
            "page_id", urls.normalize(F.col("url")).alias("norm_url"), text.content_hash(F.col("html")).alias("hash"), *(values[c].alias(c) for c in extra)
        )
        return diff.last_by_key(nodes, "norm_url", F.struct("page_id", "hash")).drop("page_id")

    return manifest(pages), manifest(later.unionByName(found))


CRAWLS_SQL = rf"""
WITH later AS (
  SELECT page_id, url, CASE WHEN page_id % 10 = 0 THEN regexp_replace(html, '<title>', '<title>New: ', 'g') || '<p>more words here</p>' WHEN page_id % 5 = 0 THEN html || '<p>more words here</p>' ELSE html END AS html FROM pages WHERE page_id % 7 <> 0
  UNION ALL SELECT page_id, regexp_replace(url, '[?#].*$', '') || '/copy', html FROM pages WHERE page_id % 11 = 0
), nodes AS (
  SELECT 'a' AS crawl, page_id, {sql_normalize('url')} AS norm_url, html FROM pages
  UNION ALL SELECT 'b', page_id, {sql_normalize('url')}, html FROM later
), hashed AS (
  SELECT crawl, page_id, norm_url, {CONTENT_SQL.format('html')} AS hash,
    CAST(len(list_filter(string_split(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')), ' '), lambda w: w <> '')) AS BIGINT) AS words,
    regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(regexp_extract(html, '<meta [^>]*name="description"[^>]*>'), 'content="([^"]*)"', 1) AS about
  FROM nodes
), kept AS (
  SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY crawl, norm_url ORDER BY page_id DESC, hash DESC) = 1
), d AS (
  SELECT coalesce(a.norm_url, b.norm_url) AS norm_url, a.words AS old_words, b.words AS new_words, a.title AS old_title, b.title AS new_title, a.about AS old_about, b.about AS new_about,
    CASE WHEN a.norm_url IS NULL THEN 'new' WHEN b.norm_url IS NULL THEN 'deleted' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS status
  FROM (SELECT * FROM kept WHERE crawl = 'a') a FULL OUTER JOIN (SELECT * FROM kept WHERE crawl = 'b') b ON a.norm_url = b.norm_url
)
"""


@query(CRAWLS_SQL + "SELECT norm_url, status FROM d")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.manifest_diff(*crawls(spark, sf_dir), "norm_url", "hash")


@query(CRAWLS_SQL + """SELECT count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'changed') AS changed,
  count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status = 'deleted') AS deleted,
  floor(count(*) FILTER (WHERE status = 'unchanged') * 1000.0::DOUBLE / count(*) FILTER (WHERE status <> 'deleted') + 0.5) / 10.0::DOUBLE AS skip_rate FROM d""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_summary(manifest_diff(spark, sf_dir))


@query(CRAWLS_SQL + """SELECT norm_url, new_words - old_words AS more_words,
  array_to_string(list_filter([CASE WHEN old_title <> new_title THEN 'title-changed' END, CASE WHEN old_about <> new_about THEN 'metadata-changed' END,
    CASE WHEN abs(new_words - old_words) * 100.0::DOUBLE / greatest(old_words, 1) > 10 THEN 'word-count-changed' END], lambda r: r IS NOT NULL), ',') AS reasons
FROM d WHERE status = 'changed'""")
def change_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a page counts as changed: its title, its description, or over a tenth of its words."""
    before, after = crawls(spark, sf_dir, "words", "title", "description")
    old = before.select("norm_url", *(F.col(c).alias(f"old_{c}") for c in ("hash", "words", "title", "description")))
    more = F.col("words") - F.col("old_words")

    def differs(c: str):
        return F.coalesce(F.col(c), F.lit("")) != F.coalesce(F.col(f"old_{c}"), F.lit(""))

    reasons = F.array_compact(
        F.array(
            F.when(differs("title"), "title-changed"), F.when(differs("description"), "metadata-changed"),
            F.when(F.abs(more) * 100.0 / F.greatest("old_words", F.lit(1)) > 10, "word-count-changed"),
        )
    )
    return old.join(after, "norm_url").filter("hash != old_hash").select("norm_url", more.alias("more_words"), F.array_join(reasons, ",").alias("reasons"))


@query(CRAWLS_SQL + """SELECT count(*) AS skipped, count(*) * 81920 AS bytes_saved, count(*) * 250 AS ms_saved, count(*) * 122880 AS storage_saved
FROM d WHERE status = 'unchanged'""")
def diff_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = manifest_diff(spark, sf_dir).filter("status = 'unchanged'").agg(F.count(F.lit(1)).alias("skipped"))
    return same.select("skipped", *((F.col("skipped") * n).alias(c) for c, n in (("bytes_saved", 81920), ("ms_saved", 250), ("storage_saved", 122880))))


@query(CRAWLS_SQL + "SELECT norm_url FROM d WHERE status IN ('new', 'changed') UNION ALL SELECT norm_url FROM d WHERE status = 'deleted'")
def changed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = manifest_diff(spark, sf_dir)
    return d.filter("status in ('new', 'changed')").select("norm_url").unionAll(d.filter("status = 'deleted'").select("norm_url"))


@query(f"""
SELECT h AS host, CAST(count(*) AS BIGINT) AS pages, count(DISTINCT title) AS titles, CAST(count(*) - count(DISTINCT title) AS BIGINT) AS repeated
FROM (SELECT lower(regexp_extract(trim(url), '{urls.HOST}', 1)) AS h, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages) GROUP BY h
""")
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    # Two levels of grouping: the first combines before the shuffle, so a large host is no hot key.
    per = pages.groupBy("host", "title").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("host").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("titles"))
    return out.withColumn("repeated", F.col("pages") - F.col("titles"))


@query("""
WITH g AS (SELECT sha256(text) AS checksum, count(*) AS copies, max(octet_length(encode(text))) AS bytes, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT checksum, copies, first_id, CAST((copies - 1) * bytes AS BIGINT) AS wasted FROM g WHERE copies > 1
""")
def duplicate_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    sums = docs.select("doc_id", F.sha2("text", 256).alias("checksum"), F.octet_length("text").cast("long").alias("bytes"))
    groups = sums.groupBy("checksum").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.max("bytes").alias("b"))
    return groups.filter("copies > 1").select("checksum", "copies", "first_id", ((F.col("copies") - 1) * F.col("b")).alias("wasted"))
