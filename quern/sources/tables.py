"""Sources and sinks: Parquet tables, JSON documents, JDBC, sitemaps, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import urls

ARTICLES = T.ArrayType(
    T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("date", T.StringType())])
)
MANIFEST = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("jobId", T.StringType()),
        T.StructField(
            "nodes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("hash", T.StringType()),
                        T.StructField("depth", T.IntegerType()), T.StructField("parentId", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest documents, a JSON file each; what does not parse has nulls."""
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 32) -> DataFrame:
    """A database table read in ``parts`` ranges of ``key``."""
    return (
        spark.read.format("jdbc").option("url", url).option("dbtable", name)
        .option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
        .load()
    )


def articles(text: Column) -> Column:
    """A JSON list of links; null where it does not parse."""
    return F.from_json(text, ARTICLES)


LOC = r"<loc>\s*([^<]*?)\s*</loc>"


def sitemap_urls(xml: DataFrame, col: str = "xml") -> DataFrame:
    """The distinct locations of sitemap documents."""
    return xml.select(F.explode(F.regexp_extract_all(col, F.lit(LOC), F.lit(1))).alias("url")).distinct()


def sitemap_links(files: DataFrame, site: str) -> DataFrame:
    """(url, norm_url, title) of a site's pages from its sitemap files (url, xml): those that the
    index names, or ``sitemap.xml`` where there is no index.

    Maps of attachments and images, links to other hosts and to what is no page are left out;
    each normalised URL counts once, by its smallest form; titles come from the last segment.
    """
    index = files.filter(F.col("url") == f"{site}/sitemap_index.xml")
    named = sitemap_urls(index).filter(F.lower("url").contains("sitemap") & ~F.col("url").rlike("(?i)attachment|image"))
    alone = files.sparkSession.createDataFrame([(f"{site}/sitemap.xml",)], "url string").join(index.select(F.lit(1)).limit(1), F.lit(True), "left_anti")
    maps = files.join(named.unionByName(alone).distinct(), "url", "left_semi")
    found = sitemap_urls(maps).select(F.substring_index("url", "#", 1).alias("url")).filter(urls.is_page_link(F.col("url"), F.lit(urls_authority(site))))
    kept = found.groupBy(urls.normalize(F.col("url"), ("",)).alias("norm_url")).agg(F.min("url").alias("url"))
    slug = F.try_element_at(urls.segments(urls.route(F.col("url"))), F.lit(-1))
    return kept.select("url", "norm_url", F.coalesce(F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))), F.col("url")).alias("title"))


def urls_authority(site: str) -> str:
    """Host and port of a site's address, lowered."""
    return site.split("://", 1)[-1].split("/", 1)[0].lower()


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sitemap_entry(url: Column, last_change: Column | None = None, frequency: Column | None = None, priority: Column | None = None) -> Column:
    """One entry of a sitemap, escaped; parts that are not given or null are left out."""

    def tag(name: str, value: Column | None) -> Column:
        return F.lit("") if value is None else F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")), F.lit(""))

    number = None if priority is None else F.format_number(priority, 1)
    return F.concat(F.lit("<url><loc>"), _escaped(url), F.lit("</loc>"), tag("lastmod", last_change), tag("changefreq", frequency), tag("priority", number), F.lit("</url>"))


#: Entries that one sitemap file may hold.
SITEMAP_ENTRIES = 50_000
_OPEN = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


def write_sitemap(pages: DataFrame, path: str, url_col: str = "url", *, last_change: str | None = None, frequency: str | None = None, priority: str | None = None) -> None:
    """Whole sitemap documents, a text file for each SITEMAP_ENTRIES pages at most, in order of
    URL; an empty table gives no documents."""
    given = {k: F.col(c) for k, c in (("last_change", last_change), ("frequency", frequency), ("priority", priority)) if c}
    files = max(1, -(-pages.count() // (SITEMAP_ENTRIES // 2)))
    entries = pages.select(F.col(url_col).alias("_u"), sitemap_entry(F.col(url_col), **given).alias("entry")).repartitionByRange(files, "_u")
    part = F.spark_partition_id()
    joined = F.concat(F.lit(_OPEN + "\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_u", "entry"))), lambda e: e["entry"]), "\n"), F.lit("\n</urlset>"))
    entries.withColumn("file", part).groupBy("file").agg(joined.alias("value")).select("value").write.option("lineSep", "\n").text(path)


def write_search_index(entries: DataFrame, path: str) -> None:
    """A site's search index: JSON documents of (id, title, url, excerpt, ...), one a line."""
    entries.write.json(path, ignoreNullFields=False)


def snapshot(snapshots: DataFrame, job: str) -> DataFrame:
    """The manifest of one job of (job_id, manifest_json, ...); what does not parse is null."""
    return snapshots.filter(F.col("job_id") == job).select("job_id", F.from_json("manifest_json", MANIFEST).alias("manifest"))


def snapshot_meta(snapshots: DataFrame, job: str | None = None) -> DataFrame:
    """What is known of manifests without reading their bodies."""
    meta = snapshots.select("job_id", "schema_version", "render_source", "updated_at")
    return meta if job is None else meta.filter(F.col("job_id") == job)


def export_manifest(nodes: DataFrame, version: str = "1.0") -> DataFrame:
    """(jobId, json): a portable document for each job of nodes (jobId, id, url, hash, depth,
    parentId), nodes in order of id, so that equal manifests are equal documents. A job's
    nodes meet in one row, as its document is one."""
    inner = F.struct("id", "url", "hash", "depth", "parentId")
    docs = nodes.groupBy("jobId").agg(F.sort_array(F.collect_list(inner)).alias("nodes"))
    return docs.select("jobId", F.to_json(F.struct(F.lit(version).alias("version"), "jobId", "nodes")).alias("json"))


def import_manifest(documents: DataFrame, old_prefix: str = "", new_prefix: str = "", col: str = "json") -> DataFrame:
    """The nodes of portable documents, with URLs under ``old_prefix`` put under ``new_prefix``."""
    node = documents.select(F.from_json(col, MANIFEST).alias("m")).select("m.version", "m.jobId", F.explode("m.nodes").alias("n")).select("version", "jobId", "n.*")
    moved = F.when(F.col("url").startswith(old_prefix), F.concat(F.lit(new_prefix), F.substring("url", len(old_prefix) + 1, 1 << 30))).otherwise(F.col("url"))
    return node.withColumn("url", moved) if old_prefix or new_prefix else node


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of stored objects, newest first; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    return found.orderBy(F.desc_nulls_last("modificationTime"), "path")


def enqueue(jobs: DataFrame, path: str) -> None:
    """Append jobs (job_id, seed_url, articles array, ...) as queued, their articles as JSON."""
    queued = jobs.withColumns({"articles_json": F.to_json("articles"), "total_articles": F.size("articles"), "status": F.lit("queued"), "retry_count": F.lit(0)})
    queued.drop("articles").write.mode("append").parquet(path)


def write_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """Each report as JSON in a folder of its own name, in place of the one before."""
    for name, report in reports.items():
        report.write.mode("overwrite").json(f"{folder}/{name}")


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``current`` with the rows of ``changes`` put in place of those with the same key. Where
    changes repeat a key, the one that is last in ``order`` counts, without an order the one
    with the largest values, column by column. A null key is a key."""
    rest = [c for c in changes.columns if c != key]
    if rest:
        last = F.max_by(F.struct(*rest), order) if order is not None else F.max(F.struct(*rest))
        changes = changes.groupBy(key).agg(last.alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*changes.columns)
    else:
        changes = changes.distinct()
    new = changes.select(F.col(key).alias("_new"))
    return current.join(new, F.col(key).eqNullSafe(F.col("_new")), "left_anti").unionByName(changes)


def append_facts(facts: DataFrame, path: str, by: str) -> None:
    """Append facts, one folder for each value of ``by``, so that reads by it prune."""
    facts.write.mode("append").partitionBy(by).parquet(path)
