import time

from pyspark.sql import functions as F

from quern.sources import tables

INDEX = "<sitemapindex><sitemap><loc>http://a.com/post-sitemap.xml</loc></sitemap><sitemap><loc>http://a.com/attachment-sitemap.xml</loc></sitemap></sitemapindex>"
POSTS = "<urlset><url><loc> http://a.com/my-first-post/ </loc></url><url><loc>http://a.com/my-first-post#x</loc></url><url><loc>http://b.com/x</loc></url><url><loc>http://a.com/f.pdf</loc></url></urlset>"
OTHER = "<urlset><url><loc>http://a.com/hidden</loc></url></urlset>"


def test_sitemap_index_names_the_maps_that_count(spark):
    files = spark.createDataFrame(
        [("http://a.com/sitemap_index.xml", INDEX), ("http://a.com/post-sitemap.xml", POSTS), ("http://a.com/attachment-sitemap.xml", OTHER), ("http://a.com/sitemap.xml", OTHER)], "url string, xml string"
    )
    rows = tables.sitemap_links(files, "http://a.com").collect()
    assert [(r.norm_url, r.title) for r in rows] == [("http://a.com/my-first-post", "My First Post")]
    alone = files.filter(~F.col("url").contains("index"))
    assert [r.url for r in tables.sitemap_links(alone, "http://a.com").collect()] == ["http://a.com/hidden"]
    assert tables.sitemap_links(files.limit(0), "http://a.com").collect() == []


def test_a_written_sitemap_is_read_again(spark, tmp_path):
    pages = spark.createDataFrame([("http://a.com/?a=1&b=2", "2026-01-02", "weekly", 0.75), ("http://a.com/", None, None, None)], "url string, d string, f string, p double")
    tables.write_sitemap(pages, str(tmp_path / "map"), last_change="d", frequency="f", priority="p")
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "map").glob("part*")))
    assert text.startswith("<?xml") and text.rstrip().endswith("</urlset>") and text.count("<url>") == 2
    assert "<loc>http://a.com/?a=1&amp;b=2</loc><lastmod>2026-01-02</lastmod><changefreq>weekly</changefreq><priority>0.8</priority>" in text
    back = spark.createDataFrame([(text,)], "xml string")
    assert {r.url for r in tables.sitemap_urls(back).collect()} == {"http://a.com/?a=1&amp;b=2", "http://a.com/"}


NODES = [("j1", "n2", "http://old/x", "h", 1, "n1"), ("j1", "n1", "http://old/", "g", 0, None), ("j2", "n9", "http://c/", "k", 0, None)]
NODE_SCHEMA = "jobId string, id string, url string, hash string, depth int, parentId string"


def test_manifests_round_trip_and_move(spark):
    nodes = spark.createDataFrame(NODES, NODE_SCHEMA)
    one = tables.export_manifest(nodes)
    assert {r.jobId: r.json for r in one.collect()} == {r.jobId: r.json for r in tables.export_manifest(nodes.repartition(3)).collect()}
    back = tables.import_manifest(one).select("jobId", "id", "url", "hash", "depth", "parentId")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(NODES, key=str)
    moved = tables.import_manifest(one, "http://old/", "https://new/base/")
    assert sorted(r.url for r in moved.collect()) == ["http://c/", "https://new/base/", "https://new/base/x"]
    assert tables.import_manifest(spark.createDataFrame([("{broken",)], "json string")).collect() == []


def test_snapshots_by_job_and_without_their_bodies(spark):
    docs = tables.export_manifest(spark.createDataFrame(NODES, NODE_SCHEMA))
    stored = docs.select(F.col("jobId").alias("job_id"), F.col("json").alias("manifest_json"), F.lit("1.0").alias("schema_version"), F.lit("crawl").alias("render_source"), F.lit("2026-01-01").alias("updated_at"))
    assert len(tables.snapshot(stored, "j1").first().manifest.nodes) == 2
    assert tables.snapshot(stored, "none").collect() == []
    meta = tables.snapshot_meta(stored, "j2")
    assert meta.columns == ["job_id", "schema_version", "render_source", "updated_at"] and meta.count() == 1


def test_manifest_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version": "1.0", "jobId": "j", "nodes": [{"id": "n", "url": "u"}]}')
    (tmp_path / "b.json").write_text("not json")
    rows = tables.manifests(spark, str(tmp_path)).collect()
    assert sorted(str(r.jobId) for r in rows) == ["None", "j"]


def test_objects_come_newest_first(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for i, name in enumerate(("old.bin", "sub/new.bin")):
        (tmp_path / name).write_bytes(b"x" * (i + 1))
        time.sleep(1.1 * (1 - i))
    rows = tables.objects(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["new.bin", "old.bin"] and [r.length for r in rows] == [2, 1]


def test_jobs_and_facts_are_appended(spark, tmp_path):
    jobs = spark.createDataFrame([("j1", "http://a", [("http://a/1", "t", None)])], "job_id string, seed_url string, articles array<struct<url:string,title:string,date:string>>")
    for _ in range(2):
        tables.enqueue(jobs, str(tmp_path / "jobs"))
    rows = spark.read.parquet(str(tmp_path / "jobs")).collect()
    assert [(r.status, r.total_articles) for r in rows] == [("queued", 1)] * 2
    read = spark.read.parquet(str(tmp_path / "jobs")).select(tables.articles(F.col("articles_json")).alias("a")).first().a
    assert read[0].url == "http://a/1"
    facts = spark.createDataFrame([("s1", 1), ("s2", 2)], "seed string, n int")
    for _ in range(2):
        tables.append_facts(facts, str(tmp_path / "facts"), "seed")
    back = spark.read.parquet(str(tmp_path / "facts"))
    assert back.count() == 4 and back.filter("seed = 's1'").agg(F.sum("n")).first()[0] == 2


def test_reports_and_search_index_are_replaced(spark, tmp_path):
    one, two = spark.createDataFrame([(1, "a")], "id int, title string"), spark.createDataFrame([(2, None)], "id int, title string")
    tables.write_reports({"x": one, "y": two}, str(tmp_path))
    tables.write_reports({"x": two}, str(tmp_path))
    assert [r.id for r in spark.read.json(str(tmp_path / "x")).collect()] == [2]
    tables.write_search_index(two, str(tmp_path / "index"))
    assert '"title":null' in "".join(p.read_text() for p in (tmp_path / "index").glob("part*"))


def test_the_last_of_repeated_changes_counts(spark):
    a = spark.createDataFrame([(1, "a", 0)], "k int, v string, t int")
    b = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", 1)], "k int, v string, t int")
    assert {r.k: r.v for r in tables.upsert(a, b, "k", "t").collect()} == {1: "new", 2: "x"}
