"""Queries over a code base and its stored objects; pages and documents stand in for files and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import bindings, imports
from quern.registry import query
from quern.sources.tables import table

#: A fixture, the same text in Spark and DuckDB, with no backslash in it: pages as files.
_TYPE = "CASE page_id % 4 WHEN 0 THEN 'route' WHEN 1 THEN 'component' WHEN 2 THEN 'api' ELSE 'layout' END"
_PATH = f"""'src/' || {_TYPE} || 's/' || CASE page_id % 3 WHEN 0 THEN 'Card' WHEN 1 THEN 'Menu' ELSE 'wideview' END || page_id || CASE page_id % 5 WHEN 0 THEN '/index.tsx' WHEN 1 THEN '.ts' ELSE '.jsx' END"""
_ROUTE = "'/r/' || (page_id % 60)"
_CODE = """html || ' import { A } from "@/components/Card' || (page_id % 50) || '"; import B from "../Menu' || (page_id % 20) || '"; import r from "react"; import i from "view' || (page_id % 90) || '"; import s from "x/"; '
 || 'connect(process.env.DB_URL_' || (page_id % 9) || '); <a href="/r/' || (page_id % 70) || '?a">x</a><a href="/r/' || (page_id % 11) || '">y</a> redirect("/r/' || (page_id % 7) || '")'"""
_VARS = "CASE s_suppkey % 3 WHEN 0 THEN 'DB_URL_' || (s_suppkey % 9) WHEN 1 THEN 'URL_' || (s_suppkey % 12) ELSE 'KEY_' || s_suppkey END"
_FILE = "'src/apis/Card' || (s_suppkey * 6) || '.jsx'"


@query(rf"""
WITH n AS (SELECT page_id AS id, {_TYPE} AS type, {_PATH} AS path, {_ROUTE} AS route, {_CODE} AS content FROM pages), t AS (SELECT id, regexp_replace(path, '\.[tj]sx?$', '') AS fp FROM n WHERE type = 'component'),
r AS (SELECT DISTINCT id, type, unnest(regexp_extract_all(content, 'import\s+.*?from\s+[''"]([^''"]+)[''"]', 1)) AS raw FROM n WHERE type IN ('route', 'component')), i AS (SELECT id, type, replace(regexp_replace(raw, '^[@~]/', 'src/'), '\', '/') AS name FROM r),
c AS (SELECT DISTINCT i.id, i.type, t.id AS other FROM i JOIN t ON string_split(name, '/')[-1] <> '' AND (ends_with(fp, name) OR ends_with(fp, name || '/index') OR contains(fp, '/' || string_split(name, '/')[-1])) WHERE i.type = 'route' OR i.id <> t.id),
s AS (SELECT s_suppkey AS id, (s_suppkey % 10) / 10.0 AS sure, {_VARS} AS var, {_FILE} AS file FROM supplier), d AS (SELECT n.id, n.type, s.id AS other, sure FROM n JOIN s ON n.path = s.file OR contains(n.content, s.var) WHERE type IN ('route', 'api')),
k AS (SELECT route, max(id) AS other FROM n WHERE type = 'route' GROUP BY route),
l AS (SELECT id, 'route-links-route' AS kind, unnest(regexp_extract_all(content, 'href=[''"`](/[^''"`?#]+)', 1)) AS route FROM n WHERE type = 'route'
  UNION ALL SELECT id, 'route-redirects-route', unnest(regexp_extract_all(content, '(?:redirect|useRouter|router\.push)\s*\(\s*[''"`](/[^''"`?#]+)', 1)) FROM n WHERE type = 'route'),
w AS (SELECT a.id, b.id AS other FROM n a JOIN n b ON a.type = 'layout' AND b.type = 'route' AND b.id IN (a.id + 1, a.id + 5, a.id + 6))
SELECT 'layout-wraps-route' AS kind, id AS from_id, 'layout' AS from_type, other AS to_id, 'route' AS to_type, 0.95::DOUBLE AS confidence, CAST(1 AS BIGINT) AS n FROM w
UNION ALL SELECT 'route-uses-layout', other, 'route', id, 'layout', 0.95, 1 FROM w
UNION ALL SELECT CASE type WHEN 'route' THEN 'route-uses-component' ELSE 'component-imports-component' END, id, type, other, 'component', CASE type WHEN 'route' THEN 0.9 ELSE 0.85 END, 1 FROM c
UNION ALL SELECT type || '-uses-datasource', id, type, other, 'datasource', round(sure * CASE type WHEN 'route' THEN 0.8 ELSE 0.85 END, 6), 1 FROM d
UNION ALL SELECT kind, id, 'route', other, 'route', CASE kind WHEN 'route-links-route' THEN 0.7 ELSE 0.75 END, count(*) FROM l JOIN k USING (route) WHERE id <> other GROUP BY ALL
""")
def code_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a code base whose files are pages with imports, links and variables behind them."""
    p = table(spark, sf_dir, "pages")
    nodes = p.select(F.col("page_id").alias("ord"), F.col("page_id").alias("id"), F.expr(_TYPE).alias("type"), F.expr(_PATH).alias("path"), F.expr(_ROUTE).alias("route"), F.expr(_CODE).alias("content"))
    wraps = nodes.filter("type = 'layout'").select(F.col("id").alias("layout"), F.expr("array(id + 1, id + 5, id + 6)").alias("routes"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("s_suppkey % 10 / 10.0D").alias("confidence"), F.expr(f"array({_FILE})").alias("files"), F.expr(f"array({_VARS})").alias("vars"))
    return imports.relationships(nodes, wraps, sources)


def _node(fn: str) -> str:
    return f"substr({fn.format('CAST(doc_id AS STRING)')}, 1, 16)"


def _key(fn: str, shift: int = 0) -> str:
    """The object of each document, as the same text in both engines; ``shift`` names another node."""
    id_ = f"substr({fn.format(f'CAST(doc_id + {shift} AS STRING)')}, 1, 16)"
    return (
        f"'jobs/j' || (doc_id % 3) || CASE doc_id % 10 WHEN 0 THEN '/images/' || {id_} || '/a.jpg' WHEN 1 THEN '/embeds/' || {id_} || '/b' WHEN 2 THEN '/videos/' || {id_} || '/c.mp4' WHEN 3 THEN '/content/p/' || {id_} || '/index.html'"
        f" WHEN 4 THEN '/content/' || {id_} || '/index.html' WHEN 5 THEN '/pages/' || doc_id WHEN 6 THEN '/content/x' || doc_id WHEN 7 THEN '/audio/' || doc_id WHEN 8 THEN CASE WHEN doc_id % 20 = 8 THEN '/index.html' ELSE '/odd' END ELSE '/dom/' || doc_id END"
    )


_SPARK, _DUCK = "sha2({}, 256)", "sha256({})"
_CLOUD = "CASE WHEN doc_id % 7 = 0 THEN 'jobs/j' || (doc_id % 3) || '/pages/' || (doc_id - doc_id % 4 + 5) WHEN doc_id % 7 = 1 THEN '  ' END"
_LOCAL = "CASE WHEN doc_id % 5 = 0 THEN 'pages/' || doc_id WHEN doc_id % 5 = 1 THEN '' END"
_BOUND_SQL = rf"""
WITH d AS (SELECT doc_id, 'j' || doc_id % 3 AS job, {_node(_DUCK)} AS node, nullif(trim({_CLOUD}), '') AS cloud, nullif({_LOCAL}, '') AS local, {_key(_DUCK)} AS held FROM documents), o AS (SELECT doc_id AS ord, {_key(_DUCK)} AS key FROM documents UNION ALL SELECT doc_id + 1000000, {_key(_DUCK, 3)} FROM documents WHERE doc_id % 6 = 0),
q AS (SELECT *, regexp_extract(key, '^jobs/([^/]+)/', 1) AS job, regexp_extract(key, '^jobs/[^/]+/(.*)$', 1) AS rel, regexp_extract(key, '^jobs/[^/]+/(images|videos|embeds)/[0-9a-f]{{16}}/', 1) AS folder, regexp_extract(key, '^jobs/[^/]+/(?:images|videos|embeds)/([0-9a-f]{{16}})/', 1) AS grp, regexp_extract(key, '^jobs/[^/]+/content/(?:.*/)?([^/]+)/index[.]html$', 1) AS page FROM o),
f AS (SELECT job, page AS node, arg_min(key, ord) AS key FROM q WHERE page <> '' GROUP BY ALL),
h AS (SELECT d.job, d.node, 'html' AS kind, CASE WHEN cloud IS NOT NULL THEN cloud WHEN local IS NOT NULL THEN 'jobs/' || d.job || '/' || local ELSE coalesce(f.key, 'jobs/' || d.job || '/content/' || d.node || '/index.html') END AS key,
  CASE WHEN cloud IS NOT NULL THEN 'manifest-ref' WHEN local IS NOT NULL THEN 'url-pattern' ELSE 'fallback' END AS source, CASE WHEN cloud IS NOT NULL THEN 1.0 WHEN local IS NOT NULL THEN 0.9 WHEN f.key IS NOT NULL THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM d LEFT JOIN f ON f.job = d.job AND f.node = d.node),
a AS (SELECT d.job, d.node, substr(folder, 1, length(folder) - 1) AS kind, q.key, CASE WHEN folder <> 'videos' AND d.doc_id % 2 = 0 AND q.key = held THEN 'manifest-ref' ELSE 'url-pattern' END AS source FROM q JOIN d ON q.job = d.job AND q.grp = d.node AND folder <> ''),
b AS (SELECT *, key IN (SELECT key FROM o) AS present FROM h UNION ALL SELECT job, node, kind, key, source, CASE source WHEN 'manifest-ref' THEN 1.0 ELSE 0.9 END, true FROM a),
c AS (SELECT q.*, EXISTS (SELECT 1 FROM d WHERE d.job = q.job AND d.node = q.grp) AS known FROM q WHERE key NOT IN (SELECT key FROM b WHERE present) AND rel NOT IN ('_manifest.json', '_manifest.zip', 'index.html') AND job IN (SELECT job FROM d))
"""


def _bound(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id")
    held = F.expr(f"CASE WHEN doc_id % 2 = 0 THEN array({_key(_SPARK)}) END")
    nodes = d.select(F.expr("'j' || doc_id % 3").alias("job"), F.expr(_node(_SPARK)).alias("id"), F.expr(_CLOUD).alias("cloud"), F.expr(_LOCAL).alias("local"), held.alias("images"), held.alias("videos"))
    more = d.filter("doc_id % 6 = 0").select(F.expr("doc_id + 1000000").alias("ord"), F.expr(_key(_SPARK, 3)).alias("key"))
    objects = d.select(F.col("doc_id").alias("ord"), F.expr(_key(_SPARK)).alias("key")).unionByName(more)
    return nodes, objects, bindings.bindings(nodes, objects)


@query(_BOUND_SQL + "SELECT job, node, kind, key, source, confidence, present FROM b")
def manifest_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and files of each node (from documents) among the objects of three jobs."""
    return _bound(spark, sf_dir)[2]


@query(_BOUND_SQL + """SELECT job, key, CASE split_part(rel, '/', 1) WHEN 'images' THEN 'image' WHEN 'videos' THEN 'video' WHEN 'embeds' THEN 'embed' WHEN 'content' THEN 'html' WHEN 'audio' THEN 'audio' WHEN 'dom' THEN 'dom' ELSE 'unknown' END AS category,
  CASE WHEN folder = 'images' THEN CASE WHEN known THEN 'image nodeId ' || grp || ' matches a manifest node but asset was not linked' ELSE 'image folder nodeId ' || grp || ' has no matching manifest node — possible redirect or crawl-scope mismatch' END
  WHEN folder <> '' THEN substr(folder, 1, length(folder) - 1) || ' nodeId ' || grp || CASE WHEN known THEN ' matches manifest node but was not linked' ELSE ' has no matching manifest node' END
  WHEN starts_with(rel, 'content/') THEN 'HTML page present in R2 but not referenced by any manifest node storage path' ELSE 'no manifest reference found for this R2 key' END AS reason FROM c""")
def orphan_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that no node claims, and why."""
    nodes, objects, bound = _bound(spark, sf_dir)
    return bindings.orphans(nodes, objects, bound)


@query(_BOUND_SQL + """SELECT job, (SELECT count(*) FROM d WHERE d.job = j.job) AS nodes, (SELECT count(*) FROM q WHERE q.job = j.job) AS objects,
  (SELECT count(DISTINCT key) FROM b WHERE present AND b.job = j.job) + (SELECT count(DISTINCT key) FROM q WHERE q.job = j.job AND rel IN ('_manifest.json', '_manifest.zip', 'index.html')) AS claimed, (SELECT count(*) FROM c WHERE c.job = j.job) AS unclaimed FROM (SELECT DISTINCT job FROM d) j""")
def binding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each job's objects its nodes claim."""
    return bindings.summary(*_bound(spark, sf_dir))
