"""Stored objects bound to the nodes of manifests: by key, by the node in the key, or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that a node's files lie in, and the kind of each.
FOLDERS = {"images": "image", "embeds": "embed", "videos": "video"}
#: What a folder holds, for objects that no node has.
CATEGORIES = {
    "images/": "image", "videos/": "video", "audio/": "audio", "embeds/": "embed", "content/": "html", "documents/": "document", "dom/": "dom", "metadata/": "metadata",
}
#: Files of a job that are never anyone's.
KEPT = {"_manifest.json": "manifest-json", "_manifest.zip": "manifest-zip", "index.html": "root-html"}
#: Why an object is no node's, by its kind and whether the manifest has the node it names.
REASONS = {
    "image unknown": "image folder nodeId {node} has no matching manifest node — possible redirect or crawl-scope mismatch",
    "image linked": "image nodeId {node} matches a manifest node but asset was not linked",
    "video linked": "video nodeId {node} matches manifest node but was not linked",
    "video unknown": "video nodeId {node} has no matching manifest node",
    "embed linked": "embed nodeId {node} matches manifest node but was not linked",
    "embed unknown": "embed nodeId {node} has no matching manifest node",
    "page": "HTML page present in R2 but not referenced by any manifest node storage path",
    "other": "no manifest reference found for this R2 key",
}
_JOB = r"^jobs/([^/]+)/([\s\S]*)$"


def _placed(objects: DataFrame) -> DataFrame:
    """Objects with the job, the path in it, and the kind and node that the path names."""
    rel = F.regexp_extract("key", _JOB, 2)
    o = objects.filter("key is not null").select("*", F.regexp_extract("key", _JOB, 1).alias("job"), rel.alias("rel"))
    group = r"^(images|videos|embeds)/([0-9a-f]{16})/"
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in FOLDERS.items() for x in kv)), F.regexp_extract("rel", group, 1))
    return o.withColumns({"kind": kind, "group": F.nullif(F.regexp_extract("rel", group, 2), F.lit(""))})


def bindings(nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """(job, node, kind, key, source, confidence, present) for nodes (job, id, cloud, local,
    images, videos) and objects (ord, key).

    A node's page is the key that its manifest states (1.0), else that of its local path (0.9),
    else the first object (by ord) under ``content/`` whose folder is the node's id (0.5), else a
    key made of the id (0.3); the first two need not be there. Its images, embeds and videos are
    the objects in folders of its id: 1.0 if the manifest lists the key (as an image, or as a
    video for embeds), else 0.9. One object may be several nodes' page; repeated nodes are rows.
    """
    o = _placed(objects)
    n = nodes.filter("id is not null").select("job", F.col("id").alias("node"), F.nullif(F.trim("cloud"), F.lit("")).alias("cloud"), F.nullif(F.trim("local"), F.lit("")).alias("local"), "images", "videos")
    whole = objects.filter("key is not null").select("key").distinct().withColumn("present", F.lit(True))
    at = r"^content/(?:[\s\S]*/)?([^/]+)/index\.html$"
    scanned = o.select("job", "ord", "key", F.regexp_extract("rel", at, 1).alias("node")).filter("node != ''").groupBy("job", "node").agg(F.min_by("key", "ord").alias("scanned"))
    stated = n.filter("cloud is not null or local is not null")
    own = stated.select(
        "job", "node", F.coalesce("cloud", F.concat(F.lit("jobs/"), F.col("job"), F.lit("/"), F.col("local"))).alias("key"),
        F.when(F.col("cloud").isNotNull(), "manifest-ref").otherwise("url-pattern").alias("source"), F.when(F.col("cloud").isNotNull(), 1.0).otherwise(0.9).alias("confidence"),
    )
    own = own.join(whole, "key", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    rest = n.filter("cloud is null and local is null").join(scanned, ["job", "node"], "left")
    found = F.col("scanned").isNotNull()
    made = F.concat(F.lit("jobs/"), F.col("job"), F.lit("/content/"), F.col("node"), F.lit("/index.html"))
    rest = rest.select("job", "node", F.coalesce("scanned", made).alias("key"), F.lit("fallback").alias("source"), F.when(found, 0.5).otherwise(0.3).alias("confidence"), found.alias("present"))
    pages = own.unionByName(rest).withColumn("kind", F.lit("html"))

    assets = o.filter("kind is not null").select("job", F.col("group").alias("node"), "kind", "key")
    listed = F.when(F.col("kind") == "image", F.array_contains("images", F.col("key"))).when(F.col("kind") == "embed", F.array_contains("videos", F.col("key")))
    ref = F.coalesce(listed, F.lit(False))
    bound = n.join(assets, ["job", "node"]).select(
        "job", "node", "kind", "key", F.when(ref, "manifest-ref").otherwise("url-pattern").alias("source"), F.when(ref, 1.0).otherwise(0.9).alias("confidence"), F.lit(True).alias("present")
    )
    return pages.unionByName(bound).select("job", "node", "kind", "key", "source", "confidence", "present")


def _reason(known: Column) -> Column:
    state = F.when(F.col("kind").isNotNull(), F.concat("kind", F.when(known, F.lit(" linked")).otherwise(F.lit(" unknown")))).when(F.col("rel").startswith("content/"), "page").otherwise("other")
    return F.replace(F.try_element_at(F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv)), state), F.lit("{node}"), F.coalesce("group", F.lit("")))


def orphans(nodes: DataFrame, objects: DataFrame, bound: DataFrame) -> DataFrame:
    """(job, key, category, reason) for objects of the nodes' jobs that ``bound`` (of
    :func:`bindings`) does not claim, but for a job's manifest and front page."""
    claimed = bound.filter("present").select("key").distinct()
    o = _placed(objects).join(nodes.select("job").distinct(), "job", "left_semi").filter(~F.col("rel").isin(*KEPT)).join(claimed, "key", "left_anti")
    known = nodes.select("job", F.col("id").alias("group")).distinct().withColumn("known", F.lit(True))
    o = o.join(known, ["job", "group"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    category = F.coalesce(*(F.when(F.col("rel").startswith(folder), name) for folder, name in CATEGORIES.items()), F.lit("unknown"))
    return o.select("job", "key", category.alias("category"), _reason(F.col("known")).alias("reason"))


def summary(nodes: DataFrame, objects: DataFrame, bound: DataFrame) -> DataFrame:
    """(job, nodes, objects, claimed, unclaimed): a job's own objects; claimed are the different keys
    that its nodes have, and its manifest and front page where they are there."""
    o = _placed(objects).join(nodes.select("job").distinct(), "job", "left_semi")
    total = o.groupBy("job").agg(F.count(F.lit(1)).alias("objects"), F.countDistinct(F.when(F.col("rel").isin(*KEPT), F.col("key"))).alias("_kept"))
    claimed = bound.filter("present").select("job", "key").distinct().groupBy("job").agg(F.count(F.lit(1)).alias("_claimed"))
    left = orphans(nodes, objects, bound).groupBy("job").agg(F.count(F.lit(1)).alias("unclaimed"))
    every = nodes.groupBy("job").agg(F.count(F.lit(1)).alias("nodes"))
    joined = every.join(total, "job", "left").join(claimed, "job", "left").join(left, "job", "left").na.fill(0)
    return joined.select("job", "nodes", "objects", (F.col("_claimed") + F.col("_kept")).alias("claimed"), "unclaimed")
