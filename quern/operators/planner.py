"""What a crawled site's pages ask of a code base: endpoints, layouts, and routes that no page uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import paths
from quern.operators import route_trie
from quern.operators.grams import meetings

#: Words in the name of a component that tell its layout.
LAYOUT_WORDS = {
    "ArticleLayout": ("article", "post", "blog-post", "blogpost", "single", "content"),
    "GalleryLayout": ("gallery", "grid", "masonry", "photo", "image", "portfolio-grid"),
    "LandingLayout": ("landing", "home", "hero", "marketing", "front", "splash"),
    "DocumentationLayout": ("docs", "documentation", "guide", "reference", "manual", "wiki"),
    "PortfolioLayout": ("portfolio", "casestudy", "case-study", "project", "work"),
    "IndexLayout": ("index", "list", "archive", "category", "tag", "feed", "blog"),
    "MinimalLayout": ("minimal", "simple", "bare", "clean", "empty", "shell"),
}
#: Slots that each layout must have, and what is said where one is missing.
LAYOUT_SLOTS = {
    "ArticleLayout": ("header", "footer", "nav"),
    "GalleryLayout": ("header", "footer", "nav"),
    "LandingLayout": ("header", "footer", "nav"),
    "DocumentationLayout": ("header", "footer", "nav", "sidebar"),
    "PortfolioLayout": ("header", "footer", "nav"),
    "IndexLayout": ("header", "footer", "nav"),
    "MinimalLayout": (),
}
MISSING = {"header": "missing <header>", "footer": "missing <footer>", "nav": "missing <nav>", "sidebar": "missing <aside/sidebar>"}


def endpoint_path(path: Column) -> Column:
    """An endpoint's path with parameters and catch-alls as ``[name]``, without slashes at its end."""
    return F.regexp_replace(F.regexp_replace(paths.bracketed(path), r"\[\[?\.{0,3}(\w+)\]?\]", "[$1]"), "/+$", "")


def _walked(paths_: DataFrame, tag: str) -> DataFrame:
    """Distinct paths (path) as ways of a trie; open segments are ``:``, others start with ``=``."""
    names = F.transform(paths.pieces(F.col("path")), lambda s: F.when(s.startswith("["), ":").otherwise(F.concat(F.lit("="), s)))
    named = paths_.select("path", names.alias("segments"))
    keys = F.transform(F.sequence(F.lit(0), F.size("segments")), lambda n: F.array_join(F.slice("segments", F.lit(1), n), "/"))
    return named.select(F.col("path").alias(f"{tag}path"), F.col("segments").alias(f"{tag}segments"), keys.alias(f"{tag}keys"), F.array_join("segments", "/").alias(f"{tag}key"))


def endpoint_matches(apis: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, path, action, confidence, serves): what becomes of each of ``apis`` (id, path) for the
    paths of ``pages`` (path), and the endpoints that they ask for and that are not there.

    A page without a bracket asks for ``/api`` and its own path. An endpoint serves pages if its
    path can be such a one (of one length, each segment equal or one of both open), or if a
    segment of a page holds one of its literal segments or lies in one of its segments, ``api``
    itself aside. It is left alone either way (IGNORE 0.82, else 0.95). An endpoint that is asked
    for and that none can be is a CREATE (0.65, no id).

    Both sides are walked as tries, and segments meet by their grams: neither compares endpoints
    with pages. Null paths are left out; repeated pages count once, repeated ids are rows.
    """
    a = apis.filter("path is not null").select("id", "path", endpoint_path(F.col("path")).alias("_own"))
    p = pages.filter("path is not null").select("path").distinct()
    asked = p.filter(~F.contains("path", F.lit("[")) & (F.size(paths.pieces(F.col("path"))) > 0))
    asked = asked.select(F.concat(F.lit("/api/"), F.array_join(paths.pieces(F.col("path")), "/")).alias("asked")).distinct()
    wanted = asked.select("asked", endpoint_path(F.col("asked")).alias("path"))

    there = _walked(a.select(F.col("_own").alias("path")).distinct(), "a_")
    ways = _walked(wanted.select("path").distinct(), "w_")
    met, _ = route_trie.walk(there, ways, "a_", "w_")
    ended = met.join(there.select(F.col("a_key").alias("a"), "a_path"), "a").join(ways.select(F.col("w_key").alias("b"), "w_path"), "b")
    asked_for = ended.select(F.col("a_path").alias("_own")).distinct()
    made = ended.select(F.col("w_path").alias("path")).distinct()

    own = a.select("id", F.explode(paths.pieces(F.col("_own"))).alias("segment")).filter("segment != 'api'")
    of_pages = p.select(F.explode(paths.pieces(F.col("path"))).alias("segment")).filter("segment != 'api'").distinct()
    held = meetings(of_pages.withColumnRenamed("segment", "hay"), own.filter("segment not like '[%'").select(F.col("segment").alias("needle"))).select(F.col("needle").alias("segment"))
    holding = meetings(own.select(F.col("segment").alias("hay")), of_pages.withColumnRenamed("segment", "needle")).select(F.col("hay").alias("segment"))
    near = own.join(held.distinct().union(holding.distinct()).distinct(), "segment", "left_semi").select("id").distinct()

    told = a.join(asked_for.withColumn("_asked", F.lit(True)), "_own", "left").join(near.withColumn("_near", F.lit(True)), "id", "left")
    serves = F.coalesce("_asked", "_near", F.lit(False))
    kept = told.select("id", "path", F.lit("IGNORE").alias("action"), F.when(serves, 0.82).otherwise(0.95).alias("confidence"), serves.alias("serves"))
    new = wanted.join(made, "path", "left_anti")
    id_ = F.lit(None).cast(apis.schema["id"].dataType)
    return kept.unionByName(new.select(id_.alias("id"), F.col("asked").alias("path"), F.lit("CREATE").alias("action"), F.lit(0.65).alias("confidence"), F.lit(False).alias("serves")))


def layout_score(name: Column, layout: str) -> Column:
    """How well a component's name tells ``layout``: 1 for each of its words held, 5 for the name
    itself, 2 for its end; case does not count."""
    low, whole = F.lower(name), layout.lower()
    words = sum((F.contains(low, F.lit(w)).cast("int") for w in LAYOUT_WORDS[layout]), F.lit(0))
    return words + F.when(low == whole, 5).otherwise(0) + F.when(F.endswith(low, F.lit(whole.replace("layout", ""))), 2).otherwise(0)


def layout_matches(found: DataFrame, assigned: DataFrame) -> DataFrame:
    """(layout, pages, action, confidence, id, name, score, missing) for each layout that pages
    (``assigned``: layout) have and each of ``found`` (ord, id, name, slots) that none needs.

    The component whose name scores best serves a layout, the first of equals. It is EXTENDed if
    it has all slots that the layout must have (0.92, with a score under 3: 0.75), else UPDATEd
    (0.8, 0.6) with what is missing; none: CREATE (0.85). The others are ARCHIVEd (0.55).
    Only layouts of ``LAYOUT_SLOTS`` take part; a component without slots has none.
    """
    need = assigned.filter(F.col("layout").isin(*LAYOUT_SLOTS)).groupBy("layout").agg(F.count(F.lit(1)).alias("pages"))
    scores = F.array(*(F.struct(F.lit(k).alias("layout"), layout_score(F.col("name"), k).alias("score")) for k in LAYOUT_SLOTS))
    told = found.filter("name is not null").select("ord", "id", "name", F.coalesce("slots", F.array().cast("array<string>")).alias("slots"), F.explode(scores).alias("s")).filter("s.score > 0")
    best = told.groupBy(F.col("s.layout").alias("layout")).agg(F.max_by(F.struct("id", "name", "slots", "s.score"), F.struct("s.score", -F.col("ord"))).alias("b"))
    required = F.create_map(*(x for k, v in LAYOUT_SLOTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    lacking = F.transform(F.array_except(F.try_element_at(required, F.col("layout")), F.col("b.slots")), lambda s: F.try_element_at(F.create_map(*(F.lit(x) for kv in MISSING.items() for x in kv)), s))
    none, sure = F.col("b").isNull(), F.col("b.score") >= 3
    decided = need.join(best, "layout", "left").withColumn("missing", F.when(~none, lacking))
    whole = F.size("missing") == 0
    out = decided.select(
        "layout", "pages", F.when(none, "CREATE").when(whole, "EXTEND").otherwise("UPDATE").alias("action"),
        F.when(none, 0.85).when(whole, F.when(sure, 0.92).otherwise(0.75)).otherwise(F.when(sure, 0.8).otherwise(0.6)).alias("confidence"),
        "b.id", "b.name", "b.score", "missing",
    )
    unused = found.join(out.select("id"), "id", "left_anti")
    gone = unused.select(
        F.lit(None).cast("string").alias("layout"), F.lit(None).cast("long").alias("pages"), F.lit("ARCHIVE").alias("action"), F.lit(0.55).alias("confidence"),
        "id", "name", F.lit(None).cast("int").alias("score"), F.lit(None).cast("array<string>").alias("missing"),
    )
    return out.unionByName(gone)


def unused_routes(routes: DataFrame, used: DataFrame) -> DataFrame:
    """(ord, pattern, action, confidence) for ``routes`` (ord, pattern, api, orphan) that no row of
    ``used`` (ord) names: an API's is left alone (0.99), others are ARCHIVEd (orphans 0.7, else 0.6)."""
    left = routes.join(used.filter("ord is not null").select("ord").distinct(), "ord", "left_anti")
    return left.select(
        "ord", "pattern", F.when(F.col("api"), "IGNORE").otherwise("ARCHIVE").alias("action"), F.when(F.col("api"), 0.99).when(F.col("orphan"), 0.7).otherwise(0.6).alias("confidence")
    )
