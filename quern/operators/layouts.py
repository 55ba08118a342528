"""Layouts of pages, the slots they fill, and route collisions of two code bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import paths
from quern.operators import route_trie
from quern.scratch import materialize

#: The layout of each content type, and what a layout must have.
LAYOUT_OF = {
    "ARTICLE": "ArticleLayout",
    "BLOG": "ArticleLayout",
    "GUIDE": "DocumentationLayout",
    "LANDING_PAGE": "LandingLayout",
    "PORTFOLIO": "PortfolioLayout",
    "GALLERY": "GalleryLayout",
    "FAQ": "DocumentationLayout",
    "DOCS": "DocumentationLayout",
}
#: Kinds of routes that suit a content type, best first, for pages and for lists.
PAGE_AFFINITY = {
    "ARTICLE": ("article", "blog", "guide"),
    "BLOG": ("blog", "article"),
    "GUIDE": ("guide", "docs", "article"),
    "LANDING_PAGE": ("landing", "faq"),
    "PORTFOLIO": ("portfolio", "gallery"),
    "GALLERY": ("gallery", "portfolio"),
    "FAQ": ("faq", "docs"),
    "DOCS": ("docs", "guide", "article"),
}
LIST_AFFINITY = {
    "ARTICLE": ("category", "blog", "search"),
    "BLOG": ("blog", "category"),
    "GUIDE": ("docs", "category"),
    "LANDING_PAGE": ("homepage", "landing"),
    "PORTFOLIO": ("portfolio", "gallery"),
    "GALLERY": ("gallery", "portfolio"),
    "FAQ": ("faq", "docs"),
    "DOCS": ("docs", "search"),
}


def layout(content: Column, node: Column, depth: Column, words: Column, images: Column, structured: Column) -> Column:
    """(layout, confidence): the content type's (ARTICLE without one), unless many images, a stub,
    a landing page, a long structured article or a page of a list call for another."""
    base = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LAYOUT_OF.items() for x in kv)), F.coalesce(content, F.lit("ARTICLE"))), F.lit("ArticleLayout"))
    made = lambda name, sure: F.struct(name.alias("layout"), F.lit(sure).alias("confidence"))
    landing = node.isin("root", "index") | (depth == 0)
    return (
        F.when(images >= 8, made(F.lit("GalleryLayout"), 0.92))
        .when((words < 50) & (images == 0) & (node == "article"), made(F.lit("MinimalLayout"), 0.80))
        .when(landing & (base != "LandingLayout"), made(F.lit("LandingLayout"), 0.85))
        .when(structured & (words > 1000) & (base == "ArticleLayout"), made(F.lit("DocumentationLayout"), 0.78))
        .when(node == "pagination", made(F.lit("IndexLayout"), 0.90))
        .otherwise(made(base, 0.75))
    )


def slots(nodes: DataFrame, routes: DataFrame) -> DataFrame:
    """(id, route, quality) for nodes (id, content, node, depth) and a blueprint's routes (ord,
    pattern, kind, dynamic): the home page for roots, list routes for lists, the best suited
    kind, else the first dynamic route, else the first.

    Each node meets the routes of the few kinds that suit it, by equi-join; of a kind, dynamic
    routes come first for pages and last for lists, then longer patterns, then order.
    """
    fallback = routes.agg(
        F.min_by("pattern", F.when(F.col("dynamic") & (F.col("kind") != "homepage"), F.col("ord"))).alias("any_dynamic"),
        F.min(F.when(F.col("dynamic") & (F.col("kind") != "homepage"), F.col("ord"))).alias("has"), F.min_by("pattern", "ord").alias("first"),
    )  # one row
    of = lambda t: F.coalesce(F.try_element_at(F.create_map(*(x for k, v in t.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("content")), F.array().cast("array<string>"))
    wish = lambda kinds, rule, list_: F.transform(kinds, lambda k, i: F.named_struct(F.lit("rule"), F.lit(rule), F.lit("rank"), i, F.lit("kind"), k, F.lit("lists"), F.lit(list_)))
    nothing = F.filter(wish(F.array(F.lit("x")), 9, False), lambda w: F.lit(False))
    root = (F.col("node") == "root") | ((F.col("depth") == 0) & (F.col("content") == "LANDING_PAGE"))
    wishes = F.concat(
        F.when(root, wish(F.array(F.lit("homepage")), 1, False)).otherwise(nothing),
        F.when(F.col("node").isin("index", "pagination"), wish(of(LIST_AFFINITY), 2, True)).otherwise(nothing),
        wish(of(PAGE_AFFINITY), 3, False),
    )
    asked = nodes.select("id", F.explode(wishes).alias("w")).select("id", "w.*")
    met = asked.join(routes, "kind")
    turn = F.when(F.col("rule") == 1, 0).when(F.col("lists") == F.col("dynamic"), 1).otherwise(0)
    order = F.struct("rule", "rank", turn, F.when(F.col("rule") == 1, 0).otherwise(-F.length("pattern")), "ord")
    quality = F.when(F.col("rule") == 1, 1.0).when(F.col("rule") == 2, 0.85).when(F.col("rank") == 0, 0.95).otherwise(0.75)
    best = met.groupBy("id").agg(F.min_by(F.struct("pattern", quality.alias("quality")), order).alias("b"))
    out = nodes.select("id").join(best, "id", "left").join(fallback, F.lit(True))
    return out.select(
        "id", F.coalesce("b.pattern", F.when(F.col("has").isNotNull(), F.col("any_dynamic")), "first").alias("route"),
        F.coalesce("b.quality", F.when(F.col("has").isNotNull(), 0.3), F.lit(0.1)).alias("quality"),
    )


def collisions(prime: DataFrame, backend: DataFrame) -> DataFrame:
    """(id, resolution, kind, other) for each route of ``prime`` against ``backend``, both (id, path,
    methods, api); ids order the backend and the first hit counts: the same path, a wildcard of
    either side, the same structure; else an API that holds one below it; else SAFE.

    Routes that are alike count as one. Paths meet in a walk of two tries, and ``**`` takes what
    is below a node by its least ids, so no route meets all others of its length. Null
    paths are the root's; routes of no methods share none; an empty side is met by nothing.
    """
    p, b = materialize(route_trie.classes(prime, "p_"), "routes"), materialize(route_trie.classes(backend, "b_"), "routes")
    any_ = lambda m: F.array_contains(m, "ANY")
    shared = F.filter("p_methods", lambda m: F.array_contains("b_methods", m) | (m == "ANY") | any_(F.col("b_methods")))
    only, some, api = F.size("p_methods") - F.size(shared), F.size(shared) > 0, F.col("p_api") | F.col("b_api")
    found = lambda df, kind, turn, resolution, other="b_id": df.select("p_path", "p_methods", "p_api", F.struct(F.col(other).alias("b_id"), F.lit(turn).alias("turn"), resolution.alias("r"), F.lit(kind).alias("k")).alias("hit")).filter("hit.r is not null")

    same = p.join(b.select("b_path", "b_methods", "b_api", "b_id"), F.col("p_path") == F.col("b_path"))
    hits = [found(same, "exact", 0, route_trie.hit(some, only, F.size("p_methods"), api))]

    met, deep = route_trie.walk(p, b, "p_", "b_")
    pairs = met.join(p.drop("p_keys", "p_segments"), F.col("a") == F.col("p_key")).join(b.drop("b_keys", "b_segments"), F.col("b") == F.col("b_key")).filter("p_path != b_path")
    hits += [
        found(pairs.filter("a_takes and p_wild"), "wildcard", 1, F.lit("BLOCK")), found(pairs.filter("b_takes and b_wild"), "wildcard", 2, F.lit("RENAME")),
        found(pairs, "parameter", 3, F.when(some, "BLOCK").when(only > 0, "MERGE")),
    ]
    # ** of a prime route takes the backend below a node, by its two least ids of different paths.
    under = route_trie.least_two(route_trie.proper_prefixes(b, "b_", "b_id", "b_path"), "prefix", "b_id", "b_path")
    taken = route_trie.least_two(deep.filter("a_side").join(under, F.col("b") == F.col("prefix")), "a", "b_id", "b_path")
    hits.append(found(p.join(taken, F.col("p_deep") == F.col("a")).filter("p_path != b_path"), "wildcard", 1, F.lit("BLOCK")))
    # ** of a backend route takes prime routes below a node: each looks its own nodes up.
    wide = route_trie.least_two(b.filter("b_deep is not null"), "b_deep", "b_id", "b_path")
    taken = route_trie.least_two(deep.filter("not a_side").join(wide, F.col("b") == F.col("b_deep")), "a", "b_id", "b_path")
    below = route_trie.proper_prefixes(p, "p_", "p_path", "p_methods", "p_api")
    hits.append(found(below.join(taken, F.col("prefix") == F.col("a")).filter("p_path != b_path"), "wildcard", 2, F.lit("RENAME")))

    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    key = ["p_path", "p_methods", "p_api"]
    first = every.groupBy(*key).agg(F.min("hit").alias("h"))
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size("b_segments") - 1, F.lit(1))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(F.transform(paths.segments(F.col("b_path")), lambda s: s["raw"]), F.lit(1), n), "/")))
    above = b.filter("b_api").select("b_id", "b_path", "b_methods", F.explode(parents).alias("above")).filter("above != b_path")
    inside = p.filter("p_api").join(above, F.col("p_path") == F.col("above")).filter(some).groupBy(*key).agg(F.min("b_id").alias("below"))
    told = p.select(*key).join(first, key, "left").join(inside, key, "left").withColumnsRenamed({k: k[2:] for k in key})
    on = [prime[k].eqNullSafe(told[k]) for k in ("path", "methods", "api")]
    return prime.join(told, on[0] & on[1] & on[2]).select(
        "id", F.coalesce("h.r", F.when(F.col("below").isNotNull(), "RENAME"), F.lit("SAFE")).alias("resolution"),
        F.coalesce("h.k", F.when(F.col("below").isNotNull(), "api")).alias("kind"), F.coalesce("h.b_id", "below").alias("other"),
    )
