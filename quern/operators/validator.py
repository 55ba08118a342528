"""Validation of site graphs: coded issues as rows, from counts a site and rules over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.scratch import materialize

#: Section, severity, code, when it is raised, and the figure that goes with it.
RULES = (
    ("routes", "warning", "ROUTE_COLLISIONS", "collisions > 0", "collisions"),
    ("routes", "error", "MISSING_ROUTES", "routed < content", "content - routed"),
    ("routes", "warning", "UNSAFE_ROUTE_CHARS", "unsafe > 0", "unsafe"),
    ("routes", "warning", "FALLBACK_ROUTES", "fallback > 0", "fallback"),
    ("navigation", "error", "HIGH_ORPHAN_RATIO", "nodes > 0 and orphans / nodes > 0.5", "orphans"),
    ("navigation", "warning", "ELEVATED_ORPHAN_COUNT", "nodes > 0 and orphans / nodes > 0.2 and orphans / nodes <= 0.5", "orphans"),
    ("navigation", "error", "BROKEN_PARENT_REFS", "broken > 0", "broken"),
    ("navigation", "warning", "DUPLICATE_PATHS", "duplicate_paths > 0", "duplicate_paths"),
    ("navigation", "warning", "EMPTY_PRIMARY_NAV", "primary_items = 0 and nodes > 5", "nodes"),
    ("assets", "error", "HIGH_MISSING_ASSET_RATIO", "assets > 0 and missing / assets > 0.3", "missing"),
    ("assets", "warning", "MISSING_ASSETS", "missing > 0 and not (assets > 0 and missing / assets > 0.3)", "missing"),
    ("assets", "warning", "DUPLICATE_ASSETS", "duplicate_assets > 0", "duplicate_assets"),
    ("assets", "warning", "ORPHAN_ASSETS", "orphan_assets > 0", "orphan_assets"),
    ("assets", "warning", "UNRESOLVED_BINDINGS", "unbound > 0", "unbound"),
    ("layouts", "error", "MISSING_LAYOUT_ASSIGNMENTS", "laid_out < content", "content - laid_out"),
    ("layouts", "warning", "LOW_CONFIDENCE_LAYOUTS", "unsure_layouts > 0", "unsure_layouts"),
    ("layouts", "warning", "EXCESSIVE_MINIMAL_LAYOUTS", "minimal > content * 0.3", "minimal"),
    ("categories", "warning", "HIGH_UNCATEGORIZED_RATIO", "content > 0 and uncategorized / content > 0.5", "uncategorized"),
    ("categories", "warning", "EMPTY_CATEGORIES", "empty_categories > 0", "empty_categories"),
    ("classification", "error", "UNCLASSIFIED_NODES", "classified < content", "content - classified"),
    ("classification", "warning", "LOW_CLASSIFICATION_CONFIDENCE", "unsure_kinds > classified * 0.4", "unsure_kinds"),
)
SECTIONS = ("routes", "navigation", "assets", "layouts", "categories", "classification")


def cycles(parents: DataFrame) -> DataFrame:
    """(node) on a cycle of (node, parent), one parent a node. Each round doubles how far a node
    looks up, so there are as many as the logarithm of the nodes, whatever the depth; ways
    that reach a top are out, and after so many steps all others stand on a cycle."""
    one = parents.filter("node is not null and parent is not null").groupBy("node").agg(F.min("parent").alias("up"))
    one = materialize(one, "ups")
    steps, n = 1, one.count()
    while steps < n:
        on = one.select(F.col("node").alias("_n"), F.col("up").alias("_up"))
        one = materialize(one.join(on, F.col("up") == F.col("_n")).select("node", F.col("_up").alias("up")), "ups")
        steps *= 2
    return one.join(one.select(F.col("node").alias("_n")), F.col("up") == F.col("_n"), "left_semi").select(F.col("up").alias("node")).distinct()


def measures(nodes: DataFrame, assets: DataFrame, categories: DataFrame) -> DataFrame:
    """A row of counts a site, from nodes (site, node, parent, depth, url, content, route, source,
    layout, layout_confidence, category, kind, kind_confidence), assets (site, checksum,
    missing, uses, bound) and categories (site, category, pages).

    A node below the top without a parent, with one that is not there or on another level,
    is an orphan. Null counts as not given: no route, no layout, no kind, no category; what is
    null in ``content`` is no content. A site without assets or categories has none.
    """
    parent = nodes.select(F.col("site").alias("_s"), F.col("node").alias("_p"), F.col("depth").alias("_d")).groupBy("_s", "_p").agg(F.min("_d").alias("_d"))
    known = nodes.join(parent, (F.col("site") == F.col("_s")) & (F.col("parent") == F.col("_p")), "left")
    below = F.coalesce(F.col("depth") > 0, F.lit(False))
    broken = below & F.col("parent").isNotNull() & F.col("_p").isNull()
    orphan = below & (F.col("parent").isNull() | F.col("_p").isNull() | (F.col("depth") != F.col("_d") + 1))
    content = F.coalesce("content", F.lit(False))
    route = F.when(content, F.col("route"))
    low = lambda c, bar: F.coalesce(F.col(c) < bar, F.lit(False))
    count = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
    per = known.groupBy("site").agg(
        F.count(F.lit(1)).alias("nodes"), count(content, "content"), F.count(route).alias("routed"), count(route.rlike(r"[^a-z0-9\-_/]"), "unsafe"), count(F.col("source") == "node_id_fallback", "fallback"),
        count(orphan, "orphans"), count(broken, "broken"), count(F.col("depth") == 1, "primary_items"), F.count(F.when(content, F.col("layout"))).alias("laid_out"),
        count(low("layout_confidence", 0.5), "unsure_layouts"), count(F.col("layout") == "MinimalLayout", "minimal"), count(content & F.col("category").isNull(), "uncategorized"),
        F.count(F.when(content, F.col("kind"))).alias("classified"), count(low("kind_confidence", 0.3), "unsure_kinds"),
    )

    def repeats(df: DataFrame, key, name: str, value: str = "1") -> DataFrame:
        groups = df.withColumn("_key", key).filter("_key is not null").groupBy("site", "_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        return groups.groupBy(F.col("site").alias("_site")).agg(F.expr(f"sum({value})").alias(name))

    tables = [
        repeats(nodes.filter("content"), F.col("route"), "collisions", "_n - 1"), repeats(nodes, F.regexp_replace(F.lower("url"), "/$", ""), "duplicate_paths"), repeats(assets, F.col("checksum"), "duplicate_assets"),
        assets.groupBy(F.col("site").alias("_site")).agg(F.count(F.lit(1)).alias("assets"), count(F.col("missing"), "missing"), count(F.coalesce("uses", F.lit(0)) == 0, "orphan_assets"), count(~F.col("bound"), "unbound")),
        categories.groupBy(F.col("site").alias("_site")).agg(count(F.coalesce("pages", F.lit(0)) == 0, "empty_categories")),
    ]
    for t in tables:
        names = [c for c in t.columns if c != "_site"]
        per = per.join(t, F.col("site") == F.col("_site"), "left").select(*(c for c in per.columns), *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in names))
    return per


def issues(measured: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(site, section, severity, code, n): a row for each rule that holds; rules may be others."""
    raised = [F.when(F.expr(test), F.struct(F.lit(section).alias("section"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.expr(n).cast("long").alias("n"))) for section, severity, code, test, n in rules]
    return measured.select("site", F.explode(F.array_compact(F.array(*raised))).alias("i")).select("site", "i.*")


def report(measured: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(site, grade, errors, warnings, renderable, grades): FAIL with an error, PARTIAL_PASS with a
    warning, else PASS, of the site and as a map of its sections. A site cannot be rendered
    without content, nor where routes, layouts or classification fail."""
    found = issues(measured, rules).groupBy("site", "section").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    grade = lambda e, w: F.when(e > 0, "FAIL").when(w > 0, "PARTIAL_PASS").otherwise("PASS")
    every = measured.select(F.col("site").alias("s"), "content", F.explode(F.array(*map(F.lit, SECTIONS))).alias("sec"))
    per = every.join(found, (F.col("s") == F.col("site")) & (F.col("sec") == F.col("section")), "left").na.fill(0, ["e", "w"])
    blocked = F.bool_or((F.col("content") == 0) | ((F.col("e") > 0) & F.col("sec").isin("routes", "layouts", "classification")))
    return per.groupBy(F.col("s").alias("site")).agg(
        grade(F.sum("e"), F.sum("w")).alias("grade"), F.sum("e").alias("errors"), F.sum("w").alias("warnings"), (~blocked).alias("renderable"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("sec", grade(F.col("e"), F.col("w")))))).alias("grades"),
    )
