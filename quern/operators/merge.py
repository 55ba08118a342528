"""Merge plans: what a crawled site needs against what a code base holds, conflicts, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import paths

#: Components that layouts and content types need.
LAYOUT_COMPONENTS = {
    "ArticleLayout": ("ArticleHeader", "ArticleBody", "ArticleMeta", "ShareBar", "AuthorBio", "ReadingProgress"),
    "GalleryLayout": ("GalleryGrid", "GalleryItem", "LightBox", "ImageCaption", "GalleryFilter"),
    "LandingLayout": ("HeroSection", "FeatureGrid", "CallToAction", "TestimonialBlock", "PricingSection"),
    "DocumentationLayout": ("TableOfContents", "DocNav", "CodeBlock", "Callout", "NextPrevNav", "DocSearch"),
    "PortfolioLayout": ("ProjectCard", "CaseStudyHeader", "ProjectGallery", "ClientCredits", "TechStack"),
    "IndexLayout": ("ArticleCard", "ContentGrid", "Pagination", "FilterBar", "CategoryBadge", "SearchBar"),
    "MinimalLayout": ("ContentBlock", "InlineMedia"),
}
CONTENT_COMPONENTS = {
    "ARTICLE": ("ArticleCard", "ArticleHeader", "Breadcrumb"),
    "BLOG": ("ArticleCard", "TagList", "CategoryBadge"),
    "GUIDE": ("TableOfContents", "StepList", "Callout"),
    "LANDING_PAGE": ("HeroSection", "CallToAction", "FeatureGrid"),
    "PORTFOLIO": ("ProjectCard", "ProjectGallery", "TechStack"),
    "GALLERY": ("GalleryGrid", "LightBox", "ImageCaption"),
    "FAQ": ("Accordion", "FAQSearch", "CategoryBadge"),
    "DOCS": ("CodeBlock", "DocNav", "Callout"),
}
#: Providers that serve a kind of data.
PROVIDERS = {
    "database": ("prisma", "drizzle", "supabase", "mongoose"),
    "cms": ("contentful", "sanity", "strapi", "payload", "wordpress", "ghost", "prismic"),
    "cache": ("redis", "upstash"),
    "file-system": ("s3", "cloudinary", "uploadthing"),
}
#: Confidence in the need for each kind.
NEED = {"database": 0.9, "cms": 0.75, "cache": 0.6, "file-system": 0.85}


def _table(rows: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*(x for k, v in rows.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))


def needed_components(layouts: DataFrame) -> DataFrame:
    """(name, pages, required) for pages of (layout, content): components that their layouts
    (required) and content types call for. At most as many rows as the tables above name."""
    of = lambda t, c: F.coalesce(F.try_element_at(_table(t), F.col(c)), F.array().cast("array<string>"))
    by_layout = of(LAYOUT_COMPONENTS, "layout")
    each = F.array_distinct(F.concat(by_layout, of(CONTENT_COMPONENTS, "content")))
    marked = F.transform(each, lambda n: F.struct(n.alias("name"), F.array_contains(by_layout, n).alias("required")))
    per = layouts.groupBy("layout", "content").agg(F.count(F.lit(1)).alias("k")).select("k", F.explode(marked).alias("n"))
    return per.groupBy(F.col("n.name").alias("name")).agg(F.sum("k").alias("pages"), F.bool_or("n.required").alias("required"))


def name_score(a: Column, b: Column) -> Column:
    """10 for equal names, 5 where one holds the other, else shared words of four letters at least; case does not count."""
    a, b = F.lower(a), F.lower(b)
    word = lambda c: F.filter(F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 3)
    shared = F.size(F.filter(word(a), lambda w: F.array_contains(word(b), w)))
    return F.when(a == b, 10).when(F.contains(a, b) | F.contains(b, a), 5).otherwise(shared)


def component_matches(found: DataFrame, needed: DataFrame) -> DataFrame:
    """(name, pages, action, confidence, component) for every need: the component of ``found``
    (ord, name) with the best score, the first of equals; none: CREATE.

    ``needed`` is no longer than the tables of this module, so each component is scored
    against it where it lies; only the best of each partition and need is exchanged.
    """
    pairs = found.select("ord", F.col("name").alias("component")).join(F.broadcast(needed.select("name")), F.lit(True))
    pairs = pairs.withColumn("score", name_score(F.col("component"), F.col("name"))).filter("score > 0")
    best = pairs.groupBy("name").agg(F.max_by(F.struct("component", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    out = needed.join(best, "name", "left")
    create = F.when(F.col("required"), 0.9).otherwise(0.75)
    return out.select(
        "name", "pages", F.when(F.col("b").isNull(), "CREATE").otherwise("UPDATE").alias("action"),
        F.when(F.col("b").isNull(), create).when(F.col("b.score") >= 10, 0.95).otherwise(0.7).alias("confidence"), F.col("b.component").alias("component"),
    )


def source_matches(found: DataFrame, needs: list[str]) -> DataFrame:
    """(kind, action, confidence, provider, candidates) for each kind of data needed: the source of
    ``found`` (ord, kind, provider, confidence) of that kind or from a provider that serves it,
    with the highest confidence, the first of equals; several: four fifths of it; none: CREATE."""
    served = F.array(*(F.when((F.col("kind") == k) | F.col("provider").isin(*PROVIDERS[k]), k) for k in needs))
    each = found.select("ord", "provider", "confidence", F.explode(F.array_compact(served)).alias("need"))
    best = each.groupBy("need").agg(
        F.count(F.lit(1)).alias("candidates"), F.max_by(F.struct("provider", "confidence"), F.struct("confidence", -F.col("ord"))).alias("b")
    )
    wanted = found.sparkSession.createDataFrame([(k, NEED[k]) for k in needs], "need string, weight double")
    out = wanted.join(best, "need", "left")
    confidence = F.when(F.col("b").isNull(), F.col("weight")).otherwise(F.col("b.confidence") * F.when(F.col("candidates") > 1, 0.8).otherwise(1.0))
    return out.select(
        F.col("need").alias("kind"), F.when(F.col("b").isNull(), "CREATE").otherwise("UPDATE").alias("action"), F.round(confidence, 3).alias("confidence"),
        F.col("b.provider").alias("provider"), F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )


def method_collisions(apis: DataFrame) -> DataFrame:
    """(path, methods) for (path, file, methods) of API handlers: paths with one method in more
    than one place, in several files. Paths are compared without a slash at the end and with
    every parameter alike."""
    path = F.regexp_replace(F.regexp_replace(paths.bracketed(F.col("path")), r"\[[^\]/]*\]", "[*]"), "/+$", "")
    each = apis.select(path.alias("path"), "file", F.explode("methods").alias("method"))
    per = each.groupBy("path", "method").agg(F.count(F.lit(1)).alias("places"))
    files = apis.select(path.alias("path"), "file").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")
    twice = per.filter("places > 1").groupBy("path").agg(F.sort_array(F.collect_list("method")).alias("methods"))  # HTTP has a few methods
    return twice.join(files, "path").select("path", "methods")


def _form(pieces: Column, open_: Column) -> Column:
    """Segments as one text in which those that are ``open_`` are empty."""
    return F.array_join(F.zip_with(pieces, open_, lambda s, o: F.when(o, "/").otherwise(F.concat(F.lit("/"), s))), "")


def _opens(segment: Column) -> Column:
    """Whether a segment takes any other, as it begins with a bracket, closed or not."""
    return segment.startswith("[")


def _known(patterns: DataFrame) -> DataFrame:
    """(way, key, b): each pattern as it is, and by its form or what stands before its catch-all;
    of those with one key the first."""
    p, pieces = F.col("pattern"), paths.pieces(F.col("pattern"))
    other = F.when(p.rlike(paths.CATCH_ALL), _way("start", paths.before_catch_all(p))).otherwise(_way("form", _form(pieces, F.transform(pieces, _opens))))
    each = patterns.filter("pattern is not null").select(F.struct("ord", "pattern", "action").alias("b"), F.explode(F.array(_way("equal", p), other)).alias("k"))
    return each.groupBy("k.way", "k.key").agg(F.min_by("b", "b.ord").alias("b"))


def _way(name: str, key: Column) -> Column:
    return F.struct(F.lit(name).alias("way"), key.alias("key"))


def pattern_matches(routes: DataFrame, patterns: DataFrame) -> DataFrame:
    """``routes`` (id, route) with the first of ``patterns`` (ord, pattern, action) that fits: an
    equal one before any other; null ord where none does."""
    return routes.join(first_matches(routes, patterns), "route", "left").select("id", "route", "b.ord", "b.pattern", "b.action")


#: Tasks that the routes of one open form or one start are dealt to.
DEALT = 16


def first_matches(routes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(route, b): the first of ``patterns`` for each distinct route that has one.

    Patterns that take the same routes count as one, the first. A route meets them by
    equi-join: as it is, with the segments emptied that are open in some pattern of its
    length, and by its starts that are as long as what stands before some catch-all. So a
    route makes a row for each way in which segments are open, never for each pattern. As
    all routes of a length may have one open form, routes of a form are dealt to tasks.
    """
    p, r = F.col("pattern"), F.col("route")
    closed, caught = patterns.filter(~p.rlike(paths.CATCH_ALL)), patterns.filter(p.rlike(paths.CATCH_ALL))
    opens = closed.select(F.transform(paths.pieces(p), _opens).alias("open")).distinct().groupBy(F.size("open").alias("_n")).agg(F.collect_set("open").alias("_opens"))
    sizes = caught.agg(F.collect_set(F.length(paths.before_catch_all(p))).alias("_sizes"))  # one row
    each = routes.filter("route is not null").select("route", F.size(paths.pieces(r)).alias("_n")).distinct()
    each = each.join(F.broadcast(opens), "_n", "left").join(F.broadcast(sizes), F.lit(True))
    forms = F.transform(F.coalesce("_opens", F.array().cast("array<array<boolean>>")), lambda o: _way("form", _form(paths.pieces(r), o)))
    starts = F.transform(F.filter("_sizes", lambda n: n <= F.length(r)), lambda n: _way("start", F.substring(r, F.lit(1), n)))
    met = each.select("route", F.explode(F.concat(F.array(_way("equal", r)), forms, starts)).alias("_k")).select("route", "_k.way", "_k.key")
    # emptied segments leave two slashes, or one at the end
    shared = (F.col("way") == "start") | (F.col("way") == "form") & F.col("key").rlike("//|/$")
    met = met.withColumn("_part", F.when(shared, F.pmod(F.xxhash64("route"), F.lit(DEALT)).cast("int")).otherwise(0))
    known = _known(patterns).withColumn("_part", F.explode(F.when(shared, F.sequence(F.lit(0), F.lit(DEALT - 1))).otherwise(F.array(F.lit(0)))))
    met = met.join(known, ["way", "key", "_part"])
    return met.groupBy("route").agg(F.min_by("b", F.struct(F.col("way") != "equal", "b.ord")).alias("b"))


def plan_stats(decisions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row over decisions (action, confidence) and conflicts (severity, blocker): counts by
    action, mean confidence less a tenth an error and a fiftieth a warning (at most 0.4), and
    whether the plan may be carried out."""
    actions = ("CREATE", "UPDATE", "EXTEND", "ARCHIVE", "IGNORE")
    d = decisions.agg(F.count(F.lit(1)).alias("decisions"), F.avg("confidence").alias("mean"), *(F.count_if(F.col("action") == a).alias(a.lower()) for a in actions))
    c = conflicts.agg(
        F.count(F.lit(1)).alias("conflicts"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if("blocker").alias("blockers"),
    )
    loss = F.least(F.lit(0.4), F.col("errors") * 0.1 + F.col("warnings") * 0.02)
    both = d.join(c, F.lit(True))  # one row each
    confidence = F.round(F.greatest(F.lit(0.0), F.coalesce("mean", F.lit(1.0)) - loss), 3)
    return both.select(*(c for c in both.columns if c != "mean"), confidence.alias("confidence"), (F.col("blockers") == 0).alias("ready"))


def first_conflicts(conflicts: DataFrame) -> DataFrame:
    """The first (by ord) conflict of each kind, source and target; nulls are a key of their own."""
    rest = [c for c in conflicts.columns if c not in ("kind", "source", "target")]
    first = conflicts.groupBy("kind", "source", "target").agg(F.min_by(F.struct(*rest), "ord").alias("r"))
    return first.select("kind", "source", "target", *(F.col(f"r.{c}").alias(c) for c in rest))


def conflict_patterns(details: DataFrame, most: int = 50) -> DataFrame:
    """A report of the ``most`` frequent (dimension, path, kind) of conflicts: occurrences, last
    seen, jobs. Details are (job, at, dimension, path, kind)."""
    key = ["dimension", "path", "kind"]
    per_job = details.groupBy(*key, "job").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"))
    g = per_job.groupBy(*key).agg(F.sum("n").alias("occurrences"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("jobs"))
    return g.orderBy(F.desc("occurrences"), *key).limit(most)


def dimension_stats(details: DataFrame) -> DataFrame:
    """(dimension, conflicts, paths): how many conflicts, and the five most frequent paths."""
    per = details.groupBy("dimension", "path").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "path"))
    top = per.withColumn("place", place)
    kept = F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "path")))
    g = top.groupBy("dimension").agg(F.sum("n").alias("conflicts"), F.sort_array(kept).alias("p"))
    return g.select("dimension", "conflicts", F.transform("p", lambda x: x["path"]).alias("paths"))


def risk_level(success: Column, rollback: Column, conflicts: Column) -> Column:
    return (
        F.when((success >= 0.85) & (rollback <= 0.05) & (conflicts <= 2), "low").when((success >= 0.70) & (rollback <= 0.15) & (conflicts <= 5), "medium")
        .when((success >= 0.50) & (rollback <= 0.30), "high").otherwise("critical")
    )
