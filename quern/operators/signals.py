"""Sites classified by rules that are rows: conditions on facts, weights, and who comes after the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text

#: A rule: (label, name, weight, conditions); a condition: (field, op, values). All conditions of
#: a rule must hold. ``in``, ``out``: the fact's text is, is not one of the values; ``has``: it
#: holds one; ``>``, ``>=``, ``<``, ``<=``: its number against the value.
Rule = tuple[str, str, float, tuple[tuple[str, str, tuple], ...]]

#: Signs of a design, and their weights.
DESIGN: tuple[Rule, ...] = (
    ("documentation", "documentation layout strategy", 40, (("layout.strategy", "in", ("documentation",)),)),
    ("documentation", "monospace body font", 15, (("body.font", "in", ("mono",)),)),
    ("documentation", "explicit mono font family", 8, (("mono.family", "out", ("monospace", "")),)),
    ("documentation", "compact spacing density", 10, (("spacing.density", "in", ("compact",)),)),
    ("documentation", "line section dividers", 8, (("layout.divider", "in", ("line",)),)),
    ("documentation", "static navigation", 8, (("navigation.position", "in", ("static",)),)),
    ("documentation", "cards omit date and read-time", 6, (("cards.date", "in", ("false",)), ("cards.read_time", "in", ("false",)))),
    ("documentation", "text-only hero (no background media)", 5, (("hero.layout", "in", ("text-left", "text-centered")),)),
    ("documentation", "no hero background media", 8, (("hero.background", "in", ("false",)),)),
    ("documentation", "sidebar layout present", 10, (("layout.sidebar", ">", (0,)),)),
    ("documentation", "solid navigation background", 5, (("navigation.background", "in", ("solid",)),)),
    ("blog", "editorial flow layout", 25, (("layout.strategy", "in", ("editorial_flow",)),)),
    ("blog", "cards show publication date", 18, (("cards.date", "in", ("true",)),)),
    ("blog", "cards show read time", 18, (("cards.read_time", "in", ("true",)),)),
    ("blog", "cards show author", 14, (("cards.author", "in", ("true",)),)),
    ("blog", "serif body font (editorial signal)", 12, (("body.font", "has", ("serif",)),)),
    ("blog", "serif heading font", 8, (("heading.font", "has", ("serif",)),)),
    ("blog", "vertical card layout", 8, (("cards.layout", "in", ("vertical",)),)),
    ("blog", "widescreen card image ratio", 6, (("cards.ratio", "in", ("16:9", "4:3")),)),
    ("blog", "no hover effect on cards (editorial calm)", 5, (("cards.hover", "in", ("none",)),)),
    ("magazine", "magazine layout strategy", 40, (("layout.strategy", "in", ("magazine",)),)),
    ("magazine", "cards show category labels", 14, (("cards.category", "in", ("true",)),)),
    ("magazine", "navigation has search", 12, (("navigation.search", "in", ("true",)),)),
    ("magazine", "cards show both date and category", 10, (("cards.date", "in", ("true",)), ("cards.category", "in", ("true",)))),
    ("magazine", "dense/default spacing (content-heavy)", 8, (("spacing.density", "in", ("compact", "default")),)),
    ("magazine", "mixed card aspect ratios (magazine variety)", 10, (("cards.ratio", "in", ("mixed",)),)),
    ("magazine", "12-column grid system", 6, (("layout.columns", ">=", (12,)), ("layout.columns", "<=", (12,)))),
    ("magazine", "interactive card hover effects", 5, (("cards.hover", "out", ("none",)),)),
    ("luxury", "elegant/editorial serif heading font", 28, (("heading.font", "in", ("elegant-serif", "editorial-serif")),)),
    ("luxury", "editorial type scale", 12, (("type.scale", "in", ("editorial",)),)),
    ("luxury", "spacious/comfortable spacing density", 18, (("spacing.density", "in", ("spacious", "comfortable")),)),
    ("luxury", "full-bleed hero image", 14, (("hero.layout", "in", ("full-bleed-image",)),)),
    ("luxury", "transparent navigation on hero", 10, (("navigation.transparent", "in", ("true",)),)),
    ("luxury", "masonry/mosaic gallery layout", 10, (("gallery.layout", "in", ("masonry", "mosaic")),)),
    ("luxury", "cards show no metadata (clean luxury style)", 10, (("cards.date", "in", ("false",)), ("cards.read_time", "in", ("false",)), ("cards.author", "in", ("false",)))),
    ("luxury", "minimal/no card shadow", 6, (("cards.shadow", "in", ("none", "subtle")),)),
    ("luxury", "no card overlay (clean presentation)", 5, (("cards.overlay", "in", ("false",)),)),
    ("agency", "portfolio/showcase layout strategy", 20, (("layout.strategy", "in", ("portfolio_showcase",)),)),
    ("agency", "navigation has CTA button", 22, (("navigation.cta", "in", ("true",)),)),
    ("agency", "geometric/condensed sans heading font", 16, (("heading.font", "in", ("geometric-sans", "condensed-sans")),)),
    ("agency", "bold full-bleed or split hero", 14, (("hero.layout", "in", ("full-bleed-image", "split-content-image")),)),
    ("agency", "filled CTA button style", 10, (("hero.cta", "in", ("filled",)),)),
    ("agency", "open spacing (premium agency feel)", 8, (("spacing.density", "in", ("comfortable", "spacious")),)),
    ("agency", "prominent card shadows", 7, (("cards.shadow", "in", ("medium", "strong")),)),
    ("agency", "horizontal card layout (case study style)", 8, (("cards.layout", "in", ("horizontal",)),)),
    ("portfolio", "portfolio showcase layout strategy", 22, (("layout.strategy", "in", ("portfolio_showcase",)),)),
    ("portfolio", "masonry/mosaic/grid gallery layout", 24, (("gallery.layout", "in", ("masonry", "mosaic", "grid")),)),
    ("portfolio", "gallery has lightbox", 20, (("gallery.lightbox", "in", ("true",)),)),
    ("portfolio", "full-bleed hero image", 14, (("hero.layout", "in", ("full-bleed-image",)),)),
    ("portfolio", "overlay card layout (work thumbnails)", 14, (("cards.layout", "in", ("overlay",)),)),
    ("portfolio", "transparent navigation on hero", 10, (("navigation.transparent", "in", ("true",)),)),
    ("portfolio", "cards omit editorial metadata", 6, (("cards.date", "in", ("false",)), ("cards.read_time", "in", ("false",)))),
    ("portfolio", "animated gallery transitions", 5, (("gallery.animation", "out", ("none",)),)),
    ("ecommerce", "card grid layout strategy (product grid)", 30, (("layout.strategy", "in", ("card_grid",)),)),
    ("ecommerce", "lift/scale hover effect on cards", 22, (("cards.hover", "in", ("lift", "scale")),)),
    ("ecommerce", "navigation has search (product search)", 16, (("navigation.search", "in", ("true",)),)),
    ("ecommerce", "cards show category (product category)", 14, (("cards.category", "in", ("true",)),)),
    ("ecommerce", "top image position on cards (product card pattern)", 10, (("cards.image", "in", ("top",)),)),
    ("ecommerce", "prominent card shadows (product card depth)", 8, (("cards.shadow", "in", ("medium", "strong")),)),
    ("ecommerce", "square/standard product image ratio", 8, (("cards.ratio", "in", ("1:1", "4:3")),)),
    ("ecommerce", "grid/filmstrip gallery (product images)", 7, (("gallery.layout", "in", ("grid", "filmstrip")),)),
)
#: Signs of a kind of site, and their weights.
SITES: tuple[Rule, ...] = (
    ("photography", "very_high_image_density", 3.0, (("images.per_page", ">", (5,)),)),
    ("photography", "gallery_content_dominant", 2.5, (("share.GALLERY", ">", (0.4,)),)),
    ("photography", "low_word_count", 1.5, (("words", "<", (150,)),)),
    ("photography", "gallery_layout_dominant", 2.0, (("layout.GalleryLayout", ">", (0.3,)),)),
    ("news", "high_article_count", 2.5, (("content", ">", (30,)),)),
    ("news", "article_dominant", 2.0, (("share.ARTICLE+BLOG", ">", (0.6,)),)),
    ("news", "short_word_count", 1.5, (("words", ">", (200,)), ("words", "<", (800,)))),
    ("news", "many_categories", 1.5, (("categories", ">", (5,)),)),
    ("news", "news_url_keywords", 1.0, (("url", "has", ("news", "times", "post", "daily", "herald", "gazette", "tribune", "journal", "press")),)),
    ("editorial", "high_word_count", 2.5, (("words", ">", (800,)),)),
    ("editorial", "article_or_guide_dominant", 2.0, (("share.ARTICLE+GUIDE", ">", (0.5,)),)),
    ("editorial", "moderate_image_ratio", 1.0, (("images", ">=", (1,)), ("images", "<=", (4,)))),
    ("editorial", "article_layout_dominant", 1.5, (("layout.ArticleLayout", ">", (0.4,)),)),
    ("blog", "blog_content_type", 3.0, (("share.BLOG", ">", (0.3,)),)),
    ("blog", "moderate_article_count", 1.5, (("content", ">=", (5,)), ("content", "<=", (50,)))),
    ("blog", "medium_word_count", 1.5, (("words", ">=", (400,)), ("words", "<=", (1200,)))),
    ("blog", "blog_url_keywords", 1.0, (("url", "has", ("blog", "medium", "substack", "write", "thoughts", "notes", "diary")),)),
    ("portfolio", "portfolio_content_type", 3.0, (("share.PORTFOLIO", ">", (0.3,)),)),
    ("portfolio", "portfolio_layout", 2.5, (("layout.PortfolioLayout", ">", (0,)),)),
    ("portfolio", "high_image_density", 1.5, (("images", ">", (3,)),)),
    ("portfolio", "small_page_count", 1.0, (("content", "<=", (20,)),)),
    ("corporate", "landing_page_dominant", 2.5, (("share.LANDING_PAGE", ">", (0.3,)),)),
    ("corporate", "landing_layout_present", 2.0, (("layout.LandingLayout", ">", (0,)),)),
    ("corporate", "corporate_url_keywords", 1.5, (("url", "has", ("corp", "company", "inc", "llc", "ltd", "business", "enterprise", "solutions", "services")),)),
    ("corporate", "docs_content_type", 1.0, (("share.DOCS", ">", (0,)),)),
    ("documentation", "docs_dominant", 3.5, (("share.DOCS", ">", (0.4,)),)),
    ("documentation", "docs_layout", 2.5, (("layout.DocumentationLayout", ">", (0.3,)),)),
    ("documentation", "docs_url_keywords", 2.0, (("url", "has", ("docs", "documentation", "wiki", "guide", "reference", "api", "developer", "dev.")),)),
    ("travel", "travel_url_keywords", 2.0, (("url", "has", ("travel", "trip", "journey", "adventure", "explore", "destination", "hotel", "tour")),)),
    ("travel", "high_image_density", 2.0, (("images", ">", (4,)),)),
    ("travel", "many_articles_with_images", 1.5, (("count.ARTICLE", ">", (10,)), ("images.total", ">", (30,)))),
    ("luxury", "luxury_url_keywords", 2.5, (("url", "has", ("luxury", "premium", "exclusive", "bespoke", "haute", "prestige", "elite", "couture")),)),
    ("luxury", "visual_with_sparse_text", 2.0, (("images", ">", (3,)), ("words", "<", (400,)))),
    ("luxury", "small_curated_content", 1.5, (("content", "<=", (15,)),)),
    ("lifestyle", "lifestyle_url_keywords", 2.0, (("url", "has", ("lifestyle", "living", "home", "fashion", "beauty", "wellness", "health", "food", "recipe")),)),
    ("lifestyle", "mixed_content_and_images", 1.5, (("images", ">=", (2,)), ("words", ">=", (300,)))),
    ("lifestyle", "multiple_categories", 1.0, (("categories", ">=", (3,)),)),
    ("wedding", "wedding_url_keywords", 3.5, (("url", "has", ("wedding", "bride", "bridal", "nuptial", "ceremony", "engagement")),)),
    ("wedding", "gallery_heavy", 2.0, (("share.GALLERY", ">", (0,)), ("images", ">", (3,)))),
    ("marketplace", "marketplace_url_keywords", 2.0, (("url", "has", ("shop", "store", "market", "buy", "sell", "product", "ecommerce", "commerce")),)),
    ("marketplace", "many_categories_and_pages", 2.5, (("categories", ">", (8,)), ("content", ">", (20,)))),
    ("marketplace", "landing_pages_present", 1.5, (("count.LANDING_PAGE", ">", (3,)),)),
)
#: Design and layout that a kind of site calls for.
STRATEGY = {
    "photography": ("minimal", "masonry"), "news": ("readable", "magazine"), "editorial": ("elegant", "editorial_flow"), "blog": ("friendly", "card_grid"), "portfolio": ("modern", "portfolio_showcase"),
    "corporate": ("professional", "sidebar_content"), "documentation": ("readable", "documentation"), "travel": ("immersive", "full_bleed"), "luxury": ("elegant", "full_bleed"),
    "lifestyle": ("friendly", "card_grid"), "wedding": ("elegant", "full_bleed"), "marketplace": ("bold", "card_grid"),
}
#: Rules of up to this many conditions go to every task; more are joined by a shuffle.
BROADCAST_CONDITIONS = 10_000
#: Tags counted over the main pages of a site, and over all.
ROOT_TAGS, ALL_TAGS = ("nav", "header", "footer", "section"), ("aside", "article", "figure", "h1", "h2", "h3", "li", "ul")


def _conditions(facts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [
        (rank, c, len(needs), field, op, [str(v) for v in values] if op in ("in", "out", "has") else [], None if op in ("in", "out", "has") else float(values[0]))
        for rank, (_, _, _, needs) in enumerate(rules)
        for c, (field, op, values) in enumerate(needs)
    ]
    made = facts.sparkSession.createDataFrame(rows, "rule int, part int, parts int, field string, op string, words array<string>, limit double")
    return F.broadcast(made) if len(rows) <= BROADCAST_CONDITIONS else made


def _holds() -> Column:
    op, word, number, limit = F.col("op"), F.col("text"), F.col("number"), F.col("limit")
    return (
        F.when(op == "in", F.array_contains("words", word)).when(op == "out", ~F.array_contains("words", word)).when(op == "has", F.exists("words", lambda w: F.contains(word, w)))
        .when(op == ">", number > limit).when(op == ">=", number >= limit).when(op == "<", number < limit).when(op == "<=", number <= limit)
    )


def matched(facts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(site, rule) for facts (site, field, text, number): the places in ``rules`` of those whose
    conditions all hold. A field that a site has no fact of meets no condition, one of several
    facts meets it if any does; rules without conditions hold nowhere."""
    met = facts.filter("site is not null").join(_conditions(facts, rules), "field").filter(_holds())
    per = met.groupBy("site", "rule").agg(F.count_distinct("part").alias("n"), F.first("parts").alias("parts"))
    return per.filter("n = parts").select("site", "rule")


def scores(facts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(site, label, place, score, total, signals) for each site and label of ``rules``, labels in
    order of first naming: weights of the rules that hold, of all, and names of those that hold."""
    labels = list(dict.fromkeys(r[0] for r in rules))
    told = facts.sparkSession.createDataFrame([(i, labels.index(l), n, float(w)) for i, (l, n, w, _) in enumerate(rules)], "rule int, place int, name string, weight double")
    told = F.broadcast(told) if len(rules) <= BROADCAST_CONDITIONS else told
    per = matched(facts, rules).join(told, "rule").groupBy("site", "place").agg(F.sum("weight").alias("score"), F.sort_array(F.collect_list(F.struct("rule", "name"))).alias("s"))
    totals = [sum(float(r[2]) for r in rules if r[0] == l) for l in labels]
    every = F.array(*(F.struct(F.lit(l).alias("label"), F.lit(i).alias("place"), F.lit(t).alias("total")) for i, (l, t) in enumerate(zip(labels, totals))))
    sites = facts.filter("site is not null").select("site").distinct().select("site", F.explode(every).alias("e")).select("site", "e.*")
    names = F.coalesce(F.transform("s", lambda x: x["name"]), F.array().cast("array<string>"))
    return sites.join(per, ["site", "place"], "left").select("site", "label", "place", F.coalesce("score", F.lit(0.0)).alias("score"), "total", names.alias("signals"))


def _ranked(scored: DataFrame, *fields: Column) -> DataFrame:
    """A row a site with its labels, best first; as many as the rules name."""
    each = F.struct((-F.col("by")).alias("_by"), "place", "label", *fields, "signals")
    return scored.groupBy("site").agg(F.sort_array(F.collect_list(each)).alias("r"))


def design_profiles(facts: DataFrame, rules: tuple[Rule, ...] = DESIGN) -> DataFrame:
    """(site, archetype, score, confidence, level, signals, others): the label with the highest sum
    of weights, the first of equals, and the others in order as (label, score, confidence).
    Confidence is the sum against the highest (against 1 if that is less), to two places."""
    ranked = _ranked(scores(facts, rules).withColumn("by", F.col("score")), F.col("score"))
    best = F.get("r", 0)
    sure = lambda s: F.floor(s / F.greatest(best["score"], F.lit(1.0)) * 100 + 0.5) / 100
    others = F.transform(F.slice("r", 2, 1000000), lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"), sure(x["score"]).alias("confidence")))
    out = ranked.select("site", best["label"].alias("archetype"), best["score"].alias("score"), sure(best["score"]).alias("confidence"), best["signals"].alias("signals"), others.alias("others"))
    level = F.when(F.col("confidence") >= 0.72, "high").when(F.col("confidence") >= 0.45, "medium").otherwise("low")
    return out.select("site", "archetype", "score", "confidence", level.alias("level"), "signals", "others")


def site_kinds(facts: DataFrame, rules: tuple[Rule, ...] = SITES, strategy: dict[str, tuple[str, str]] = STRATEGY) -> DataFrame:
    """(site, kind, score, confidence, design, layout, signals, others): the label with the largest
    part of its weights, the first of equals, ``unknown`` at a tenth or less; ``others`` are those
    of the next three above a tenth, as (label, score, confidence). Confidence is 1.5 times the
    square of the part, 0.15 more for the best, at most 1."""
    part = F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(0.0)
    sure = F.least(part * (F.col("score") / F.greatest("total", F.lit(1.0))) * 1.5, F.lit(1.0))
    ranked = _ranked(scores(facts, rules).withColumn("by", part), part.alias("score"), sure.alias("confidence"))
    best = F.get("r", 0)
    others = F.filter(F.slice("r", 2, 3), lambda x: x["score"] > 0.1)
    told = lambda i: F.try_element_at(F.create_map(*(F.lit(x) for k, v in strategy.items() for x in (k, v[i]))), best["label"])
    return ranked.select(
        "site", F.when(best["score"] > 0.1, best["label"]).otherwise("unknown").alias("kind"), best["score"].alias("score"), F.least(best["confidence"] + 0.15, F.lit(1.0)).alias("confidence"),
        told(0).alias("design"), told(1).alias("layout"), best["signals"].alias("signals"), F.transform(others, lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"), x["confidence"].alias("confidence"))).alias("others"),
    )


def page_signals(pages: DataFrame) -> DataFrame:
    """(site, kind, token, n, weight) for pages (site, html, weight): how often each class, style and
    tag occurs over the pages that count (weight above 0), and the weights of those pages, added up
    once for each time. Tags of ``ROOT_TAGS`` count on pages of weight 3 and more only, or on
    all if a site has none of those. Null or empty pages hold nothing.
    """
    held = pages.filter("weight > 0 and html != '' and site is not null")
    main = held.groupBy("site").agg(F.max(F.col("weight") >= 3).alias("_main"))
    html = F.col("html")
    classes = F.flatten(F.transform(text.extract_all(html, r'\bclass="([^"]+)"'), lambda c: F.filter(F.split(c, r"\s+"), lambda t: t != "")))
    styles = text.extract_all(html, r'\bstyle="([^"]+)"')
    tags = F.flatten(F.array(*(F.array_repeat(F.lit(t), F.regexp_count(html, F.lit(rf"(?i)<{t}[\s>/]"))) for t in (*ROOT_TAGS, *ALL_TAGS))))
    of = lambda kind, tokens: F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))
    each = F.concat(of("class", classes), of("style", styles), of("tag", tags))
    per = held.select("site", "weight", F.explode(each).alias("e")).groupBy("site", "weight", "e").agg(F.count(F.lit(1)).alias("n"))
    counted = per.join(main, "site").filter((F.col("weight") >= 3) | ~F.col("_main") | (F.col("e.kind") != "tag") | ~F.col("e.token").isin(*ROOT_TAGS))
    return counted.groupBy("site", F.col("e.kind").alias("kind"), F.col("e.token").alias("token")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("weight")).alias("weight"))
