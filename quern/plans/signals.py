"""Queries that classify sites by rules. A host of pages is a site; what the tables lack (fonts,
cards, heroes) follows from its figures by the same text in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import markup, text, urls
from quern.operators import signals
from quern.operators.merge import CONTENT_COMPONENTS
from quern.plans.merge import layout_assignments
from quern.plans.scoring import WORDS_SQL
from quern.plans.web import RICH_SQL, rich_pages, sql_host, sql_route
from quern.registry import ORACLE, query

_CONTENTS = tuple(CONTENT_COMPONENTS)
_LAYOUTS = ("GalleryLayout", "ArticleLayout", "DocumentationLayout", "PortfolioLayout", "LandingLayout")
_yes = "CASE WHEN {} THEN 'true' ELSE 'false' END".format
#: A fixture: facts of a site from its figures, as expressions that both engines read.
_DESIGN_FACTS = {
    "layout.strategy": "CASE WHEN words > 500 THEN 'documentation' WHEN words > 350 THEN 'editorial_flow' WHEN words > 250 THEN 'magazine' WHEN words > 150 THEN 'portfolio_showcase' ELSE 'card_grid' END",
    "body.font": "CASE total % 5 WHEN 0 THEN 'mono' WHEN 1 THEN 'elegant-serif' ELSE 'sans' END", "heading.font": "CASE total % 4 WHEN 0 THEN 'editorial-serif' WHEN 1 THEN 'geometric-sans' ELSE 'humanist-sans' END",
    "mono.family": "CASE WHEN total % 3 = 0 THEN 'Menlo' WHEN total % 3 = 1 THEN '' END", "spacing.density": "CASE WHEN words > 400 THEN 'compact' WHEN words > 200 THEN 'default' ELSE 'spacious' END",
    "layout.divider": "CASE WHEN total % 2 = 0 THEN 'line' ELSE 'none' END", "navigation.position": "CASE WHEN pages > 4 THEN 'static' ELSE 'sticky' END", "navigation.background": "CASE WHEN pages > 6 THEN 'solid' ELSE 'clear' END",
    "navigation.search": _yes("pages > 5"), "navigation.cta": _yes("total % 6 = 0"), "navigation.transparent": _yes("images_total > 20"), "cards.date": _yes("gallery > 0"), "cards.read_time": _yes("words > 300"),
    "cards.author": _yes("blog > 0"), "cards.category": _yes("categories > 2"), "cards.layout": "CASE total % 3 WHEN 0 THEN 'vertical' WHEN 1 THEN 'overlay' ELSE 'horizontal' END", "cards.ratio": "CASE total % 4 WHEN 0 THEN '16:9' WHEN 1 THEN 'mixed' WHEN 2 THEN '1:1' END",
    "cards.hover": "CASE WHEN images > 5 THEN 'lift' ELSE 'none' END", "cards.image": "CASE WHEN images > 4 THEN 'top' ELSE 'left' END", "cards.shadow": "CASE WHEN total % 2 = 0 THEN 'subtle' ELSE 'strong' END", "cards.overlay": _yes("images > 6"),
    "hero.layout": "CASE WHEN images > 6 THEN 'full-bleed-image' WHEN words > 300 THEN 'text-left' ELSE 'split-content-image' END", "hero.background": _yes("images > 6"), "hero.cta": "CASE WHEN landing > 0 THEN 'filled' ELSE 'none' END",
    "gallery.layout": "CASE WHEN gallery > 1 THEN 'masonry' WHEN gallery > 0 THEN 'grid' END", "gallery.lightbox": _yes("gallery > 2"), "gallery.animation": "CASE WHEN gallery > 1 THEN 'fade' ELSE 'none' END", "type.scale": "CASE WHEN words > 300 THEN 'editorial' ELSE 'default' END",
}
_DESIGN_NUMBERS = {"layout.sidebar": "CASE WHEN total % 3 = 0 THEN 240 ELSE 0 END", "layout.columns": "CASE WHEN pages > 3 THEN 12 ELSE 8 END"}
_SITE_NUMBERS = {
    "images.per_page": "images_total / pages", "images": "images_total / pages", "images.total": "images_total", "words": "words", "content": "content", "categories": "categories",
    **{f"layout.{n}": f"{n} / pages" for n in _LAYOUTS}, **{f"count.{c.upper()}": c for c in ("article", "landing_page")},
    **{f"share.{'+'.join(c).upper()}": f"({' + '.join(c)}) / greatest(content, 1)" for c in (("gallery",), ("article", "blog"), ("article", "guide"), ("blog",), ("portfolio",), ("landing_page",), ("docs",))},
}
_FIGURES = f"""{RICH_SQL}, l AS (SELECT page_id, layout FROM ({ORACLE['layout_assignments']})), g AS (SELECT {sql_host('url')} AS site, {WORDS_SQL} AS n, len(regexp_extract_all(html, '<img[\\s>]')) AS i, {list(_CONTENTS)}[page_id % 9 + 1] AS kind, layout, split_part({sql_route('url')}, '/', 2) AS category
  FROM pages_rich JOIN l USING (page_id) WHERE url IS NOT NULL),
x AS (SELECT site, count(*) AS pages, floor(avg(n)) AS words, CAST(sum(n) AS BIGINT) AS total, CAST(sum(i) AS BIGINT) AS images_total, avg(i) AS images, count(kind) AS content, count(DISTINCT category) AS categories, count(*) FILTER (WHERE kind = 'LANDING_PAGE') AS landing,
  {", ".join(f"count(*) FILTER (WHERE kind = '{c}') AS {c.lower()}" for c in _CONTENTS)}, {", ".join(f"count(*) FILTER (WHERE layout = '{n}') AS {n}" for n in _LAYOUTS)} FROM g GROUP BY site)"""


def _rules_sql(facts: dict[str, str], numbers: dict[str, str], rules: tuple[signals.Rule, ...]) -> str:
    """f: facts; c: conditions; m: rules that hold, by site; y: sums by site and label."""
    labels = list(dict.fromkeys(r[0] for r in rules))
    f = [f"SELECT site, '{k}' AS field, {e} AS text, NULL::DOUBLE AS number FROM x" for k, e in facts.items()] + [f"SELECT site, '{k}', NULL, CAST({e} AS DOUBLE) FROM x" for k, e in numbers.items()]
    c = [
        f"({i}, {labels.index(label)}, '{label}', {weight}::DOUBLE, '{name}', {len(needs)}, '{field}', '{op}', {[str(v) for v in values]})"
        for i, (label, name, weight, needs) in enumerate(rules)
        for field, op, values in needs
    ]
    return f""", f AS ({" UNION ALL ".join(f)}), c(rule, place, label, weight, name, parts, field, op, words) AS (VALUES {", ".join(c)}),
m AS (SELECT site, rule, place, label, weight, name FROM f JOIN c USING (field) WHERE CASE op WHEN 'in' THEN list_contains(words, text) WHEN 'out' THEN NOT list_contains(words, text) WHEN 'has' THEN len(list_filter(words, lambda w: contains(text, w))) > 0
  WHEN '>' THEN number > words[1]::DOUBLE WHEN '>=' THEN number >= words[1]::DOUBLE WHEN '<' THEN number < words[1]::DOUBLE ELSE number <= words[1]::DOUBLE END GROUP BY site, rule, place, label, weight, name, parts HAVING count(*) = parts),
t AS (SELECT place, label, sum(weight) AS total FROM (SELECT DISTINCT rule, place, label, weight FROM c) GROUP BY ALL), y AS (SELECT x.site, t.label, t.place, coalesce(sum(weight), 0) AS score, any_value(t.total) AS total, coalesce(string_agg(name, '|' ORDER BY rule), '') AS signals FROM x CROSS JOIN t LEFT JOIN m ON m.site = x.site AND m.place = t.place GROUP BY ALL)"""


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    html, k = F.col("html"), F.col("page_id")
    p = rich_pages(spark, sf_dir).filter("url is not null")
    g = p.select(
        k, urls.host(F.col("url")).alias("site"), F.size(text.words(F.regexp_replace(html, "<[^>]+>", " "))).alias("n"), F.size(markup.tags(html, "img")).alias("i"),
        F.get(F.array(*map(F.lit, _CONTENTS)), (k % 9).cast("int")).alias("kind"), F.split_part(urls.route(F.col("url")), F.lit("/"), F.lit(2)).alias("category"),
    ).join(layout_assignments(spark, sf_dir).select("page_id", "layout"), "page_id")
    is_ = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False)))
    return g.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.floor(F.avg("n")).alias("words"), F.sum("n").alias("total"), F.sum("i").alias("images_total"), F.avg("i").alias("images"), F.count("kind").alias("content"),
        F.count_distinct("category").alias("categories"), is_("kind", "LANDING_PAGE").alias("landing"), *(is_("kind", c).alias(c.lower()) for c in _CONTENTS), *(is_("layout", n).alias(n) for n in _LAYOUTS),
    )


def _facts(figures: DataFrame, facts: dict[str, str], numbers: dict[str, str]) -> DataFrame:
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    fact = lambda field, word, n: F.struct(F.lit(field).alias("field"), word.alias("text"), n.alias("number"))
    every = [fact(k, F.expr(e), number) for k, e in facts.items()] + [fact(k, none, F.expr(e).cast("double")) for k, e in numbers.items()]
    return figures.select("site", F.explode(F.array(*every)).alias("f")).select("site", "f.*")


@query(_FIGURES + _rules_sql(_DESIGN_FACTS, _DESIGN_NUMBERS, signals.DESIGN) + """, z AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, place) AS i FROM y)
SELECT site, max(label) FILTER (WHERE i = 1) AS archetype, max(score) FILTER (WHERE i = 1) AS score, CASE WHEN max(score) >= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN max(score) >= 1 THEN 'high' ELSE 'low' END AS level,
  max(signals) FILTER (WHERE i = 1) AS signals, string_agg(label, '|' ORDER BY i) FILTER (WHERE i > 1) AS others, floor(max(score) FILTER (WHERE i = 2) / greatest(max(score), 1) * 100 + 0.5) / 100 AS runner_up FROM z GROUP BY site""")
def design_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The design archetype of each site, why, and the others in order."""
    found = signals.design_profiles(_facts(_figures(spark, sf_dir), _DESIGN_FACTS, _DESIGN_NUMBERS))
    return found.withColumns({"signals": F.array_join("signals", "|"), "runner_up": F.get("others", 0)["confidence"], "others": F.array_join(F.transform("others", lambda x: x["label"]), "|")})


@query(_FIGURES + _rules_sql({"url": "site"}, _SITE_NUMBERS, signals.SITES) + f""", w AS (SELECT *, score / total AS part FROM y), z AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY part DESC, place) AS i FROM w),
s(label, design, layout) AS (VALUES {", ".join(f"('{k}', '{d}', '{n}')" for k, (d, n) in signals.STRATEGY.items())})
SELECT site, CASE WHEN part > 0.1 THEN label ELSE 'unknown' END AS kind, round(part, 6) AS score, round(least(least(part * (z.score / greatest(total, 1)) * 1.5, 1) + 0.15, 1), 6) AS confidence, design, layout, signals,
  coalesce((SELECT string_agg(o.label, '|' ORDER BY o.i) FROM z o WHERE o.site = z.site AND o.i BETWEEN 2 AND 4 AND o.part > 0.1), '') AS others FROM z JOIN s USING (label) WHERE i = 1""")
def site_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of site each host is, the design that calls for, and the next kinds."""
    found = signals.site_kinds(_facts(_figures(spark, sf_dir), {"url": "site"}, _SITE_NUMBERS))
    told = {"signals": F.array_join("signals", "|"), "others": F.array_join(F.transform("others", lambda x: x["label"]), "|")}
    return found.withColumns({**told, "score": F.round("score", 6), "confidence": F.round("confidence", 6)})


_TAGS = signals.ROOT_TAGS + signals.ALL_TAGS


@query(rf"""{RICH_SQL}, p AS (SELECT {sql_host('url')} AS site, html, CASE page_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 4 THEN 0 ELSE 1 END AS weight FROM pages_rich WHERE url IS NOT NULL AND page_id % 5 < 4),
h AS (SELECT site, max(weight) >= 3 AS main FROM p GROUP BY site), c AS (SELECT site, weight, unnest(regexp_extract_all(html, '\bclass="([^"]+)"', 1)) AS words FROM p),
t AS (SELECT site, weight, unnest({list(_TAGS)}) AS token, html FROM p),
e AS (SELECT site, weight, 'class' AS kind, unnest(list_filter(regexp_split_to_array(words, '\s+'), lambda w: w <> '')) AS token, 1 AS n FROM c UNION ALL SELECT site, weight, 'style', unnest(regexp_extract_all(html, '\bstyle="([^"]+)"', 1)), 1 FROM p
  UNION ALL SELECT site, weight, 'tag', token, len(regexp_extract_all(html, '<' || token || '[\s>/]', 0, 'i')) FROM t JOIN h USING (site) WHERE weight >= 3 OR NOT main OR token NOT IN {signals.ROOT_TAGS})
SELECT site, kind, token, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * weight) AS BIGINT) AS weight FROM e WHERE n > 0 GROUP BY ALL""")
def site_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, styles and tags of each site, weighted by the kind of page."""
    weight = F.expr("CASE page_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 4 THEN 0 ELSE 1 END")
    p = rich_pages(spark, sf_dir).filter("url is not null").select(urls.host(F.col("url")).alias("site"), "html", weight.alias("weight"))
    return signals.page_signals(p)
