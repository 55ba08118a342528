"""Text, HTML, grade and colour expressions, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.binding import bound

#: Lowest score of each grade, best first.
GRADES = {
    "qa": ((95, "A+"), (85, "A"), (75, "B"), (65, "C"), (50, "D")),
    "reconstruction": ((90, "A"), (75, "B"), (60, "C"), (45, "D")),
    "similarity": ((0.90, "A"), (0.75, "B"), (0.60, "C"), (0.45, "D")),
    "certification": (
        (97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"), (67, "D+"), (63, "D"), (60, "D-"),
    ),
}
#: Words that say nothing about a page.
STOPWORDS = (
    "the", "a", "an", "in", "on", "at", "to", "for", "of", "and", "or", "is", "are", "was", "be", "been", "by", "with", "from", "as", "that",
    "this", "it", "its", "page", "post", "article", "www", "http", "https", "index", "home", "default", "main", "content", "section",
)
SPACES = r"[ \t\n\r\f]+"
#: Unicode's blanks (Zs), which trim() of the SQL takes off.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def js_round(c: Column) -> Column:
    """Half goes up, also below zero."""
    return F.floor(c + 0.5)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def content_hash(html: Column) -> Column:
    """SHA-256 of a page whose white space is squeezed, and gone between tags."""
    return F.sha2(F.trim(F.regexp_replace(F.regexp_replace(html, SPACES, " "), "> <", "><")), 256)


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


def words(c: Column) -> Column:
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    """How many :func:`words` a text has, without those of blanks alone at its ends."""
    return F.regexp_count(F.btrim(c, F.lit(BLANKS + "\t\n\r\f")), F.lit(r"[^ \t\n\r\f]+"))


def slugify(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 80)


def route_slug(c: Column) -> Column:
    """As :func:`slugify`, but other characters go instead of parting words."""
    kept = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", ""))
    dashed = F.regexp_replace(F.regexp_replace(kept, r"[\s_]+", "-"), "-{2,}", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 80)


def title_keywords(title: Column) -> Column:
    """The first six words of three letters at least that say something."""
    parts = F.split(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", " "), r"\s+")
    return F.slice(F.filter(parts, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS)), 1, 6)


def keywords(raw: Column) -> Column:
    """At most twenty distinct keywords of a list with commas, semicolons or bars."""
    parts = F.transform(F.split(raw, r"[,;|]+"), lambda w: F.lower(F.trim(w)))
    return F.slice(F.array_distinct(F.filter(parts, lambda w: w != "")), 1, 20)


def word_set(*parts: Column) -> Column:
    """Distinct words of several texts, lowered."""
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *parts)), r"[\W_]+"), lambda w: w != ""))


def page_title(title: Column, slug: Column, stencil: Column, depth: Column) -> Column:
    """A page's own title, at the root its layout's name, else its slug as a title."""
    named = (
        F.when(stencil == "ArticleLayout", "Article").when(stencil == "GridLayout", "Index").when(stencil == "FeatureBlock", "Features")
        .when(stencil == "NavigationLayout", "Site Map").otherwise("Home")
    )
    return F.when(F.length(F.trim(title)) > 1, F.trim(title)).when((slug == "home") | (depth == 0), named).otherwise(humanize(slug))


def page_category(stencil: Column, depth: Column, route: Column) -> Column:
    return (
        F.when((depth == 0) | (route == "/"), "homepage").when(stencil == "HeroSection", "homepage").when(stencil == "ArticleLayout", "article")
        .when(stencil == "GridLayout", "listing").when(stencil == "FeatureBlock", "feature").when(stencil == "NavigationLayout", "navigation").otherwise("unknown")
    )


def navigation_place(depth: Column, category: Column, has_navigation: Column, stencil: Column) -> Column:
    return (
        F.when((stencil == "NavigationLayout") | (depth == 0), "primary").when((depth == 1) & category.isin("listing", "feature"), "primary")
        .when(depth <= 2, "secondary").when(category == "article", "footer").when(~has_navigation, "unlisted").otherwise("breadcrumb")
    )


def page_tags(category: Column, stencil: Column, depth: Column, images: Column, words_: Column, parts: dict[str, Column]) -> Column:
    """Distinct tags of a page; ``parts``: navigation, footer, hero, whether it has them."""
    held = [F.when(has, name) for name, has in parts.items()]
    return F.array_distinct(
        F.array_compact(F.array(category, stencil, *held, F.when(images > 3, "media-rich"), F.when(words_ > 500, "long-form"), F.when(depth == 0, "root")))
    )


def humanize(c: Column) -> Column:
    """A slug as a title: dashes to spaces, humps split, words with capitals."""
    spaced = F.regexp_replace(F.regexp_replace(c, "[-_]+", " "), "([a-z])([A-Z])", "$1 $2")
    return F.initcap(spaced)


def extract_all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def letter_grade(score: Column, scale: str) -> Column:
    column = F.when(score.isNull(), "UNKNOWN")
    for least, grade in GRADES[scale]:
        column = column.when(score >= least, grade)
    return column.otherwise("F")


def rgb(hex_: Column) -> Column:
    """(r, g, b) of ``#rrggbb`` or ``#rgb``."""
    h = F.lower(F.regexp_replace(hex_, "^#", ""))
    full = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return F.struct(*(F.conv(F.substring(full, i, 2), 16, 10).cast("int").alias(n) for i, n in ((1, "r"), (3, "g"), (5, "b"))))


def hsl(r: Column, g: Column, b: Column) -> Column:
    """(h, s, l) as whole degrees and percents."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span, light = high - low, (high + low) / 2.0
    s = F.when(span == 0, 0.0).otherwise(span / F.when(light > 0.5, 2.0 - high - low).otherwise(F.when(span == 0, 1.0).otherwise(high + low)))
    safe = F.when(span == 0, 1.0).otherwise(span)
    h = (
        F.when(span == 0, 0.0)
        .when(high == r, (g - b) / safe + F.when(g < b, 6.0).otherwise(0.0))
        .when(high == g, (b - r) / safe + 2.0)
        .otherwise((r - g) / safe + 4.0)
    )
    return F.struct(
        js_round(h * 60.0).cast("int").alias("h"), js_round(s * 100.0).cast("int").alias("s"), js_round(light * 100.0).cast("int").alias("l")
    )


def hsl_hex(h: Column, s: Column, light: Column) -> Column:
    """``#rrggbb`` of whole degrees and percents."""
    s, light = s / 100.0, light / 100.0
    span = s * F.least(light, 1 - light)

    def channel(n: int, p: Column) -> Column:
        k = (F.lit(float(n)) + p["h"] / 30.0) % 12
        value = p["light"] - p["span"] * F.greatest(F.least(k - 3, 9 - k, F.lit(1.0)), F.lit(-1.0))
        return F.lpad(F.hex(js_round(255 * value).cast("long")), 2, "0")

    parts = F.struct(h.alias("h"), light.alias("light"), span.alias("span"))
    return bound(parts, lambda p: F.lower(F.concat(F.lit("#"), channel(0, p), channel(8, p), channel(4, p))))


def normalize_color(raw: Column) -> Column:
    """``#rrggbb`` of a hexadecimal colour or of rgb(); null for anything else."""
    text = F.lower(F.trim(raw))
    digits = F.regexp_extract(text, "^#?([0-9a-f]{6}|[0-9a-f]{3})$", 1)
    wide = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    pattern = r"^rgba?\(\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)"
    numbers = [F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("long") for i in (1, 2, 3)]
    return F.when(digits != "", F.concat(F.lit("#"), wide)).otherwise(F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(n), 2, "0")) for n in numbers)))


def color_distance(a: Column, b: Column) -> Column:
    """Euclidean, of (r, g, b) structs."""
    return F.sqrt(sum((F.pow(a[c] - b[c], F.lit(2.0)) for c in "rgb"), F.lit(0.0)))


def hsl_distance(a: Column, b: Column) -> Column:
    """0 to 1, of (h, s, l) structs, to four places; hues are not taken round the circle."""
    parts = [F.pow(F.abs(a[c] - b[c]) / most, F.lit(2.0)) for c, most in (("h", 360.0), ("s", 100.0), ("l", 100.0))]
    return F.round(F.sqrt(parts[0] + parts[1] + parts[2]) / F.sqrt(F.lit(3.0)), 4)


def color_scale(hex_: Column) -> Column:
    """Nine tones of a colour, 100 the lightest: map of stop to ``#rrggbb``."""
    tones = lambda base: F.create_map(*(x for i, tone in enumerate(range(90, 0, -10)) for x in (F.lit(str((i + 1) * 100)), hsl_hex(base["h"], base["s"], F.lit(tone)))))
    return bound(rgb(hex_), lambda c: bound(hsl(c["r"], c["g"], c["b"]), tones))


def palette_similarity(source: Column, made: Column) -> Column:
    """0 to 100: how near each colour of ``source`` has one in ``made``, on average."""
    near = F.transform(source, lambda s: F.array_min(F.transform(made, lambda m: color_distance(rgb(s), rgb(m)))))
    mean = F.aggregate(near, F.lit(0.0), lambda t, d: t + d) / F.size(near)
    return F.when((F.size(source) == 0) | (F.size(made) == 0), 0).otherwise(F.greatest(F.lit(0), js_round(100 - mean / 4.41))).cast("long")


def merged_colors(colors: Column, threshold: float = 30) -> Column:
    """Array of (hex, n), most frequent first: each colour counts for the first one before it
    that is nearer than ``threshold``, or stands for itself. The order given decides."""
    start = F.array().cast("array<struct<hex:string,n:int>>")

    def add(reps: Column, color: Column) -> Column:
        near = F.transform(reps, lambda r: color_distance(rgb(r["hex"]), rgb(color)) < threshold)
        at = F.array_position(near, F.lit(True))
        one = F.struct(color.alias("hex"), F.lit(1).alias("n"))
        counted = F.transform(reps, lambda r, i: F.struct(r["hex"].alias("hex"), (r["n"] + F.when(i + 1 == at, 1).otherwise(0)).alias("n")))
        return F.when(at > 0, counted).otherwise(F.concat(reps, F.array(one)))

    reps = F.aggregate(colors, start, add)
    order = F.transform(reps, lambda r, i: F.struct((-r["n"]).alias("k"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(order), lambda o: o["r"])


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def color_role(lum: Column, saturation: Column, share: Column) -> Column:
    return (
        F.when(lum > 200, "background")
        .when(lum < 40, "text")
        .when((saturation > 60) & (share < 0.05), "accent")
        .when(share >= 0.1, "primary")
        .otherwise("secondary")
    )
