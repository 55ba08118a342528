"""Rule tables as Column expressions: weighted signals, arg-max, thresholds."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the signals that tell content types.
SIGNALS = {"url": 0.35, "title": 0.25, "words": 0.15, "images": 0.10, "depth": 0.08, "node": 0.05, "description": 0.02}
#: Fixed values, for each content type: patterns of URLs, patterns of titles and descriptions, and
#: the range of words that fits. Case does not count.
CONTENT_TYPES = {
    "ARTICLE": ((r"/(article|articles|post|posts|news|story|stories)/", r"/\d{4}/\d{2}/\d{2}/", r"/(press|releases|announcements)/"),
                (r"\b(report|analysis|interview|exclusive|breaking|review|recap|recap)\b", r"\b\d{4}\b"), (300, 2000)),
    "BLOG": ((r"/(blog|blogs|journal|diary|updates|thoughts)/", r"/(author|authors|by-)\w+"),
             (r"\b(thoughts|musings|weekly|monthly|update|updates|reflections)\b", r"\b(my |our |week in|day in)\b"), (200, 1500)),
    "GUIDE": ((r"/(guide|guides|how-to|howto|tutorial|tutorials|learn|learning)/", r"/(getting-started|quickstart|walkthrough|walkthrough)/"),
              (r"\b(how to|guide|tutorial|step-by-step|beginner|advanced|complete|ultimate|introduction|intro)\b", r"\b(learn|master|getting started)\b"), (500, 5000)),
    "LANDING_PAGE": ((r"^/?$", r"/(home|index|welcome|start|solutions|features|pricing|about|contact)/?$", r"/(product|products|service|services)/?$"),
                     (r"\b(welcome|home|solutions|features|pricing|get started|sign up|free trial|demo)\b", r"\b(about us|contact us|our mission|our team)\b"), (50, 600)),
    "PORTFOLIO": ((r"/(portfolio|work|projects|case-studies|case-study|showcase|gallery)/", r"/(clients|testimonials)/"),
                  (r"\b(project|case study|client|work|built for|designed for)\b", r"\b(showcase|featured|our work)\b"), (50, 800)),
    "GALLERY": ((r"/(gallery|galleries|photos|images|pictures|albums|album|media)/", r"/(looks|collections|collection|lightbox)/"),
                (r"\b(photos?|pictures?|images?|gallery|album|collection|look\s?book)\b", r"\b(behind the scenes|photo essay)\b"), (0, 300)),
    "FAQ": ((r"/(faq|faqs|frequently-asked|questions|q-and-a|qa)/?", r"/(help|support|knowledge-?base)/"),
            (r"\b(faq|frequently asked|questions|q&a|q and a|help center)\b", r"\?$"), (100, 3000)),
    "DOCS": ((r"/(docs|documentation|api|reference|spec|specs|manual|manuals|handbook)/", r"/(developer|developers|sdk|api-reference|getting-started)/"),
             (r"\b(api|sdk|reference|documentation|specification|endpoint|parameter|method|class|function|module)\b", r"\b(v\d+\.\d+|release notes|changelog|migration)\b"), (200, 10000)),
}


#: What the patterns' signs mean, in the syntax of Java: ends of words and blanks are those of ASCII
#: letters (before "our", an accented letter is such an end), ``$`` is the end of the text alone,
#: and the long s and the Kelvin sign are s and k, as case does not count.
_SIGNS = {r"\b": r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))", r"\s": r"[\t\n\f\r ]", "$": r"\z", "s": "[s\u017f]", "k": "[k\u212a]"}


def _any_of(patterns: Iterable[str]) -> str:
    """One pattern, in Java's syntax, for those of ``CONTENT_TYPES``."""
    return "(?i)" + re.sub(r"\\.|[sk$]", lambda m: _SIGNS.get(m[0], m[0]), "|".join(patterns))


def weighted_sum(parts: Iterable[tuple[Column, float]]) -> Column:
    """Values times their weights, added in the order given."""
    total = F.lit(0.0)
    for value, weight in parts:
        total = total + value * weight
    return total


def content_scores(url: Column, title: Column, description: Column, words: Column, images: Column, depth: Column, node: Column) -> dict[str, Column]:
    """The score (0 to 1) of each content type for a page; ``node``: root, index, pagination,
    asset or anything else. Null title or description counts as empty."""
    ratio = images / F.greatest(words, F.lit(1))
    about = F.coalesce(description, F.lit(""))
    named = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), about)

    def at_least(c: Column, n: int, yes: float, no: float) -> Column:
        return F.when(c >= n, yes).otherwise(no)

    by_images = {
        "ARTICLE": at_least(images, 1, 0.7, 0.5), "BLOG": at_least(images, 1, 0.7, 0.5), "GUIDE": at_least(images, 1, 0.8, 0.6), "LANDING_PAGE": at_least(images, 1, 0.8, 0.3),
        "PORTFOLIO": F.when(ratio > 0.02, 1.0).otherwise(ratio * 50), "GALLERY": F.when(ratio > 0.05, 1.0).otherwise(ratio * 20),
        "FAQ": F.when(images <= 3, 0.9).otherwise(0.5), "DOCS": F.when(images <= 5, 0.9).otherwise(0.5),
    }
    deep = F.when(depth >= 2, 0.9).when(depth == 1, 0.6).otherwise(0.2)
    by_depth = {
        "ARTICLE": deep, "BLOG": deep, "GUIDE": at_least(depth, 1, 0.8, 0.4), "LANDING_PAGE": F.when(depth == 0, 1.0).when(depth == 1, 0.6).otherwise(0.2),
        "PORTFOLIO": at_least(depth, 1, 0.8, 0.4), "GALLERY": at_least(depth, 1, 0.8, 0.4), "FAQ": at_least(depth, 1, 0.9, 0.5), "DOCS": at_least(depth, 2, 0.9, 0.5),
    }
    out = {}
    for kind, (urls_, titles, (low, high)) in CONTENT_TYPES.items():
        landing = kind == "LANDING_PAGE"
        by_node = (
            F.when(node == "root", 1.0 if landing else 0.1).when(node == "index", 0.8 if landing else 0.7 if kind == "DOCS" else 0.4)
            .when(node == "pagination", 0.3).when(node == "asset", 0.1).otherwise(0.6)
        )
        by_words = F.when((words >= low) & (words <= high), 1.0).when(words < low, words / max(low, 1)).otherwise(F.greatest(F.lit(0.0), 1 - (words - high) / high))
        found = lambda text, patterns: F.coalesce(text.rlike(_any_of(patterns)), F.lit(False))
        parts = {
            "url": F.when(found(url, urls_), 1.0).otherwise(0.0), "title": F.when(found(named, titles), 1.0).otherwise(0.0), "words": by_words, "images": by_images[kind],
            "depth": by_depth[kind], "node": by_node, "description": F.when(F.length(about) > 20, 1.0).otherwise(0.0),
        }
        out[kind] = F.least(F.lit(1.0), weighted_sum((value, SIGNALS[name]) for name, value in parts.items()))
    return out


def best_types(scores: dict[str, Column]) -> Column:
    """(kind, confidence, others): the highest score, the first of equals, and of the next three
    those above 0.1, as structs (kind, confidence); confidences to two places."""
    entries = [F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("kind")) for i, (n, s) in enumerate(scores.items())]
    cents = lambda e: F.floor(e["score"] * 100 + 0.5) / 100

    def told(ranked: Column) -> Column:
        next_ = F.filter(F.slice(ranked, 2, 3), lambda e: e["score"] > 0.1)
        others = F.transform(next_, lambda e: F.named_struct(F.lit("kind"), e["kind"], F.lit("confidence"), cents(e)))
        return F.struct(ranked[0]["kind"].alias("kind"), cents(ranked[0]).alias("confidence"), others.alias("others"))

    return F.get(F.transform(F.array(F.sort_array(F.array(*entries), asc=False)), told), 0)


def gate(delta: Column, threshold: float) -> Column:
    """PASS without a loss, WARN for at most half the threshold, else FAIL; SKIP without a value."""
    return F.when(delta.isNull(), "SKIP").when(delta >= 0, "PASS").when(-delta <= threshold / 2, "WARN").otherwise("FAIL")
