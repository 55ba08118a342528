"""Route patterns: segments, structural matches, wildcards. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATCH_ALL = r"\[\[?\.\.\."


def pieces(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def segments(path: Column) -> Column:
    """Array of (raw, kind): wildcard (``*``, ``**``), param (``:name``) or literal."""
    kind = lambda s: F.when(s.isin("*", "**"), "wildcard").when(s.startswith(":"), "param").otherwise("literal")
    return F.transform(pieces(path), lambda s: F.named_struct(F.lit("raw"), s, F.lit("kind"), kind(s)))


def structural_match(a: Column, b: Column) -> Column:
    """Whether two arrays of segments can stand for one path: of one length, each segment equal
    or either of them open; or a wildcard at an end takes what is over."""
    open_ = lambda s: s["kind"] != "literal"
    same = F.forall(F.zip_with(a, b, lambda x, y: open_(x) | open_(y) | (x["raw"] == y["raw"])), lambda ok: ok)

    def takes(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_element_at(x, F.lit(-1))["kind"] == "wildcard", F.lit(False)) & (F.size(y) >= F.size(x) - 1)

    return F.when(F.size(a) == F.size(b), same).otherwise(takes(a, b) | takes(b, a))


def wildcard_captures(pattern: Column, path: Column) -> Column:
    """Whether a path (array of segments) falls under a pattern: ``*`` and ``:name`` take one
    segment, ``**`` at least one and all that follow."""
    raws = F.transform(pattern, lambda s: s["raw"])
    rest = F.array_position(raws, F.lit("**")).cast("int")  # 1-based, 0 where there is none
    head = F.when(rest > 0, F.slice(pattern, 1, F.greatest(rest - 1, F.lit(0)))).otherwise(pattern)
    long_enough = F.when(rest > 0, F.size(path) >= rest).otherwise(F.size(path) == F.size(pattern))
    fits = F.forall(
        F.zip_with(head, F.slice(path, 1, F.greatest(F.size(head), F.lit(0))), lambda w, t: (w["kind"] != "literal") | F.coalesce(w["raw"] == t["raw"], F.lit(False))),
        lambda ok: ok,
    )
    return long_enough & fits


def bracketed(route: Column) -> Column:
    """``:name`` as ``[name]``."""
    return F.regexp_replace(route, r":(\w+)", r"[$1]")


def matches(path: Column, pattern: Column) -> Column:
    """Whether a path fits a pattern whose ``[name]`` take one segment; with a catch-all
    (``[...name]``), what stands before it is all that counts."""
    p, u = pieces(pattern), pieces(path)
    each = F.forall(F.zip_with(p, u, lambda s, v: is_open(s) | F.coalesce(s == v, F.lit(False))), lambda ok: ok)
    return F.when(pattern.rlike(CATCH_ALL), F.startswith(path, before_catch_all(pattern))).otherwise((F.size(p) == F.size(u)) & each)


def is_open(segment: Column) -> Column:
    """Whether a pattern's segment takes any segment of a path."""
    return segment.startswith("[") & segment.endswith("]")


def before_catch_all(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"/\[\.{1,3}.*$|/\[\[\.{1,3}.*$", "")


def open_shape(route: Column) -> Column:
    """A route with every bracketed segment as ``[*]``."""
    return F.regexp_replace(route, r"\[[^\]/]*\]+", "[*]")
