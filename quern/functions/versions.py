"""Version numbers, rolling hashes, sizes and small measures. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version(v: Column) -> Column:
    """(major, minor, patch) of ``v1.2.3``; what is no number counts as 0. Structs order as versions do."""
    parts = F.split(F.regexp_replace(v, "^v", ""), r"\.")

    def part(i: int) -> Column:
        digits = F.regexp_extract(F.coalesce(F.get(parts, i), F.lit("")), r"^\s*([0-9]{1,9})", 1)
        return F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(0))

    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"))


def is_version(v: Column) -> Column:
    return F.regexp_replace(v, "^v", "").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$")


def bump(v: Column, kind: Column) -> Column:
    n = version(v)
    text = lambda *c: F.concat_ws(".", *(x.cast("string") for x in c))
    zero = F.lit(0)
    return (
        F.when(kind == "major", text(n["major"] + 1, zero, zero))
        .when(kind == "minor", text(n["major"], n["minor"] + 1, zero))
        .when(kind == "patch", text(n["major"], n["minor"], n["patch"] + 1))
    )


def compare(a: Column, b: Column) -> Column:
    """The difference in the first number that differs, 0 for equal versions."""
    x, y = version(a), version(b)
    return F.coalesce(*(F.nullif(x[k] - y[k], F.lit(0)) for k in ("major", "minor", "patch")), F.lit(0))


def hash31(text: Column) -> Column:
    """h = 31 h + code, modulo 2^32, over UTF-16 units."""
    step = lambda h, code: F.pmod(h * 31 + code, F.lit(1 << 32))

    def both(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        high, low = F.floor((code - 0x10000) / 1024) + 0xD800, (code - 0x10000) % 1024 + 0xDC00
        return F.when(code < 0x10000, step(h, code)).otherwise(step(step(h, high), low))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), both)


def _hex8(n: Column) -> Column:
    return F.lower(F.lpad(F.hex(n), 8, "0"))


def palette_hash(colors: Column) -> Column:
    """Eight hex digits of the first five colours; ``000000`` without one."""
    return F.when(F.size(colors) == 0, "000000").otherwise(_hex8(hash31(F.replace(F.array_join(F.slice(colors, 1, 5), ""), F.lit("#"), F.lit("")))))


def graph_id(seed: Column) -> Column:
    h = hash31(seed)
    signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    return F.concat(F.lit("sg-"), _hex8(F.abs(signed)))


def pixels(value: Column) -> Column:
    """CSS length in pixels: px, rem and em (16 px) or bare; null for anything else."""
    number = F.regexp_extract(F.trim(value), r"^([0-9]+\.?[0-9]*|\.[0-9]+)(px|rem|em)?$", 1)
    unit = F.regexp_extract(F.trim(value), r"^[0-9.]+(px|rem|em)?$", 1)
    return F.nullif(number, F.lit("")).cast("double") * F.when(unit.isin("rem", "em"), 16.0).otherwise(1.0)


def clamp(n: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(n + 0.5))).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """At most 1; nothing over nothing is 1, anything else over nothing 0."""
    return F.when(b == 0, F.when(a == 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.try_divide(a.cast("double"), b)))


def proximity(a: Column, b: Column, most: float) -> Column:
    """100 for equal numbers, less in proportion to their distance, 0 from ``most`` on."""
    near = F.floor((1 - F.abs(a - b) / F.lit(float(most))) * 100 + 0.5)
    return F.when((a == 0) & (b == 0), 100).otherwise(F.greatest(F.lit(0), near)).cast("long")


def optimizer_priority(gain: Column, cost: Column, confidence: Column) -> Column:
    """Gain for its cost (1 to 5) and confidence, to a tenth."""
    return F.floor(gain * ((6 - cost) / 5) * confidence * 1000 + 0.5) / 10
