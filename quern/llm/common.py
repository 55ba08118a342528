"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.scratch import materialize, passing, read_back, remove, shared_dir, shuffles_dropped, write_out

__all__ = ["materialize", "passing", "read_back", "remove", "shared_dir", "shuffles_dropped", "write_out"]

#: The characters that the contracts call white space, 0x20 and 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Keys that are broadcast because they are frequent, at most: a key with a share of
#: 1 / HOT_KEYS or more of all rows, so there are never more, whatever the size of the table.
HOT_KEYS = 100_000


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; all-ASCII values take the fast built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, LOWER)
    )


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: at 10^13 keys a collision stays unlikely. Which
    values are null is part of the key: xxhash64 alone passes over nulls."""
    nulls = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in cols))
    return F.xxhash64(nulls, *cols), F.xxhash64(F.lit(0x5EED), nulls, *cols)


def look_up(rows: DataFrame, known: DataFrame, keys: list[str], count: str, spread: Column) -> DataFrame:
    """``rows`` plus the other columns of ``known``, by ``keys``; null where not known.

    ``known`` is a written table with one row a key and in ``count`` about how many rows of
    ``rows`` have it. Keys with at least 1 / HOT_KEYS of all those rows, so HOT_KEYS at
    most, are broadcast; rows that they answer go on by ``spread``, a long that tells rows
    apart, and all others meet the rest of ``known`` by their keys. No task gets a hot key.
    """
    total = known.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    bar = max(2, -(-total // HOT_KEYS))
    told = [c for c in known.columns if c not in keys and c != count]

    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*(F.col(k).alias(f"{tag}{k}") for k in keys), F.struct(F.lit(True).alias("found"), *told).alias(f"{tag}told"))

    hot, cold = named(known.filter(F.col(count) >= bar), "_hot_"), named(known.filter(F.col(count) < bar), "_cold_")
    on_hot = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    marked = rows.join(F.broadcast(hot), on_hot, "left")
    answered = F.col("_hot_told").isNotNull()
    moved = {f"_to_{k}": F.when(answered, spread).otherwise(F.col(k)) if i == 0 else F.col(k) for i, k in enumerate(keys)}
    on_cold = [F.col(f"_to_{k}") == F.col(f"_cold_{k}") for k in keys]
    joined = marked.withColumns(moved).join(cold, on_cold, "left")
    value = F.coalesce("_hot_told", "_cold_told")
    return joined.select(*rows.columns, value["found"].alias("found"), *(value[c].alias(c) for c in told))


