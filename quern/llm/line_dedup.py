"""Drop lines that many documents share. DataFrame functions only.

Lines are exploded and reduced to 128-bit keys, the documents of a key are counted
with map-side partial sums, and positions of frequent keys go back to their
documents. Texts cross the network once, in the last join; keys and positions are
all that the other exchanges carry. A line that is in very many documents is looked up
in a broadcast of bounded size, so no task gets all its positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE, ascii_lower, hash128, look_up, materialize


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def drop_common_lines(
    docs: DataFrame,
    *,
    min_docs: int = 10,
    min_chars: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``docs`` plus ``kept_text``, ``n_lines``, ``n_dropped``.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents
    loses all its lines everywhere; the other lines stay in order, joined by ``\\n``.

    Null or empty text is one empty line and is kept. Each row counts as a document
    of its own, also where ids repeat or are null; equal rows get equal results. A
    document that loses every line keeps ``''``. A very long text takes time in proportion
    to its lines, in one task. An empty table gives an empty table. Columns of ``docs``
    named like the three results are replaced; other names may be any, but for those that
    begin with ``_ld_``, ``_hot_``, ``_cold_`` or ``_to_``.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    k1, k2 = hash128(F.col(id_col), F.col(text_col))
    lines = docs.select(_lines(F.col(text_col)).alias("_ld_lines"), k1.alias("_ld_k1"), k2.alias("_ld_k2"))

    def keyed(key: Column) -> tuple[Column, Column]:
        a, b = hash128(key)
        return a.alias("_ld_h1"), b.alias("_ld_h2")

    frequent = (
        lines.select(F.explode(F.array_distinct(F.transform("_ld_lines", line_key))).alias("_ld_key"))
        .filter(F.length("_ld_key") >= min_chars)
        .select(*keyed(F.col("_ld_key")))
        .groupBy("_ld_h1", "_ld_h2")
        .agg(F.count(F.lit(1)).alias("_ld_n"))
        .filter(F.col("_ld_n") >= min_docs)
    )
    frequent = materialize(frequent, "lines")
    keys = (
        lines.select("_ld_k1", "_ld_k2", F.posexplode("_ld_lines").alias("_ld_pos", "_ld_line"))
        .select("_ld_k1", "_ld_k2", "_ld_pos", line_key(F.col("_ld_line")).alias("_ld_key"))
        .filter(F.length("_ld_key") >= min_chars)
        .select("_ld_k1", "_ld_k2", "_ld_pos", *keyed(F.col("_ld_key")))
    )
    dropped = (
        look_up(keys, frequent, ["_ld_h1", "_ld_h2"], "_ld_n", F.col("_ld_k1") + F.col("_ld_pos"))
        .filter("found")
        .groupBy("_ld_k1", "_ld_k2")
        .agg(F.collect_set("_ld_pos").alias("_ld_dropped"))
    )
    out = docs.withColumns({"_ld_k1": k1, "_ld_k2": k2}).join(dropped, ["_ld_k1", "_ld_k2"], "left")
    # Both arrays are bound once in a lambda; a mere expression would be evaluated per line.
    bound = F.array(F.struct(_lines(F.col(text_col)).alias("lines"), F.sort_array(F.coalesce("_ld_dropped", F.array().cast("array<int>"))).alias("gone")))
    kept = F.get(F.transform(bound, lambda b: F.array_join(_between(b["lines"], b["gone"]), "\n")), 0)
    return out.withColumns(
        {
            "kept_text": F.when(F.col("_ld_dropped").isNull(), F.coalesce(text_col, F.lit(""))).otherwise(kept),
            "n_lines": F.size(_lines(F.col(text_col))).cast("long"),
            "n_dropped": F.coalesce(F.size("_ld_dropped"), F.lit(0)).cast("long"),
        }
    ).drop("_ld_k1", "_ld_k2", "_ld_dropped")


def _between(lines: Column, gone: Column) -> Column:
    """The lines without those at the sorted positions ``gone``: the runs between them, one
    after another."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    ends = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
