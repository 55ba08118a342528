"""Quality classifier: a sparse ensemble of rules over text statistics.

A small forest is grown on labelled statistics, every path of a tree becomes a
conjunctive rule, a lasso logistic regression gives most rules no weight, and the rest
compile into one Spark column expression. Scoring is a scan with built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize

#: Rows that the fit takes at most, those with the smallest hashes.
SAMPLE_ROWS = 12_000

Rule = tuple[tuple[str, str, float], ...]


def bound(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of ``values``, each evaluated once, however often body uses it and
    whatever projections and filters an optimiser merges."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), 0)


NAMES = ("log_words", "word_length", "symbols", "upper", "digits", "stops", "distinct_words", "distinct_lines", "words_per_line")


def statistics(text: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of the statistics NAMES of a whole text; null counts as empty,
    ratios over nothing are 0.

    A text is split into words once and into lines once; symbols, capitals, digits and stops
    are counted in what is left of it without small Latin letters and spaces.
    """

    def per(n: Column, of: Column) -> Column:
        return F.when(of > 0, n / of).otherwise(0.0)

    def counts(t: Column) -> Column:
        ends = t["tokens"][0] == ""
        last = F.element_at(t["tokens"], -1) == ""
        return bound(
            {
                "chars": F.length(t["text"]),
                # A blank at either end gives an empty token there; a blank text, one or two.
                "words": F.greatest(F.size(t["tokens"]) - ends.cast("int") - last.cast("int"), F.lit(0)),
                "solid": F.length(F.array_join(t["tokens"], "")),
                "distinct": F.size(F.array_distinct(t["tokens"])),
                "lines": F.size(t["lines"]),
                "distinct_lines": F.size(F.array_distinct(t["lines"])),
                "symbols": F.regexp_count(t["rest"], F.lit(r"[^\p{L}\p{N}\s.,;:'\"()-]")),
                "upper": F.regexp_count(t["rest"], F.lit(r"\p{Lu}")),
                "digits": F.regexp_count(t["rest"], F.lit("[0-9]")),
                "stops": F.regexp_count(t["rest"], F.lit("[.,;:]")),
            },
            ratios,
        )

    def ratios(n: Column) -> Column:
        found = {
            "log_words": F.log1p(n["words"].cast("double")),
            "word_length": per(n["solid"], n["words"]),
            "symbols": per(n["symbols"], n["chars"]),
            "upper": per(n["upper"], n["chars"]),
            "digits": per(n["digits"], n["chars"]),
            "stops": per(n["stops"], n["words"]),
            "distinct_words": per(n["distinct"], n["words"]),
            "distinct_lines": per(n["distinct_lines"], n["lines"]),
            "words_per_line": per(n["words"], n["lines"]),
        }
        return bound({k: c.cast("double") for k, c in found.items()}, body)

    def parts(t: Column) -> Column:
        whole = t["text"]
        return bound(
            {
                "text": whole,
                "tokens": F.split(F.lower(whole), r"[\x20\x09-\x0D]+"),
                "lines": F.split(whole, "\n", -1),
                "rest": F.regexp_replace(whole, r"[a-z\x20]+", ""),
            },
            counts,
        )

    return bound({"text": F.coalesce(text, F.lit(""))}, parts)


def tree_rules(debug: str, names: list[str]) -> list[Rule]:
    """The conditions on the way to every node of a tree, as printed by Spark."""
    rules: list[Rule] = []
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            depth = len(m[1])
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, (names[int(m[2])], m[3], float(m[4]))))
            rules.append(tuple(sorted({c for _, c in path})))
    return rules


def rule_column(rule: Rule, of: Column | None = None) -> Column:
    """1.0 where all conditions of a rule hold, on columns or on the fields of a struct."""
    held = F.lit(True)
    for name, op, value in rule:
        stat = F.col(name) if of is None else of[name]
        held = held & (stat <= value if op == "<=" else stat > value)
    return held.cast("double")


def fit_rules(
    labelled: DataFrame, names: list[str], *, trees: int = 12, depth: int = 3, penalty: float = 0.003, seed: int = 7
) -> tuple[float, list[tuple[float, Rule]]]:
    """(intercept, weighted rules) from statistics ``names`` and ``label`` (0/1).

    Without rows of both labels there are no rules, and the intercept is the log-odds of
    the labels seen (with one more of either).
    """
    n, ones = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < n:
        return _log_odds(ones, n), []
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(labelled).select("features", "label", *names)
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, subsamplingRate=0.7, seed=seed
    ).fit(vectors)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree.toDebugString, names)})
    if not rules:
        return _log_odds(ones, n), []
    held = labelled.select("label", *(rule_column(r).alias(f"r{i}") for i, r in enumerate(rules)))
    held = VectorAssembler(inputCols=held.columns[1:], outputCol="features").transform(held).select("features", "label")
    model = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(held)
    return float(model.intercept), [(float(w), r) for w, r in zip(model.coefficients, rules, strict=True) if w]


def _log_odds(ones: int, n: int) -> float:
    from math import log

    return log((ones + 1) / (n - ones + 1))


def score_column(intercept: float, rules: list[tuple[float, Rule]], text: Column) -> Column:
    """The score of a text."""

    def score(s: Column) -> Column:
        total = F.lit(intercept)
        for weight, rule in rules:
            total = total + rule_column(rule, s) * weight
        return 1 / (1 + F.exp(-total))

    return statistics(text, score)


def held_out(id_: Column) -> Column:
    """Ids whose labels no fit may see."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    **options,
) -> DataFrame:
    """All columns of ``docs`` plus ``held_out``, ``score`` (0 to 1) and ``predicted`` (0 or 1).

    The fit sees at most ``sample_rows`` labelled rows that are not held out, those whose
    ids and texts have the smallest hashes; everything else covers all rows. Null labels are
    not used, an id with several labels counts with the smallest. Null and empty texts get a
    score too; null ids are scored and not held out; repeated rows get equal scores. No
    labels, or one kind only: the same score for all. A very long text is one row of one
    task. An empty table gives an empty table. Columns of ``docs`` with a name of a result
    are replaced; others may have any name.
    """
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    sample = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(known), "id")  # sample_rows at most
        .select(F.xxhash64("id", "text").alias("h"), "id", F.col("label").cast("double").alias("label"), statistics(F.col("text"), lambda s: s).alias("s"))
        .orderBy("h", "id")
        .limit(sample_rows)  # repeated ids count as rows
        .select("label", "s.*")
    )
    intercept, rules = fit_rules(materialize(sample, "sample").coalesce(4), list(NAMES), **options)
    plain = docs.drop("held_out", "score", "predicted")
    score = score_column(intercept, rules, F.col(text_col).cast("string"))
    return plain.withColumns({"held_out": held_out(F.col(id_col)), "score": score}).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
