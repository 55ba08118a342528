import zlib

import pytest
from helpers import words_of

from quern.llm.quality import NAMES, fit_rules, score_quality, statistics, tree_rules

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


TEXTS = [None, "", " ", "\n", " a ", "One two\nTWO 3.\n\nend, é!", "x" * 100_000, "w " * 50_000, "a\x0bb\x0cc"]


def test_statistics_equal_a_plain_count(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = {r.i: r.s for r in df.select("i", statistics(df.text, lambda s: s).alias("s")).collect()}
    for i, t in enumerate(TEXTS):
        t, w = t or "", words_of(t)
        lines = t.split("\n")
        assert got[i]["word_length"] == pytest.approx(sum(map(len, w)) / len(w) if w else 0)
        assert got[i]["words_per_line"] == pytest.approx(len(w) / len(lines))
        assert got[i]["distinct_lines"] == pytest.approx(len(set(lines)) / len(lines))
        assert got[i]["upper"] == pytest.approx(sum(c.isupper() for c in t) / len(t) if t else 0)
        assert got[i]["digits"] == pytest.approx(sum(c in "0123456789" for c in t) / len(t) if t else 0)
        assert got[i]["symbols"] == pytest.approx(t.count("!") / len(t) if t else 0)
        assert got[i]["stops"] == pytest.approx(sum(t.count(c) for c in ".,;:") / len(w) if w else 0)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_labels_are_met_and_never_seen(spark, tables):
    docs, labels = tables
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = {r.doc_id: r for r in score_quality(docs, labels).drop("text").collect()}
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in out.items())
    asked = [i for i in truth if held(i) and i in out]
    right = sum(out[i].predicted == truth[i] for i in asked)
    assert len(asked) > 50 and right >= 0.95 * len(asked)
    # Other labels for held-out rows change nothing.
    other = spark.createDataFrame([(i, 1 - q if held(i) else q) for i, q in truth.items()], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in score_quality(docs, other).collect()}
    assert all(abs(again[i] - r.score) < 1e-12 for i, r in out.items())


def test_edge_rows_and_clashing_names(spark, tables):
    _, labels = tables
    rows = [(1, None, 7, 8, 9), (1, None, 7, 8, 9), (None, "", 1, 2, 3), (2, "word " * 200_000, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, qs_id int, score int")
    out = score_quality(docs, labels.limit(40)).collect()
    assert len(out) == 4 and {r.label for r in out} == {1, 7} and all(0 <= r.score <= 1 for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert score_quality(docs.limit(0), labels).collect() == []
    one = {r.score for r in score_quality(docs, labels.filter("quality = 1")).collect()}
    none = {r.score for r in score_quality(docs, labels.limit(0)).collect()}
    assert len(one) == len(none) == 1


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(i % 10, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    assert score_quality(docs, labels, sample_rows=20).count() == 500


def test_tree_paths_become_rules(spark):
    text = "Tree\n  If (feature 0 <= 0.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0\n"
    a, b = NAMES[:2]
    assert tree_rules(text, list(NAMES)) == [((a, "<=", 0.5),), ((a, "<=", 0.5), (b, "<=", 2.0)), ((a, "<=", 0.5), (b, ">", 2.0)), ((a, ">", 0.5),)]
    flat = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], f"label double, {a} double")
    assert fit_rules(flat, [a])[1] == []
