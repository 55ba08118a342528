from math import floor, log

import duckdb
import pytest
from helpers import lower, words_of
from pyspark.sql import functions as F

from quern.llm.lm_score import score_documents
from quern.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    return c


def test_trigram_scores_equal_sql(spark, con):
    got = sorted(tuple(r) for r in QUERIES["op6_lm_trigram_scoring"](spark, SF).select("doc_id", "n_words", "n_top", "log_micro").collect())
    want = con.execute(f"SELECT doc_id, n_words, n_top, log_micro FROM ({ORACLE['op6_lm_trigram_scoring']}) ORDER BY ALL").fetchall()
    assert len(got) == len(want)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    # Logarithms of two libraries may differ in the last bit, so a word may round to the next millionth.
    assert all(abs(g[3] - w[3]) <= 1 + g[1] // 1000 for g, w in zip(got, want, strict=True))


def test_a_word_keeps_two_words_of_context(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d b c")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_words, r.n_top) for r in QUERIES["op6_lm_trigram_scoring"](spark, str(tmp_path)).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 0)}


def test_pair_scores_equal_sql(spark, con):
    got = sorted(tuple(r) for r in QUERIES["op6_lm_scoring"](spark, SF).select("doc_id", "n_words", "n_top", "log_micro").collect())
    want = con.execute(f"SELECT doc_id, n_words, n_top, log_micro FROM ({ORACLE['op6_lm_scoring']}) ORDER BY ALL").fetchall()
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) <= 1 + g[1] // 1000 for g, w in zip(got, want, strict=True))


def brute(rows, order, alpha, min_docs):
    """Stupid backoff from dictionaries of counts."""
    texts = [lower(t or "") for _, t in rows]
    docs = [words_of(t) for t in texts]
    counts, held = {}, {}
    for i, ws in enumerate(docs):
        for n in range(1, order + 1):
            for j in range(len(ws) - n + 1):
                g = tuple(ws[j : j + n])
                counts[g] = counts.get(g, 0) + 1
                held.setdefault(g, set()).add(i)
    counts = {g: c for g, c in counts.items() if len(held[g]) >= min_docs}
    total, out = sum(map(len, docs)), []
    for (d, _), ws in zip(rows, docs, strict=True):
        micro = top = 0
        for j in range(len(ws)):
            most = min(order, j + 1)
            for n in range(most, -1, -1):
                g = tuple(ws[j - n + 1 : j + 1])
                if n and g in counts:
                    value = log(counts[g] / (counts[g[:-1]] if n > 1 else total))
                    break
            else:
                value = -log(total)
            micro += floor((value + (most - n) * log(alpha)) * 1e6 + 0.5)
            top += n == order
        out.append((d, len(ws), top, micro))
    return sorted(out, key=str)


ROWS = [
    (1, "a b c d a b"), (2, "A b c x"), (None, "a b c"), (4, None), (5, ""), (6, " \n"), (7, "lonely"), (8, "a b a b a b"), (8, "a b a b a b"), (9, "b " * 30_000 + "c"),
]


@pytest.mark.parametrize("order, min_docs, chunk", [(1, 2, 1 << 20), (2, 2, 30), (3, 2, 1), (4, 3, 40), (3, 1, 1 << 20), (2, 300, 64)])
def test_scores_equal_brute_force(spark, order, min_docs, chunk):
    rows = ROWS + [(1000 + i, f"common words {i}") for i in range(310 if min_docs > 255 else 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit(1))
    got = sorted((tuple(r) for r in score_documents(df, order=order, min_docs=min_docs, chunk_bytes=chunk).collect()), key=str)
    want = brute(rows, order, 0.4, min_docs)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) <= 1 + g[1] // 1000 for g, w in zip(got, want, strict=True))


def test_an_empty_table(spark):
    assert score_documents(spark.createDataFrame([], "doc_id string, text string"), order=3).collect() == []
