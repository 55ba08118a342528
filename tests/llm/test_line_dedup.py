import time

from helpers import SF, connect, lower, same_rows

from quern.llm import common
from quern.llm.line_dedup import drop_common_lines
from quern.llm.queries import ORACLE, QUERIES


def brute(rows, min_docs, min_chars=1):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    seen = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and seen[key(x)] >= min_docs)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    out = drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    return sorted([(r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in out], key=str)


ROWS = [
    (1, "Footer\nbody one\n\nfooter "), (2, " FOOTER\nbody two"), (3, "footer"), (None, "footer\nx"), (5, None), (6, ""), (7, "\n\n"),
    (8, "a\nfooter\nb\nfooter\nfooter\nc"), (8, "a\nfooter\nb\nfooter\nfooter\nc"), (9, "ÄB\näb "), (10, "footer\n" * 40 + "end"),
]


def test_edge_rows_equal_brute_force(spark):
    for least in (2, 3, 100):
        assert run(spark, ROWS, min_docs=least) == brute(ROWS, least)
    assert run(spark, ROWS, min_docs=2, min_chars=2) == brute(ROWS, 2, 2)


def test_no_key_is_hot_or_every_key_is(spark, monkeypatch):
    for keys in (1, 10**9):
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        assert run(spark, ROWS, min_docs=2) == brute(ROWS, 2)


def test_an_empty_table_and_clashing_names(spark):
    assert run(spark, [], min_docs=2) == []
    rows = [(1, "x\ny", "k", 4, 5), (2, "x", "l", 6, 7)]
    out = drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string, kept_text string, n_dropped int, found int"), min_docs=2)
    assert sorted((r.doc_id, r.kept_text, r.n_dropped, r.found) for r in out.collect()) == [(1, "y", 1, 5), (2, "", 1, 7)]


def test_time_grows_with_the_lines_of_a_text_not_their_square(spark):
    rows = [(d, "\n".join(f"common {i}" if i % 3 else f"own {d} {i}" for i in range(50_000))) for d in range(10)]
    began = time.time()
    out = drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).select("n_dropped", "kept_text").collect()
    assert {r.n_dropped for r in out} == {33_333} and all(r.kept_text.count("\n") == 16_666 for r in out)
    assert time.time() - began < 60


def test_the_query_equals_sql(spark):
    same_rows(QUERIES["op1_line_dedup"](spark, SF), connect().execute(ORACLE["op1_line_dedup"]))
