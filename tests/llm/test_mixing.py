from collections import Counter

from helpers import SF, connect, same_rows, words_of

from quern.llm.mixing import mix_plan, mixed_documents, source_targets, taken_words
from quern.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, source string"


def targets(sizes, share=1.5, epochs=2, weights=(5, 2, 1)):
    """By filling the sources that are full, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        free = {s: w for s, w in weight.items() if s not in full}
        over = [s for s, w in free.items() if left * w / sum(free.values()) >= epochs * sizes[s]]
        if not over:
            return {**full, **{s: left * w / sum(free.values()) for s, w in free.items()}}
        s = min(over, key=lambda s: sizes[s] / weight[s])
        full[s] = epochs * sizes[s]
        left -= full[s]


def test_targets_equal_a_filling_by_hand(spark):
    sizes = {"a": 100, "b": 5000, "c": 30, None: 700, "é": 40, "z": 9000}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6


ROWS = [
    (1, "one two three", "a"), (1, "one two three", "a"), (None, "four five", None), (None, None, "a"), (2, "", "a"), (3, "six " * 3000, "b"), (4, "seven " * 40, "b"),
    (5, None, "x y"), (5, "x y", None), (6, "eight nine", "c"), (None, "ten eleven", "c"), (None, "twelve", "c"),
]


def test_words_taken_meet_the_targets_and_reruns_agree(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = taken_words(*mix_plan(docs, block_words=16)).collect()
    assert len(rows) == len(ROWS)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target) and all(0 <= r.taken <= 2 * r.size for r in own)
    again = taken_words(*mix_plan(docs.repartition(3), block_words=16)).collect()
    pick = lambda rs: sorted(str((r.id, r.source, r.size, r.taken)) for r in rs)
    assert pick(rows) == pick(again)


def test_rows_of_the_mix_hold_the_words_taken(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumnsRenamed({})
    taken = taken_words(*mix_plan(docs, block_words=16)).collect()
    out = mixed_documents(docs, block_words=16).collect()
    assert {r.text for r in out if r.doc_id == 5} == {"x y"}  # never the row whose text is null
    want, got = Counter(), Counter()
    for r in taken:
        want[(r.id, r.source)] += r.taken
    for r in out:
        assert r.text is not None and r.mix_slot is not None
        got[(r.doc_id, r.source)] += len(words_of(r.text))
    assert +want == +got


def test_twenty_thousand_equal_rows_and_rows_that_differ_in_another_column(spark):
    row = (7, "a b c d e", "s")
    docs = spark.range(20_000).selectExpr("7L as doc_id", "'a b c d e' as text", "'s' as source", "0 as lang")
    docs = docs.unionByName(spark.createDataFrame([(*row, 1)] * 3 + [(8, "x " * 60_000, "t", 0)], SCHEMA + ", lang int"))
    placed, pieces = mix_plan(docs)
    want = {r.source: r.taken for r in taken_words(placed, pieces).groupBy("source").sum("taken").withColumnRenamed("sum(taken)", "taken").collect()}
    out = mixed_documents(docs).select("source", "lang", "text", "mix_slot").collect()
    got = Counter()
    for r in out:
        got[r.source] += len(words_of(r.text))
    assert got == want and want["s"] > 100_000
    assert sum(r.lang == 1 for r in out) <= 6


def test_an_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 3, 4, 5)], SCHEMA + ", mix_slot int, size int, slot int")
    assert max((r.asDict() for r in mixed_documents(docs).drop("mix_slot").collect()), key=lambda r: r["text"]) == {"doc_id": 1, "text": "a b", "source": "s", "size": 4, "slot": 5}
    none = docs.limit(0)
    assert mixed_documents(none).collect() == [] and taken_words(*mix_plan(none)).collect() == []


def test_the_query_equals_sql(spark):
    same_rows(QUERIES["op3_mixing"](spark, SF), connect().execute(ORACLE["op3_mixing"]))
