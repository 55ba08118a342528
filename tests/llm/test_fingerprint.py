import hashlib
import random

import numpy as np
import pytest
from helpers import SF

from quern.llm import fingerprint as fp
from quern.llm.queries import QUERIES


def random_sets(rng, n, shared, own):
    both = [rng.getrandbits(64) for _ in range(shared)]
    return [np.unique(np.array(both + [rng.getrandbits(64) for _ in range(own)], np.uint64)) for _ in range(n)]


@pytest.mark.parametrize("shared, own", [(0, 0), (5, 0), (0, 3), (40, 2), (900, 5), (900, 700), (3, 4000)])
def test_likeness_of_two_fingerprints_is_that_of_their_sets(shared, own):
    a, b = random_sets(random.Random(shared * 7 + own), 2, shared, own)
    one, two = (fp.to_text(t) for t in fp.own_tables([a, b])[0])
    total = len(a) + len(b)
    want = 1.0 if not total else 1 - len(np.setxor1d(a, b)) / total
    assert fp.likeness(one, two) == pytest.approx(want)
    assert fp.likeness(one, one) == 1.0


def test_a_fingerprint_gives_back_all_digests_of_its_text():
    text = "\n".join(f"line {i} with some words in it" for i in range(3000))
    (digests,) = fp.paragraph_digests([text])
    (table,), (back,) = fp.own_tables([digests])
    assert np.array_equal(np.sort(back), digests)
    solved, _, found, sign = fp.peel(*(c[None] for c in fp.from_text(fp.to_text(table))))
    assert solved.all() and (sign == 1).all() and np.array_equal(np.unique(found), digests)


def test_a_folded_table_is_the_smaller_table():
    (digests,) = random_sets(random.Random(2), 1, 0, 100)
    large, small = fp.tables([digests], 64), fp.tables([digests], 8)
    assert all(np.array_equal(x, y[0]) for x, y in zip(fp.fold(tuple(c[0] for c in large), 8), small, strict=True))


def chars(s, a, n):
    return s[a : a + n]


def test_the_query_equals_brute_force(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), key=lambda r: r[0])
    out = {r.doc_id: r for r in QUERIES["op7_fingerprint"](spark, SF).collect()}
    assert len(out) == len(docs)
    for i, (d, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        sets = dict(zip("ten", map(set, (x.tolist() for x in fp.paragraph_digests([text, edited, after]))), strict=True))

        def like(x, y):
            total = len(x) + len(y)
            return 1 - len(x ^ y) / total if total else 1.0

        r = out[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(sets["t"], sets["e"])) and r.near_next == pytest.approx(like(sets["t"], sets["n"]))
        assert fp.likeness(r.fingerprint, r.edited_fingerprint) == pytest.approx(r.near_edited)
    assert len({(r.fingerprint) for r in out.values()}) > 1


@pytest.mark.parametrize("kind, ids", [("long", [5, -3, 900, 900, None, None, 2**40]), ("string", ["b", "a", "é", "é", None, None, ""])])
def test_the_next_text_in_many_ranges(spark, monkeypatch, kind, ids):
    rows = [(d, f"t{i}") for i, d in enumerate(ids)] + [(ids[0], None)]
    want = sorted(rows, key=lambda r: (r[0] is None, (r[0].encode() if kind == "string" else r[0]) if r[0] is not None else 0, r[1] is not None, r[1] or ""))
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    for size in (1, 3, 100):
        monkeypatch.setattr(fp, "RANGE_ROWS", size)
        got = sorted((str(r.doc_id), str(r.text), str(r.next_text)) for r in fp.with_next(df).collect())
        assert got == sorted((str(d), str(t), str(want[(i + 1) % len(want)][1])) for i, (d, t) in enumerate(want))
    assert fp.with_next(df.limit(0)).collect() == []
    assert [r.next_text for r in fp.with_next(df.limit(1)).collect()] == ["t0"]


def test_null_empty_repeated_and_clashing(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, " \n ", "z"), (4, "word " * 100_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, near string")
    out = fp.fingerprint_versions(df.withColumn("other", df.text), {"text": "print", "other": ""}, {"near": ("text", "other")}).collect()
    assert len(out) == 5 and {r.near for r in out} == {1.0}
    assert len({r["print"] for r in out if r.doc_id < 4}) == 1
