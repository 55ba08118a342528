import hashlib
import random
import zlib

import numpy as np
from helpers import SF, words_of

from quern.llm.queries import QUERIES
from quern.llm.runs import periodic_runs, runs_of

SCHEMA = "doc_id long, text string"


def brute(words, least):
    """Every stretch of every period, kept if no smaller period holds in it."""
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if length >= max(least, 2 * q) and not any(part[p:] == part[: length - p] for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def got(spark, rows, least=12):
    df = periodic_runs(spark.createDataFrame(rows, SCHEMA), min_length=least)
    return [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in df.collect()]


def test_random_words_equal_brute_force_at_any_point_of_change_to_smaller_parts():
    rng = random.Random(3)
    for _ in range(400):
        n, letters = rng.randint(0, 70), rng.randint(1, 4)
        words = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, n)
            words = [w if i < a else words[min(a + (i - a) % p, n - 1)] for i, w in enumerate(words)]
        for least in (2, 12):
            for shrink in (0.0, 0.7, 1.0):
                runs = runs_of(np.array([*words, 99], np.int64), least, shrink).tolist()
                assert sorted(map(tuple, runs), key=lambda r: (r[0], r[2])) == brute(words, least)


def test_texts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    texts += ["x " * 30, "a b c\t" * 4 + "a\n", "A a " * 7, "a b " * 12, "é ü " * 6 + "é"]
    rows = list(enumerate(texts))
    want = [(i, len(words_of(t)), brute(words_of(t), 12), collapsed(words_of(t), brute(words_of(t), 12))) for i, t in rows]
    assert sorted(got(spark, rows)) == want


def test_nulls_empty_texts_repeats_clashing_names_and_an_empty_table(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 12), (1, "a " * 12), (1, "a " * 11)]
    runs = [(0, 12, 1)]
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 12, runs, "a"), (1, 12, runs, "a"), (1, 11, [], " ".join("a" * 11))]
    assert sorted(got(spark, rows), key=str) == sorted(want, key=str)
    assert got(spark, []) == []
    clash = spark.createDataFrame([(7, "a " * 12, 5, "x")], SCHEMA + ", runs int, _text string")
    assert [tuple(r)[:2] for r in periodic_runs(clash).collect()] == [(7, 12)]


def test_a_very_long_text(spark):
    rng = random.Random(7)
    words = [str(rng.randrange(5000)) for _ in range(150_000)]
    a, p = 30_000, 17_000
    words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    (_, n, runs, text), = got(spark, [(1, " ".join(words))])
    assert n == 150_000 and (a, 120_000, p) in runs and len(text.split()) <= a + p


def test_the_query_equals_brute_force_on_a_table(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words, h = words_of(r.text), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1500 and h % 10:
            continue  # too slow by brute force
        runs = brute(words, 12)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        figures = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
        digests = ("".join("%d,%d,%d\n" % x for x in runs), collapsed(words, runs))
        want[r.doc_id] = (len(runs), *figures, *(hashlib.sha256(d.encode()).hexdigest() for d in digests))
    found = {r[0]: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(found) == 200 and len(want) > 100 and sum(w[0] > 0 for w in want.values()) > 10
    assert {k: found[k] for k in want} == want
