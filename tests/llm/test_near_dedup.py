import random

import pytest
from pyspark.sql import types as T

from quern.llm import common
from quern.llm.near_dedup import deduplicated, near_duplicates

SCHEMA = "doc_id long, text string"


def brute(rows, percent=75):
    """(n_shingles, component) by comparing all pairs."""

    def shingle_set(text):
        for c in "\t\n\x0b\x0c\r":
            text = (text or "").replace(c, " ")
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in text.split(" ") if w]
        if len(words) < 5:
            return {tuple(words)} if words else set()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, held in enumerate(sets):
        for x in held:
            holders.setdefault(x, []).append(i)
    for i in range(len(rows)):
        for j in {j for x in sets[i] for j in holders[x] if j < i}:  # all pairs that share a shingle
            same = len(sets[i] & sets[j])
            if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows)}


def got(spark, rows, **options):
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}


@pytest.mark.parametrize("block", [1 << 16, 300])
def test_groups_of_edited_copies_match_brute_force(spark, block):
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(6):
        base = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(rng.randrange(60, 140))]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            rows.append((n * 7 % 101 + 1000 * n, " ".join(words)))
            n += 1
    rows += [(5, "One two THREE"), (6, "one  two\tthree"), (7, "one two"), (8, None), (9, ""), (10, " \n ")]
    assert got(spark, rows, block=block) == brute(rows)


def test_a_long_chain_and_large_groups_of_copies(spark):
    words = [f"w{i}" for i in range(80)]
    rows = [(100 + i, " ".join(words[: 80 - i // 2] + [f"y{j}" for j in range(i // 2)])) for i in range(40)]
    rows += [(1000 + i, "the same text in each of these rows") for i in range(300)]
    assert got(spark, rows) == brute(rows)


def test_null_and_repeated_ids_and_an_empty_table(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "lonely"), (2, "z")]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in out) == [
        ("2", 1, "2", True), ("3", 2, "3", True), ("3", 2, "3", True), ("None", 1, "None", True), ("None", 2, "3", False),
    ]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    extra = T._parse_datatype_string("doc_id long, text string, node long, nd_n long, root string")
    assert near_duplicates(spark.createDataFrame([(1, "q", 2, 3, "r")], extra)).count() == 1


def test_one_row_of_a_group_stays_whatever_its_id(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [
        (3, near, "a"), (3, near, "b"), (2, near + " x", "c"), (2, "another text with the same id as a copy", "d"), (None, near, "e"), (None, "a lonely text without id", "f"),
        (7, None, "g"), (7, "", "h"), (8, " \n", "i"), (9, "same words in each of two rows", "j"), (9, "same words in each of two rows", "k"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA + ", found string")
    out = sorted((str(r.doc_id), r.text or "", r.found) for r in deduplicated(docs).collect())
    assert {o[2] for o in out if o[2] not in "jk"} == set("cdfghi")
    assert sum(o[2] in "jk" for o in out) == 1 and len(out) == 7
    assert deduplicated(docs.limit(0)).collect() == []


@pytest.mark.parametrize("keys", [1, 10**9])
def test_hot_groups_do_not_change_results(spark, monkeypatch, keys):
    monkeypatch.setattr(common, "HOT_KEYS", keys)
    rows = [(1000 + i, "the same text in each of these rows") for i in range(50)] + [(i, f"text number {i} of many") for i in range(20)]
    assert got(spark, rows) == brute(rows)


def test_a_very_long_text(spark):
    words = [f"v{i}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:100_000])), (3, " ".join(words[60_000:]))]
    assert got(spark, rows) == {1: (119_996, 1, True), 2: (99_996, 1, False), 3: (59_996, 3, True)}


def test_all_documents_of_a_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert out == want  # recall 1.0: no link is lost
    assert sum(not w[2] for w in want.values()) > 20
