"""Bindings by shared words against the plain nested loop."""

import random

import pytest

from quern.operators import keywords

FAMILY = {w: f for f, ws in keywords.RESOURCE_WORDS.items() for w in ws}


def score(page, endpoint, families):
    points = 0
    for w in set(page):
        points += 10 * (w in endpoint)
        if families and w in FAMILY:
            points += 5 * any(FAMILY.get(o) == FAMILY[w] for o in endpoint)
    return points


def best(pages, endpoints, families=True):
    out = {}
    for p, words in pages:
        ranked = sorted((-score(words or [], set(ws or []), families), e) for e, ws in endpoints)
        if ranked and ranked[0][0] < 0:
            out[p] = (ranked[0][1], -ranked[0][0])
    return out


def tables(spark, pages, endpoints):
    return spark.createDataFrame(pages, "page long, words array<string>"), spark.createDataFrame(endpoints, "endpoint long, words array<string>")


@pytest.mark.parametrize("common", [0, 2, 8, 1000])
@pytest.mark.parametrize("families", [True, False])
def test_same_as_nested_loop_at_every_bound(spark, common, families):
    rnd = random.Random(7)
    vocabulary = ["api", "v1", "en", *(w for ws in keywords.RESOURCE_WORDS.values() for w in ws[:2]), *(f"w{i}" for i in range(40))]
    weights = [40, 20, 20, *[3] * 20, *[1] * 40]
    pick = lambda most: rnd.choices(vocabulary, weights, k=rnd.randint(0, most))
    pages = [(i, pick(7)) for i in range(150)] + [(900, None), (901, []), (902, ["nowhere"])]
    endpoints = [(i * 3 + 1, pick(5)) for i in range(90)] + [(1000, None), (0, ["nothing", "nothing"])]
    got = keywords.keyword_overlap(*tables(spark, pages, endpoints), families, common).collect()
    assert {r.page: (r.endpoint, r.score) for r in got} == best(pages, endpoints, families)
    assert len(got) == len({r.page for r in got})


def test_hot_word_makes_no_pairs(spark):
    """A word that all 3,000 pages and endpoints have meets once, as one set."""
    pages = spark.range(3000).selectExpr("id as page", "array('api', concat('k', id)) as words")
    endpoints = spark.range(3000).selectExpr("id as endpoint", "array('api', concat('k', id + 10)) as words")
    got = {r.page: (r.endpoint, r.score) for r in keywords.keyword_overlap(pages, endpoints).collect()}
    assert got == {p: (p - 10, 20) if p >= 10 else (0, 10) for p in range(3000)}


def test_nulls_repeats_and_empty_tables(spark):
    asking = spark.createDataFrame([(1, "a", 2), (1, "a", 3), (None, "a", 9), (2, None, 9)], "page long, key string, points long")
    offering = spark.createDataFrame([(5, "a", "x"), (5, "a", "y"), (4, "a", "z"), (None, "a", "z"), (3, None, "z")], "endpoint long, key string, page string")
    for common in (1, 100):
        assert [tuple(r) for r in keywords.best_overlap(asking, offering, common).collect()] == [(1, 4, 5)]
        assert keywords.best_overlap(asking.limit(0), offering, common).count() == 0
        assert keywords.best_overlap(asking, offering.limit(0), common).count() == 0


def test_bindings_by_hand(spark):
    pages = spark.createDataFrame(
        [
            (1, ["users"], False, False, False, False), (2, ["users"], True, True, True, True), (3, ["users"], False, True, True, True), (4, ["orders"], False, True, True, True),
            (5, ["orders"], False, True, False, True), (6, ["old"], False, False, False, False), (7, ["none"], True, True, True, True), (8, ["live"], None, None, None, None),
            (9, ["drop"], None, None, None, None), (10, ["odd"], None, True, None, None), (11, ["read"], False, False, False, False), (12, None, False, False, False, False),
        ],
        "page long, words array<string>, auth boolean, form boolean, search boolean, paged boolean",
    )
    endpoints = spark.createDataFrame(
        [
            (1, ["users"], ["GET", "POST"], None, False, True), (2, ["orders"], ["GET"], [], False, False), (3, ["old"], ["GET"], ["ws"], True, None), (4, ["live"], ["GET"], ["x", "sse"], None, False),
            (5, ["drop"], ["GET"], ["upload"], False, False), (6, ["odd"], ["DELETE"], None, False, False), (7, ["read"], ["HEAD"], None, False, False),
        ],
        "endpoint long, words array<string>, methods array<string>, tags array<string>, deprecated boolean, secured boolean",
    )
    models = spark.createDataFrame([(70, ["users", "old"]), (71, ["read"]), (72, None)], "model long, words array<string>")
    got = {r[0]: tuple(r)[1:] for r in keywords.bind_pages(pages, endpoints, models).collect()}
    assert got == {
        1: (1, 70, "mutation", "BOUND", 0.85, True), 2: (1, 70, "auth-gated", "BOUND", 0.85, False), 3: (1, 70, "form-submit", "BOUND", 0.85, True),
        4: (2, None, "search", "PARTIAL", 0.65, False), 5: (2, None, "paginated", "PARTIAL", 0.65, False), 6: (3, 70, "real-time", "BLOCKED", 0.9, False),
        7: (None, None, "static", "BOUND", 1.0, False), 8: (4, None, "real-time", "PARTIAL", 0.65, False), 9: (5, None, "file-upload", "PARTIAL", 0.65, False),
        10: (6, None, "mutation", "PARTIAL", 0.65, False), 11: (7, 71, "client-fetch", "BOUND", 0.85, False), 12: (None, None, "static", "BOUND", 1.0, False),
    }
    isr = {r.page: r.binding for r in keywords.bind_pages(pages, endpoints, models, mode="isr").collect()}
    assert isr[11] == "server-fetch"
