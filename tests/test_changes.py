"""Reasons of changes by hand and against a plain comparison."""

import random

from quern.operators import diff

SCHEMA = "k string, hash string, title string, description string, published string, images array<string>, words long"


def reasons(a, b):
    out = ["contentHashChanged"]
    if a[2] != b[2]:
        out.append("titleChanged")
    if {i for i in a[5] or [] if i is not None} != {i for i in b[5] or [] if i is not None}:
        out.append("imageSetChanged")
    if a[3] != b[3] or a[4] != b[4]:
        out.append("metadataChanged")
    old = a[6] or 0
    if old > 0 and abs((b[6] or 0) - old) / old > 0.1:
        out.append("structureChanged")
    return out


def changed(spark, before, after):
    got = diff.page_changes(spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA), "k").collect()
    return {r.k: r for r in got}


def test_each_reason_by_hand(spark):
    base = ("h", "t", "d", "p", ["a", "b", "a"], 10)
    later = {
        "same": base, "hash": ("x", *base[1:]), "title": ("x", "T", *base[2:]), "about": ("x", "t", None, *base[3:]), "day": ("x", "t", "d", "q", *base[4:]),
        "order": ("x", "t", "d", "p", ["b", "a", None], 10), "image": ("x", "t", "d", "p", ["b", "c", "d"], 10), "none": ("x", "t", "d", "p", None, 10),
        "tenth": (*("x", *base[1:5]), 11), "more": (*("x", *base[1:5]), 12), "less": (*("x", *base[1:5]), None), "null": (None, *base[1:]),
    }
    got = changed(spark, [(k, *base) for k in later] + [("gone", *base), (None, *base)], [(k, *v) for k, v in later.items()] + [("new", *base), (None, "x", *base[1:])])
    first = "contentHashChanged"
    assert {k: r.reasons for k, r in got.items()} == {
        "hash": [first], "title": [first, "titleChanged"], "about": [first, "metadataChanged"], "day": [first, "metadataChanged"], "order": [first], "image": [first, "imageSetChanged"],
        "none": [first, "imageSetChanged"], "tenth": [first], "more": [first, "structureChanged"], "less": [first, "structureChanged"], "null": [first],
    }
    assert (got["image"].images_added, got["image"].images_gone, got["none"].images_gone, got["less"].more_words) == (2, 1, 2, -10)


def test_nothing_grows_from_none(spark):
    a, b = ("k", "h", None, None, None, None, None), ("k", "x", None, None, None, [], 500)
    assert changed(spark, [a], [b])["k"].reasons == ["contentHashChanged"]
    assert changed(spark, [], [b]) == {} and changed(spark, [a], []) == {}


def test_same_as_plain_comparison(spark):
    rnd = random.Random(3)
    row = lambda k: (k, *(rnd.choice(["a", "b", None]) for _ in range(4)), rnd.choice([None, [rnd.choice("abc") for _ in range(rnd.randint(0, 3))]]), rnd.choice([None, 0, 9, 10, 11, 12]))
    before, after = ([row(f"k{i}") for i in range(300)] for _ in range(2))
    want = {a[0]: reasons(a, b) for a, b in zip(before, after, strict=True) if a[1] != b[1]}
    assert {k: r.reasons for k, r in changed(spark, before, after).items()} == want
