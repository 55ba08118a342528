import random

from quern.operators import validator

NODES = "site string, node string, parent string, depth int, url string, content boolean, route string, source string, layout string, layout_confidence double, category string, kind string, kind_confidence double"
ASSETS = "site string, checksum string, missing boolean, uses int, bound boolean"
CATEGORIES = "site string, category string, pages int"


def node(name, parent="top", depth=1, url=None, route="/r", layout="ArticleLayout", sure=0.9, category="c", kind="ARTICLE", known=0.9, content=True, source="url"):
    return ("s", name, parent, depth, url or f"http://s/{name}", content, f"/{name}" if route == "/r" else route, source, layout, sure, category, kind, known)


TOP = node("top", None, 0)


def codes(spark, nodes, assets=(), categories=()):
    m = validator.measures(spark.createDataFrame(list(nodes), NODES), spark.createDataFrame(list(assets), ASSETS), spark.createDataFrame(list(categories), CATEGORIES))
    return m, {r.code: r.n for r in validator.issues(m).collect()}


def test_a_sound_site_raises_nothing(spark):
    m, found = codes(spark, [TOP, *(node(f"n{i}") for i in range(8))], [("s", "a", False, 1, True)], [("s", "c", 9)])
    assert found == {}
    r = validator.report(m).first()
    assert (r.grade, r.errors, r.warnings, r.renderable, set(r.grades.values())) == ("PASS", 0, 0, True, {"PASS"}) and set(r.grades) == set(validator.SECTIONS)


def test_each_code_is_raised_once_by_a_site_made_for_it(spark):
    fine = [TOP, *(node(f"n{i}") for i in range(8))]
    nav = [node(f"d{i}", "top", 2) for i in range(2)]
    cases = {
        "ROUTE_COLLISIONS": (fine + [node("x", route="/n1"), node("y", route="/n1")], 2), "MISSING_ROUTES": (fine + [node("x", route=None)], 1), "UNSAFE_ROUTE_CHARS": (fine + [node("x", route="/Ü b")], 1),
        "FALLBACK_ROUTES": (fine + [node("x", source="node_id_fallback")], 1), "ELEVATED_ORPHAN_COUNT": (fine + nav + [node("z", "top", 3)], 3), "HIGH_ORPHAN_RATIO": ([TOP] + nav, 2),
        "BROKEN_PARENT_REFS": (fine + [node("x", "gone")], 1), "DUPLICATE_PATHS": (fine + [node("x", url="http://S/n1/")], 1), "EMPTY_PRIMARY_NAV": ([node(f"t{i}", None, 0) for i in range(6)], 6),
        "MISSING_LAYOUT_ASSIGNMENTS": (fine + [node("x", layout=None)], 1), "LOW_CONFIDENCE_LAYOUTS": (fine + [node("x", sure=0.4)], 1), "EXCESSIVE_MINIMAL_LAYOUTS": (fine[:7] + [node(f"m{i}", layout="MinimalLayout") for i in range(4)], 4),
        "HIGH_UNCATEGORIZED_RATIO": (fine[:3] + [node(f"u{i}", category=None) for i in range(4)], 4), "UNCLASSIFIED_NODES": (fine + [node("x", kind=None)], 1), "LOW_CLASSIFICATION_CONFIDENCE": (fine[:5] + [node(f"l{i}", known=0.1) for i in range(4)], 4),
    }
    for code, (nodes, n) in cases.items():
        assert codes(spark, nodes)[1] == {code: n}, code
    ok = [("s", f"k{i}", False, 1, True) for i in range(9)]
    for code, assets, n in (
        ("MISSING_ASSETS", ok + [("s", "x", True, 1, True)], 1), ("HIGH_MISSING_ASSET_RATIO", ok[:2] + [("s", "x", True, 1, True)], 1), ("DUPLICATE_ASSETS", ok + [("s", "k1", False, 1, True)], 1),
        ("ORPHAN_ASSETS", ok + [("s", "x", False, None, True)], 1), ("UNRESOLVED_BINDINGS", ok + [("s", None, False, 1, False)], 1),
    ):
        assert codes(spark, fine, assets)[1] == {code: n}, code
    assert codes(spark, fine, (), [("s", "c", 9), ("s", "e", 0)])[1] == {"EMPTY_CATEGORIES": 1}
    assert {r[2] for r in validator.RULES} == set(cases) | {"MISSING_ASSETS", "HIGH_MISSING_ASSET_RATIO", "DUPLICATE_ASSETS", "ORPHAN_ASSETS", "UNRESOLVED_BINDINGS", "EMPTY_CATEGORIES"}


def test_what_cannot_be_rendered(spark):
    m, _ = codes(spark, [TOP, node("x", layout=None)])
    assert (validator.report(m).first().grade, validator.report(m).first().renderable) == ("FAIL", False)
    m, _ = codes(spark, [node("x", "gone"), *(node(f"n{i}") for i in range(3)), TOP])
    assert (validator.report(m).first().grade, validator.report(m).first().renderable) == ("FAIL", True)
    m, _ = codes(spark, [node("x", None, 0, content=False)])
    assert validator.report(m).first().renderable is False


def test_cycles_of_random_parents(spark):
    rng = random.Random(3)
    parent = {f"n{i}": f"n{rng.randrange(60)}" if rng.random() < 0.97 else None for i in range(60)} | {"self": "self", "a": "b", "b": "a"} | {f"c{i}": f"c{i + 1}" for i in range(30)}
    want = set()
    for n in parent:
        seen, at = [], n
        while at is not None and at not in seen:
            seen.append(at)
            at = parent.get(at)
        if at is not None:
            want |= set(seen[seen.index(at) :])
    df = spark.createDataFrame([*parent.items(), (None, "n1")], "node string, parent string")
    assert {r.node for r in validator.cycles(df).collect()} == want and {"self", "a", "b"} <= want
    assert validator.cycles(df.limit(0)).collect() == []
