import random

from quern.operators import signals

FACTS = "site string, field string, text string, number double"


def holds(have, needs):
    def one(field, op, values):
        for word, number in have.get(field, []):
            if op in ("in", "out", "has"):
                ok = word is not None and {"in": word in values, "out": word not in values, "has": any(v in word for v in values)}[op]
            else:
                ok = number is not None and {">": number > values[0], ">=": number >= values[0], "<": number < values[0], "<=": number <= values[0]}[op]
            if ok:
                return True
        return False

    return bool(needs) and all(one(*n) for n in needs)


def random_facts(rng, rules):
    fields = {}
    for _, _, _, needs in rules:
        for field, op, values in needs:
            fields.setdefault((field, op in ("in", "out", "has")), []).extend(values)
    rows = []
    for s in range(60):
        for (field, is_text), values in fields.items():
            for _ in range(rng.choice((0, 1, 1, 2))):
                v = rng.choice(values)
                rows.append((f"s{s}", field, rng.choice((v, v, "other", "x" + v, None)), None) if is_text else (f"s{s}", field, None, rng.choice((v, v + 1.0, v - 0.5, None))))
    return rows


def sums(rows, rules):
    have = {}
    for s, f, w, n in rows:
        have.setdefault(s, {}).setdefault(f, []).append((w, float(n) if n is not None else None))
    out = {}
    for s, h in have.items():
        labels = {r[0]: [0.0, 0.0, []] for r in rules}
        for label, name, weight, needs in rules:
            labels[label][1] += weight
            if holds(h, needs):
                labels[label][0] += weight
                labels[label][2].append(name)
        out[s] = labels
    return out


def frame(spark, rows):
    return spark.createDataFrame([(s, f, w, float(n) if n is not None else None) for s, f, w, n in rows], FACTS)


def test_designs_equal_a_plain_sum(spark):
    rows = random_facts(random.Random(4), signals.DESIGN)
    got = {r.site: r for r in signals.design_profiles(frame(spark, rows + [(None, "layout.strategy", "magazine", None)])).collect()}
    want = sums(rows, signals.DESIGN)
    assert set(got) == set(want) and len({r.archetype for r in got.values()}) >= 4
    for s, labels in want.items():
        order = sorted(labels, key=lambda x: -labels[x][0])
        most, sure = max(labels[order[0]][0], 1), lambda x: int(labels[x][0] / most * 100 + 0.5) / 100  # noqa: B023
        r = got[s]
        assert (r.archetype, r.score, r.confidence, r.signals) == (order[0], labels[order[0]][0], sure(order[0]), labels[order[0]][2])
        assert [tuple(x) for x in r.others] == [(x, labels[x][0], sure(x)) for x in order[1:]]
        assert r.level == ("high" if r.confidence >= 0.72 else "medium" if r.confidence >= 0.45 else "low")


def test_kinds_of_sites_equal_a_plain_sum(spark):
    rows = random_facts(random.Random(6), signals.SITES)
    got = {r.site: r for r in signals.site_kinds(frame(spark, rows)).collect()}
    want = sums(rows, signals.SITES)
    assert set(got) == set(want) and len({r.kind for r in got.values()}) >= 4
    for s, labels in want.items():
        part = {k: v[0] / v[1] for k, v in labels.items()}
        order = sorted(labels, key=lambda x: -part[x])
        best, r = order[0], got[s]
        sure = lambda x: min(part[x] * (labels[x][0] / max(labels[x][1], 1)) * 1.5, 1.0)  # noqa: B023, E731
        assert (r.kind, r.design, r.layout, r.signals) == (best if part[best] > 0.1 else "unknown", *signals.STRATEGY[best], labels[best][2])
        assert abs(r.score - part[best]) < 1e-12 and abs(r.confidence - min(sure(best) + 0.15, 1.0)) < 1e-12
        assert [x.label for x in r.others] == [x for x in order[1:4] if part[x] > 0.1]


def test_a_callers_rules_and_sites_without_signs(spark):
    rules = (("a", "big", 2.0, (("n", ">=", (5,)),)), ("b", "small", 2.0, (("n", "<", (5,)), ("t", "in", ("x",)))), ("b", "none", 9.0, ()))
    rows = [("p", "n", None, 5), ("q", "n", None, 4), ("q", "t", "x", None), ("r", "zzz", None, None)]
    got = {r.site: (r.archetype, r.score, r.confidence, r.level, r.signals) for r in signals.design_profiles(frame(spark, rows), rules).collect()}
    assert got == {"p": ("a", 2.0, 1.0, "high", ["big"]), "q": ("b", 2.0, 1.0, "high", ["small"]), "r": ("a", 0.0, 0.0, "low", [])}
    kinds = {r.site: (r.kind, r.design, r.confidence) for r in signals.site_kinds(frame(spark, rows), rules, {"a": ("d", "l"), "b": ("e", "m")}).collect()}
    assert kinds == {"p": ("a", "d", 1.0), "q": ("b", "e", 1.5 * (2 / 11) ** 2 + 0.15), "r": ("unknown", "d", 0.15)}
    assert signals.design_profiles(frame(spark, []), rules).count() == 0


def test_tokens_of_pages(spark):
    rows = [
        ("s", '<NAV><nav class="a  b" style="x:1"><li class="a"><h1>', 4), ("s", '<nav><li/><div class="a">', 1), ("s", '<nav class="zero">', 0), ("t", "<nav><header >", 1), ("t", None, 4), ("u", "", 4), (None, "<nav>", 4),
    ]
    got = {(r.site, r.kind, r.token): (r.n, r.weight) for r in signals.page_signals(spark.createDataFrame(rows, "site string, html string, weight int")).collect()}
    assert got == {
        ("s", "tag", "nav"): (2, 8), ("s", "class", "a"): (3, 9), ("s", "class", "b"): (1, 4), ("s", "style", "x:1"): (1, 4), ("s", "tag", "li"): (2, 5), ("s", "tag", "h1"): (1, 4),
        ("t", "tag", "nav"): (1, 1), ("t", "tag", "header"): (1, 1),
    }
