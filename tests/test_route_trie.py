import random

from quern.operators import layouts, route_trie

SCHEMA = "id long, path string, methods array<string>, api boolean"


def segments(path):
    return [(s, "wild" if s in ("*", "**") else "param" if s.startswith(":") else "literal") for s in path.split("/") if s]


def captures(wild, path):
    i = j = 0
    while i < len(wild) and j < len(path):
        raw, kind = wild[i]
        if raw == "**":
            return True
        if kind == "literal" and path[j][0] != raw:
            return False
        i, j = i + 1, j + 1
    return i == len(wild) and j == len(path)


def brute(prime, backend):
    out = {}
    for i, path, methods, api in prime:
        p = segments(path)
        out[i] = ("SAFE", None, None)
        for j, other, has, other_api in sorted(backend):
            b = segments(other)
            shared = [m for m in methods if m in has or m == "ANY" or "ANY" in has]
            only = len(methods) - len(shared)
            hit = None
            if path == other:
                if shared:
                    hit = ("BLOCK" if api or other_api else "RENAME" if only == len(methods) else "MERGE", "exact")
                elif only:
                    hit = ("MERGE", "exact")
            elif any(k == "wild" for _, k in p) and captures(p, b):
                hit = ("BLOCK", "wildcard")
            elif any(k == "wild" for _, k in b) and captures(b, p):
                hit = ("RENAME", "wildcard")
            elif len(p) == len(b) and all(x[1] != "literal" or y[1] != "literal" or x[0] == y[0] for x, y in zip(p, b)) and (shared or only):
                hit = ("BLOCK" if shared else "MERGE", "parameter")
            if hit:
                out[i] = (*hit, j)
                break
        else:
            under = [j for j, other, has, a in backend if a and api and other.startswith(path + "/") and any(m in has or m == "ANY" or "ANY" in has for m in methods)]
            if under:
                out[i] = ("RENAME", "api", min(under))
    return out


def routes(rng, n, start):
    pieces = ["a", "b", "c", ":id", ":slug", "*", "**", "d"]
    path = lambda: "/" + "/".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))
    return [(start + i, path(), rng.choice((["GET"], ["POST", "GET"], ["ANY"], ["DELETE"])), rng.random() < 0.3) for i in range(n)]


def got(spark, prime, backend):
    found = layouts.collisions(spark.createDataFrame(prime, SCHEMA), spark.createDataFrame(backend, SCHEMA))
    return {r.id: (r.resolution, r.kind, r.other) for r in found.collect()}


def test_random_routes_equal_the_nested_loop(spark):
    rng = random.Random(8)
    prime, backend = routes(rng, 150, 0), routes(rng, 60, 1000)
    want = brute(prime, backend)
    assert len({v[:2] for v in want.values()}) >= 6
    assert got(spark, prime, backend) == want
    assert got(spark, prime[:3], []) == dict.fromkeys((0, 1, 2), ("SAFE", None, None)) and got(spark, [], backend) == {}


def test_states_grow_with_the_routes_not_with_their_pairs(spark):
    def states(n):
        made = lambda first: [(i, f"/{first}{i % 7}/x{i}/:id", ["GET"], False) for i in range(n)] + [(n, "/**", ["GET"], False), (n + 1, "/:a/:b/:c", ["GET"], False)]
        p, b = (route_trie.classes(spark.createDataFrame(made("s"), SCHEMA), tag) for tag in ("p_", "b_"))
        met, deep = route_trie.walk(p, b, "p_", "b_")
        return met.count() + deep.count()

    few, many = states(100), states(400)
    assert many < 5 * few
