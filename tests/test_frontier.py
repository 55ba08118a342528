import random
from collections import Counter, deque

import pytest

from quern.operators import frontier


def queue(seed, links, max_pages, max_depth):
    """As a queue in plain Python."""
    waiting, seen, visited, skipped = deque([(seed, 0)]), {seed}, [], Counter()
    while waiting:
        node, depth = waiting.popleft()
        visited.append((node, depth))
        for _, link, reason in sorted(links.get(node, [])):
            if depth + 1 > max_depth:
                skipped["depth"] += 1
            elif link in seen:
                skipped["duplicate"] += 1
            elif len(seen) >= max_pages:
                skipped["budget"] += 1
            elif reason:
                skipped[reason] += 1
            else:
                seen.add(link)
                waiting.append((link, depth + 1))
    return visited, skipped


def site(rng, n, fan):
    return {f"p{i}": [(k, f"p{rng.randrange(n)}", None) if rng.random() < 0.8 else (k, f"x{rng.randrange(5)}", rng.choice(("external", "path"))) for k in range(rng.randint(0, fan))] for i in range(n)}


def got(spark, seeds, links, **limits):
    rows = [(node, *x) for node, found in links.items() for x in found]
    visited, skipped = frontier.crawl(spark.createDataFrame(seeds, "crawl string, node string"), spark.createDataFrame(rows, "node string, place int, link string, reason string"), **limits)
    order, counts = {}, {}
    for r in visited.collect():
        order.setdefault(r.crawl, []).append((r.turn, r.node, r.depth))
    for r in skipped.collect():
        counts.setdefault(r.crawl, Counter())[r.reason] += r.n
    return {c: [(n, d) for _, n, d in sorted(v)] for c, v in order.items()}, counts


@pytest.mark.parametrize("max_pages,max_depth", [(200, 5), (37, 3), (1, 2), (1000, 0)])
def test_crawls_equal_a_queue(spark, max_pages, max_depth):
    rng = random.Random(max_pages)
    links = site(rng, 600, 8)
    seeds = [("a", "p1"), ("b", "p2"), ("lost", "gone")]
    order, counts = got(spark, seeds, links, max_pages=max_pages, max_depth=max_depth)
    for crawl, seed in seeds:
        visited, skipped = queue(seed, links, max_pages, max_depth)
        assert order[crawl] == visited and counts.get(crawl, Counter()) == skipped
    assert max_pages != 200 or len(order["a"]) == 200


def test_no_seeds_nulls_and_loops(spark):
    assert got(spark, [], {"p": [(1, "q", None)]}) == ({}, {})
    order, counts = got(spark, [("a", "p"), ("n", None)], {"p": [(1, "p", None), (2, None, None), (3, "q", None), (4, "q", None)], "q": [(1, "p", None)]})
    assert order == {"a": [("p", 0), ("q", 1)]} and counts == {"a": Counter(duplicate=3)}
