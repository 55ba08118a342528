import hashlib
import random
from collections import defaultdict

import pytest
from helpers import SF, connect, same_rows
from pyspark.sql import functions as F

from quern.llm import queries
from quern.llm.prefix_trie import encoded_turns, prefix_trie
from quern.llm.queries import ORACLE, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(convs):
    """convs: id to list of (role, text). Rows as the operator's, by a dictionary of prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(m) == len(k) + 1 and m[:-1] == k for m in below)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        parent = min(members[key[:-1]]) if key else None
        out.append((min(own), len(key), parent, len(own), len(children), len(leaves), saved, sorted(ends.get(key, []))))
    return sorted(out, key=str)


def got(spark, convs, local_turns):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    turns = encoded_turns(spark.createDataFrame(rows, SCHEMA)).cache()
    lengths = spark.createDataFrame([(c, len(t)) for c, t in convs.items()], "conv long, length long")
    nodes, ends = prefix_trie(turns, lengths, local_turns=local_turns)
    held = defaultdict(list)
    for r in ends.collect():
        held[r.conv_id, r.depth].append(r.conv)
    out = sorted(((*tuple(r), sorted(held.pop((r.conv_id, r.depth), []))) for r in nodes.collect()), key=str)
    assert not held
    return out


def conversations(rng, n, kinds, longest):
    start = rng.randint(0, 50)
    return {start + i: [("user" if k % 2 else "assistant", "x" * rng.randint(0, kinds)) for k in range(rng.randint(0, longest))] for i in range(n)}


@pytest.mark.parametrize("local_turns", [0, 9, 4096])
def test_random_conversations_equal_brute_force_at_any_size_of_a_bucket(spark, local_turns):
    rng = random.Random(local_turns)
    convs = conversations(rng, 60, 2, 7)
    convs[9000] = [("user", "x")] + [("user", str(i)) for i in range(40)]
    convs[-5] = convs[9000][:3]
    assert got(spark, convs, local_turns) == brute(convs)


def test_one_opening_and_equal_conversations(spark):
    same = [("system", "be kind"), ("user", "hi"), ("assistant", "hello")]
    convs = {i: list(same) for i in range(200)} | {500 + i: [same[0], ("user", str(i))] for i in range(100)} | {900: []}
    for local_turns in (5, 4096):
        found = got(spark, convs, local_turns)
        assert found == brute(convs) and len(found) == 1 + 1 + 2 + 100


def test_turns_are_ordered_null_first_and_nulls_are_empty(spark):
    rows = [(1, 2, "b", "two"), (1, None, None, "zero"), (1, 1, "a", None), (2, None, "", "zero"), (None, 0, "a", "gone"), (3, 5, "b", "t"), (3, 5, "a", "t"), (3, 5, "a", "t")]
    turns = encoded_turns(spark.createDataFrame(rows, SCHEMA))
    found = {(r.conv, r["at"]): (r.turn_id, r.n_chars) for r in turns.collect()}
    assert sorted(found) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 2), (3, 3)]
    assert found[1, 1] == found[2, 1] and found[1, 1][1] == 4 and found[1, 2][1] == 0
    assert found[3, 1] == found[3, 2] != found[3, 3]
    clash = spark.createDataFrame([(1, 1, "a", "b", 7, 8)], SCHEMA + ", conv int, k1 int")
    assert encoded_turns(clash).count() == 1


def test_numbers_of_turns_do_not_depend_on_ranges(spark, monkeypatch):
    from quern.llm import prefix_trie as module

    rows = [(i % 3, 1000 - i, "r", str(i)) for i in range(600)]
    plain = {(r.conv, r["at"]): r.n_chars for r in encoded_turns(spark.createDataFrame(rows, SCHEMA)).collect()}
    monkeypatch.setattr(module, "ranged", lambda df, order: queries.ranged(df, order, 50))
    cut = {(r.conv, r["at"]): r.n_chars for r in encoded_turns(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert plain == cut and len(cut) == 600 and max(a for _, a in cut) == 200


def test_digests_of_ids_in_several_ranges(spark, monkeypatch):
    ranged = queries.ranged
    monkeypatch.setattr(queries, "ranged", lambda df, order: ranged(df, order, 40))
    rows = [(7, 2, 7 + i) for i in range(300)] + [(8, 1, 5000)]
    ends = spark.createDataFrame(rows, "conv_id long, depth long, conv long").orderBy(F.rand(1))
    found = {(r.e_conv, r.e_depth): r.digest for r in queries._ends_digest(ends).collect()}
    assert found == {(7, 2): hashlib.sha256(",".join(str(7 + i) for i in range(300)).encode()).hexdigest(), (8, 1): hashlib.sha256(b"5000").hexdigest()}


def test_no_conversations(spark):
    assert got(spark, {}, 5) == []
    assert got(spark, {4: [], 3: []}, 5) == brute({4: [], 3: []})


def test_the_query_equals_sql(spark):
    same_rows(QUERIES["op12_prefix_trie"](spark, SF), connect().execute(ORACLE["op12_prefix_trie"]))
