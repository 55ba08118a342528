"""A trie of conversations that begin alike: most-significant-digit radix partitioning of
dictionary-encoded turns, finished by multikey quicksort.

A digit is a turn. Each level takes the conversations of all buckets that are too large
for one task, deals them by (bucket, next turn) in one exchange, and so makes the nodes
of the next depth and their buckets. A bucket with few turns left is finished by one task
with multikey quicksort, whose recursion makes its nodes; a bucket that only one long
conversation goes on from is a chain, a node a turn. A node is named by its smallest
member and its depth. Figures of subtrees come back up level by level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import hash128, look_up, materialize
from quern.operators.ordered import ranged

#: Turns left in a bucket that one task finishes, at most.
LOCAL_TURNS = 4_096
#: Turns of the buckets that one task finishes one after another, about.
TASK_TURNS = 1 << 17

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def encoded_turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, at, turn_id, n_chars): the turns of each conversation numbered from 1 in order
    of turn, null first, and encoded by a dictionary of distinct (role, text).

    A null role or text is empty. Turns of one number are in order of their role, then of
    a hash of (role, text). Rows without a conversation belong to none and are left out.
    No conversation is ordered by one task: rows are cut into ranges of the whole order.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = hash128(role, text)
    slim = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), k1.alias("k1"), k2.alias("k2"),
        F.length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row"),
    )
    slim = materialize(slim, "turns")
    dictionary = slim.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).withColumn("turn_id", F.monotonically_increasing_id())
    known = look_up(slim, materialize(dictionary, "dictionary"), ["k1", "k2"], "n", F.col("row")).drop("found")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("k1"), F.col("row")]
    cut = ranged(known, order)
    per = cut.groupBy("conv", "_range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # Only what crosses the border of a range: a row a range at most.
    before = per.withColumn("before", F.sum("n").over(earlier)).filter("before > 0").select(F.col("conv").alias("b_conv"), F.col("_range").alias("b_range"), "before")
    inside = F.row_number().over(Window.partitionBy("_range", "conv").orderBy(*order[1:]))
    crossed = (F.col("conv") == F.col("b_conv")) & (F.col("_range") == F.col("b_range"))
    return cut.withColumn("inside", inside).join(F.broadcast(before), crossed, "left").select(
        "conv", (F.col("inside") + F.coalesce("before", F.lit(0))).cast("long").alias("at"), "turn_id", "n_chars"
    )


class _Bucket:
    """The conversations that go on from one node, and the nodes behind it."""

    def __init__(self, top: int, depth: int, convs: np.ndarray, turns: list[list[int]], chars: list[list[int]]):
        self.top, self.depth, self.convs, self.turns, self.chars = top, depth, convs.tolist(), turns, chars
        #: conv_id, depth, parent's place (-1: the top), n_convs, children, leaves, saved, ends
        self.nodes: list[list] = []
        self._sort()

    def _node(self, members: list[int], k: int, parent: int) -> int:
        least = min(self.convs[m] for m in members)
        self.nodes.append([least, self.depth + k, parent, len(members), 0, 0, (len(members) - 1) * self.chars[members[0]][k - 1], []])
        return len(self.nodes) - 1

    def _sort(self) -> None:
        """Multikey quicksort: parts below, at and above a pivot turn at place k; the part at
        it is a node, and goes on at place k + 1."""
        todo = [(list(range(len(self.convs))), 0, -1)]
        while todo:
            members, k, parent = todo.pop()
            pivot = self.turns[members[len(members) // 2]][k]
            below = [m for m in members if self.turns[m][k] < pivot]
            above = [m for m in members if self.turns[m][k] > pivot]
            todo += [(part, k, parent) for part in (below, above) if part]
            at = [m for m in members if self.turns[m][k] == pivot]
            node = self._node(at, k + 1, parent)
            going = [m for m in at if len(self.turns[m]) > k + 1]
            self.nodes[node][7] = [self.convs[m] for m in at if len(self.turns[m]) == k + 1]
            if going:
                todo.append((going, k + 1, node))

    def rows(self) -> list[tuple]:
        for node in reversed(self.nodes):  # parents come before children
            node[5] = node[5] or 1
            if node[2] >= 0:
                up = self.nodes[node[2]]
                up[4], up[5], up[6] = up[4] + 1, up[5] + node[5], up[6] + node[6]
        return [(n[0], n[1], self.top if n[2] < 0 else self.nodes[n[2]][0], *n[3:7], n[2] < 0, n[7]) for n in self.nodes]


_LOCAL = pa.schema([(n.split()[0], pa.int64()) for n in _NODE.split(", ")] + [("under_top", pa.bool_()), ("ends", pa.list_(pa.int64()))])


def _finish(table: pa.Table) -> pa.Table:
    """Whole buckets (top, depth), each of LOCAL_TURNS rows at most."""
    order = np.lexsort([table[c].to_numpy() for c in ("at", "conv", "depth", "top")])
    top, depth, conv, turn, chars = (table[c].to_numpy()[order] for c in ("top", "depth", "conv", "turn_id", "n_chars"))
    bucket = np.flatnonzero((np.diff(top, prepend=top[:1] - 1) != 0) | (np.diff(depth, prepend=depth[:1]) != 0))
    rows = []
    for a, z in zip(bucket, [*bucket[1:], len(top)]):
        starts = a + np.flatnonzero(np.diff(conv[a:z], prepend=conv[a] - 1))
        cuts = list(zip(starts, [*starts[1:], z]))
        rows += _Bucket(int(top[a]), int(depth[a]), conv[starts], [turn[i:j].tolist() for i, j in cuts], [chars[i:j].tolist() for i, j in cuts]).rows()
    columns = list(zip(*rows)) or [[] for _ in _LOCAL]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _LOCAL)], schema=_LOCAL)


def prefix_trie(turns: DataFrame, convs: DataFrame, *, local_turns: int = LOCAL_TURNS) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the trie of conversations: turns has (conv, at, turn_id, n_chars), at
    from 1 without a gap, and convs (conv, length) for each conversation, turnless ones too.

    nodes: conv_id, the smallest member, and depth, which name a node; parent_conv_id, null for
    the root; n_convs, its members; n_children; n_leaves, childless nodes in its subtree;
    saved_tokens, summed over its subtree, (n_convs - 1) times the characters of a node's
    last turn. ends: (conv_id, depth, conv), the node where each conversation ends.

    A level costs a read of ``turns``; there are as many as the depth to which more than
    ``local_turns`` turns stay together. Equal conversations share all nodes; no node,
    conversation or shared opening is gathered in one task unless it is that small. No
    conversations give no nodes, not even a root. Negative ids are ids; nulls must be gone.
    """
    first = materialize(convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0"), "root")
    levels = [first.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("n_chars"))]
    root = F.broadcast(first.select(F.col("conv_id").alias("top")))  # one row
    ends = [convs.filter("length = 0").crossJoin(root).select(F.col("top").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "conv")]
    active = convs.filter("length > 0").crossJoin(root).select("conv", "top", "length")
    local, chains, depth = [], [], 0
    while not active.isEmpty():
        depth += 1
        step = turns.filter(F.col("at") == depth).join(active, "conv").select("conv", "top", "length", "turn_id", "n_chars")
        step = materialize(step, "step")
        rest = F.col("length") - depth
        made = step.groupBy("top", "turn_id").agg(
            F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("n_chars").alias("n_chars"), F.sum(rest).alias("rest"), F.count_if(rest > 0).alias("going")
        )
        made = materialize(made, "level")
        levels.append(made.select("conv_id", F.lit(depth).cast("long").alias("depth"), F.col("top").alias("parent_conv_id"), "n_convs", "n_chars"))
        small = F.col("rest") <= local_turns
        kind = F.when(small, "local").when(F.col("going") == 1, "chain").otherwise("active")
        known = made.select("top", "turn_id", "n_convs", "conv_id", kind.alias("kind"))
        dealt = look_up(step, known, ["top", "turn_id"], "n_convs", F.col("conv"))
        dealt = materialize(dealt.select("conv", F.col("conv_id").alias("top"), "length", "kind"), "dealt")
        at = F.lit(depth).cast("long").alias("depth")
        ends.append(dealt.filter(F.col("length") == depth).select(F.col("top").alias("conv_id"), at, "conv"))
        going = dealt.filter(F.col("length") > depth)
        local.append(going.filter("kind = 'local'").select("conv", "top", at))
        chains.append(going.filter("kind = 'chain'").select("conv", "top", "length", at))
        active = going.filter("kind = 'active'").drop("kind")

    done = _local_nodes(turns, local, depth + local_turns) + _chain_nodes(turns, chains)
    nodes = [n for n, _ in done]
    below = None
    for level, made in reversed(list(enumerate(levels))):
        heads = [n.filter("under_top") for n in nodes] + ([below] if below is not None else [])
        below = materialize(_summed(made, [h.filter(F.col("depth") == level + 1) for h in heads]), "summed")
        done.append((below, ends[level]))
    columns = [c.split()[0] for c in _NODE.split(", ")]
    all_nodes, all_ends = done[0][0].select(columns), done[0][1]
    for n, e in done[1:]:
        all_nodes, all_ends = all_nodes.unionByName(n.select(columns)), all_ends.unionByName(e)
    return all_nodes, all_ends


def _local_nodes(turns: DataFrame, local: list[DataFrame], farthest: int) -> list[tuple[DataFrame, DataFrame]]:
    if not local:
        return []
    buckets = local[0]
    for more in local[1:]:
        buckets = buckets.unionByName(more)
    # Of a conversation that is too long to be here no more than its beginning is dealt.
    rows = turns.filter(F.col("at") <= farthest).join(buckets, "conv").filter("at > depth")
    rows = materialize(rows.select("top", "depth", "conv", "at", "turn_id", "n_chars"), "local")
    tasks = max(1, -(-rows.count() // TASK_TURNS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = F.pmod(F.xxhash64("top", "depth"), F.lit(tasks))
    schema = _NODE + ", under_top boolean, ends array<long>"
    made = materialize(rows.groupBy(spread.alias("task")).applyInArrow(_finish, schema), "nodes")
    return [(made.drop("ends"), made.select("conv_id", "depth", F.explode("ends").alias("conv")))]


def _chain_nodes(turns: DataFrame, chains: list[DataFrame]) -> list[tuple[DataFrame, DataFrame]]:
    """A conversation that goes on alone: a node a turn, whatever its length."""
    known = None
    for more in chains:
        known = more if known is None else known.unionByName(more)
    if known is None or known.isEmpty():
        return []
    known = materialize(known.withColumn("n", F.col("length")), "chains")
    found = look_up(turns, known, ["conv"], "n", F.col("at")).filter("found and at > depth")
    last, head = F.col("at") == F.col("length"), F.col("at") == F.col("depth") + 1
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    made = found.select(
        F.col("conv").alias("conv_id"), F.col("at").alias("depth"), F.when(head, F.col("top")).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), head.alias("under_top"),
    )
    return [(materialize(made, "chain"), known.select(F.col("conv").alias("conv_id"), F.col("length").alias("depth"), "conv"))]


def _summed(made: DataFrame, heads: list[DataFrame]) -> DataFrame:
    """Nodes of a level with the figures of their subtrees, from their children's."""
    plain = ["parent_conv_id", "n_leaves", "saved_tokens"]
    own = (F.col("n_convs") - 1) * F.col("n_chars")
    children = None
    for h in heads:
        children = h.select(plain) if children is None else children.unionByName(h.select(plain))
    if children is None:
        return made.withColumns({"n_children": F.lit(0).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": own})
    per = children.groupBy(F.col("parent_conv_id").alias("p")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    return made.join(per, F.col("conv_id") == F.col("p"), "left").select(
        *made.columns, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (own + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"),
    )
