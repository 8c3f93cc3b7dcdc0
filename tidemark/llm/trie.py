"""The prefix trie of conversations, with subtree sums by centroid decomposition.

A node is a distinct sequence of first turns; it is named by its smallest member and its depth, as no two nodes of one depth share a member.
Turns are digests of role and text; a prefix is known by two 64-bit exclusive ors of hashes of (depth, turn) along it. Turns are placed over ranges of
(conversation, order), so that a conversation of any length spreads over tasks.

Subtree sums (leaves, saved tokens) come from a centroid decomposition of the forest of parent edges. A node weighs as many conversations as pass it,
so that the weight of a whole subtree is known from the rows: each member adds its turns from there on. Each round takes every component:
1. The nodes whose weight within the component is over half of it are the path from its top to its centroid, the deepest of them.
2. Removing the centroid splits the component: each child's subtree is one of its own (a node finds which by its name: its smallest member's
   prefix one turn below the centroid), what is left keeps the old top. No piece weighs more than half.
3. The total of the centroid and what hung from it is added to each node of the path, and its weight is taken from theirs.
Rounds are Spark jobs over all components that weigh more than `bound`; lighter ones are dealt by hash to tasks, which go on splitting them in the same way.
A component with a large part of all nodes gets its centroid by broadcast (`joined_by_key`), as there are few of those.

Null role or text: empty. Rows without a conversation id take no part. Turns of equal order are ordered by their digests, equal rows all stay. An empty table has no nodes, not even a root.
Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, written
from tidemark.llm.neardup import joined_by_key
from tidemark.llm.ordered import content, digested, laid_out, numbered, xored

BOUND = 8192  # components up to this weight are split within a task
FOREST = 100_000  # nodes that a task gets at once, about
CHUNK = 12  # bits: ids of a node's ends are joined in parts of 4096 numbers
SUMS = ("n_leaves", "saved_tokens")
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # fixed value


def turn_digests(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, content and bytes (of the text in UTF-8): what the trie needs of each turn."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    return conversations.select(F.col(f"`{key}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), content(role, text).alias("content"), F.octet_length(text).cast("long").alias("bytes"))


def spliced(turns: DataFrame, base, heads, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from others: the first `heads` turns of conversation `base` (both functions of the id), then the own turns after as many.

    Gives the turns (conv_id, part, turn, content, bytes), in the order of part and turn, and all ids. heads is at most `most`.
    """
    placed = numbered(laid_out(turns, "conv_id", ["turn", "content"]), "conv_id").select("conv_id", F.col("position").alias("turn"), "content", "bytes")
    ids = written(turns.filter(F.col("conv_id").isNotNull()).select("conv_id").distinct(), "ids")
    wanted = ids.select(F.col("conv_id").alias("to"), base(F.col("conv_id")).alias("conv_id"), heads(F.col("conv_id")).alias("heads"))
    first = placed.filter(F.col("turn") <= most).join(wanted, "conv_id").filter(F.col("turn") <= F.col("heads"))
    own = placed.filter(F.col("turn") > heads(F.col("conv_id")))
    return first.select(F.col("to").alias("conv_id"), F.lit(0).alias("part"), "turn", "content", "bytes").unionByName(own.withColumn("part", F.lit(1))), ids


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None, order: tuple[str, ...] = ("turn",), bound: int = BOUND) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    turns: conv_id, the columns of order, content and bytes. ids: all conversations, those without turns too.
    """
    ids = turns.select("conv_id").distinct() if ids is None else ids
    narrow = turns.select("conv_id", *order, "content", "bytes")
    laid = laid_out(narrow, "conv_id", [*order, "content"])
    hashes = {"a": F.xxhash64("depth", "content"), "b": F.xxhash64(F.lit("b"), "content", "depth")}
    placed = written(numbered(laid, "conv_id", "depth", "length").withColumns(hashes).select("conv_id", "depth", "length", "bytes", "a", "b", "_part", "_at"), "placed")
    walk = written(xored(placed, "conv_id", ["a", "b"]).drop("_part", "_at"), "walk")
    prefix = ["depth", "a", "b"]
    found = written(
        walk.groupBy(*prefix).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), F.max("bytes").alias("bytes")), "prefixes"
    )
    turnless = ids.select("conv_id").distinct().join(walk.filter("depth = 1").select("conv_id"), "conv_id", "left_anti")
    totals = found.agg(F.coalesce(F.sum("n_convs"), F.lit(0)).alias("rows")).first()
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.countDistinct("conv_id").alias("n_convs")).first()
    if root.conv_id is None:
        return ids.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    total = totals.rows + root.n_convs  # the weight of the whole trie
    own = walk.select("conv_id", "depth", "length", "a", "b")
    places = written(joined_by_key(own, found.withColumn("_n", F.col("n_convs")), prefix, "_n", totals.rows).drop("a", "b"), "places")
    above = places.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    steps = written(places.join(above, ["conv_id", "depth"], "left").withColumn("parent", F.when(F.col("depth") == 1, F.lit(root.conv_id)).otherwise(F.col("parent"))), "steps")
    top = ids.sparkSession.range(1).select(
        F.lit(root.conv_id).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(root.n_convs).cast("long").alias("n_convs"), F.lit(total).cast("long").alias("weight"), F.lit(0).cast("long").alias("bytes")
    )
    bare = steps.filter(F.col("conv_id") == F.col("node")).select("conv_id", "depth", "parent", "n_convs", "weight", "bytes").unionByName(top)
    children = bare.filter("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = bare.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = written(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}), "nodes")
    ends = steps.filter(F.col("depth") == F.col("length")).select("node", "depth", "conv_id").unionByName(turnless.select(F.lit(root.conv_id).alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    parts = ends.groupBy("node", "depth", F.shiftright("conv_id", CHUNK).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    hashes = digested(parts, ["node", "depth"], ["chunk"], "ids", ",").select(F.col("node").alias("conv_id"), "depth", F.col("sha256").alias("ends_sha256"))
    sums = subtree_sums(nodes.select("conv_id", "depth", "parent", "weight", *SUMS), steps.select("conv_id", "depth", "node", "parent"), SUMS, root.conv_id, total, bound)
    out = nodes.drop("weight", "bytes", *SUMS).join(sums, ["conv_id", "depth"]).join(hashes, ["conv_id", "depth"], "left")
    out = out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", *SUMS, F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    out = written(out, "trie")
    dropped(laid, placed, walk, found, places, steps, nodes)
    return out


def subtree_sums(nodes: DataFrame, steps: DataFrame, sums: tuple[str, ...], root: int, total: int, bound: int = BOUND) -> DataFrame:
    """conv_id, depth and the sums over each node's subtree.

    nodes: conv_id, depth, parent, weight (of the subtree) and the own values; steps: for each conversation and depth its node and that node's parent;
    root and total: the root's conv_id and weight.
    """
    label = ["top", "top_depth"]
    one = {"top": F.lit(root).cast("long"), "top_depth": F.lit(0).cast("long"), "whole": F.lit(total).cast("long")}
    state, whole, finished, old = nodes.withColumns(one), total, [], None
    while whole > bound:
        path = F.col("weight") * 2 > F.col("whole")
        deepest = state.filter((F.col("whole") > bound) & path).groupBy(*label, "whole").agg(F.max(F.struct("depth", "conv_id", "weight")).alias("c"))
        centroids = written(deepest.select(*label, F.col("whole").alias("_size"), F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "centroids")
        known = joined_by_key(state.filter(F.col("whole") > bound), centroids, label, "_size", total)
        below = known.filter(F.col("depth") > F.col("c_depth")).join(steps.select("conv_id", (F.col("depth") - 1).alias("c_depth"), "node", F.col("parent").alias("ancestor")), ["conv_id", "c_depth"])
        hangs = F.coalesce(F.col("ancestor") == F.col("c_conv"), F.lit(False))
        near = known.filter(F.col("depth") <= F.col("c_depth")).withColumn("node", F.lit(None).cast("long")).withColumn("hangs", F.lit(False))
        split = written(near.unionByName(below.withColumn("hangs", hangs).drop("ancestor")), "split")
        centre = (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
        sum_of = split.filter(F.col("hangs") | centre).groupBy(*label).agg(*[F.sum(c).alias(c) for c in sums])
        finished.append(written(split.filter(path & ~F.col("hangs")).select("conv_id", "depth", *label).join(sum_of, label).select("conv_id", "depth", *sums), "sums"))
        # a piece's new top is a child of the centroid, whose weight is the piece's
        heads = split.filter(F.col("hangs") & (F.col("conv_id") == F.col("node")) & (F.col("depth") == F.col("c_depth") + 1)).select(F.col("conv_id").alias("top"), F.col("depth").alias("top_depth"), F.col("weight").alias("whole"), F.col("weight").alias("_size"))
        hung = split.filter("hangs").select("conv_id", "depth", "parent", "weight", *sums, F.col("node").alias("top"), (F.col("c_depth") + 1).alias("top_depth"))
        rest = split.filter(~F.col("hangs") & ~centre).withColumn("weight", F.col("weight") - F.when(path, F.col("c_weight")).otherwise(0)).withColumn("whole", F.col("whole") - F.col("c_weight"))
        columns = ["conv_id", "depth", "parent", "weight", *sums, *label, "whole"]
        state = written(joined_by_key(hung, heads, label, "_size", total).select(columns).unionByName(rest.select(columns)).unionByName(state.filter(F.col("whole") <= bound).select(columns)), "components")
        dropped(centroids, split, *([old] if old is not None else []))
        old = state
        whole = state.agg(F.max("whole")).first()[0] or 0
    buckets = max(1, state.count() // FOREST)
    dealt = state.withColumn("bucket", F.pmod(F.xxhash64(*label), F.lit(buckets)))
    small = dealt.groupBy("bucket").applyInPandas(_forest(sums), ", ".join(f"{c} long" for c in ("conv_id", "depth", *sums)))
    for table in finished:
        small = small.unionByName(table)
    return small.groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in sums])


def _forest(sums: tuple[str, ...]):
    """The same decomposition of many small components at once."""

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows)
        names = pd.MultiIndex.from_arrays([rows["conv_id"], rows["depth"]])
        parent = names.get_indexer(pd.MultiIndex.from_arrays([rows["parent"].fillna(-1).astype("int64"), rows["depth"] - 1]))
        piece = rows.groupby(["top", "top_depth"]).ngroup().to_numpy()
        parent = np.where((parent >= 0) & (rows["parent"].notna().to_numpy()) & (piece[parent] == piece), parent, -1)
        weight, values = rows["weight"].to_numpy().copy(), rows[list(sums)].to_numpy()
        totals, left, at = np.zeros_like(values), np.ones(n, bool), np.arange(n)
        while left.any():
            top = np.where(parent >= 0, parent, at)
            while (up := top[top]).tolist() != top.tolist():
                top = up
            path = left & (2 * weight > weight[top])
            inner = np.zeros(n, bool)
            inner[parent[path & (parent >= 0)]] = True
            centre = path & ~inner
            of = np.full(n, -1)
            of[top[centre]] = at[centre]  # the centroid of each top
            head = left & (parent >= 0) & centre[np.maximum(parent, 0)]
            owner = np.where(head, parent, -1)  # which centroid a piece hung from, known at its head
            cut = np.where(head | (parent < 0), at, parent)
            while (up := cut[cut]).tolist() != cut.tolist():
                cut = up
            hung = owner[cut]
            sum_of = np.where(centre[:, None], values, 0)
            np.add.at(sum_of, hung[left & (hung >= 0)], values[left & (hung >= 0)])
            totals[path] += sum_of[of[top[path]]]
            on = path & ~centre
            weight[on] -= weight[of[top[on]]]
            left &= ~centre
            parent = np.where(head | ~left, -1, parent)
            weight[~left] = 0
        return pd.DataFrame({"conv_id": rows["conv_id"].to_numpy(), "depth": rows["depth"].to_numpy(), **{c: totals[:, i] for i, c in enumerate(sums)}})

    return split
