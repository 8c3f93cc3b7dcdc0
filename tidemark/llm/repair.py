"""Conversation structure repair: the cheapest edits that turn a conversation into `(s?(ua)+)?`, by a cost DP and prefix-doubling path ranking.

Rows stand in the order of turn (nulls first), then of the digest of role and text. A row's first fault counts: blank (only white space), duplicate (role and text seen earlier in the
conversation), truncated (the last character that isn't white space ends no sentence). Edits of a row: keep (K, 0), rerole to user or assistant (R, 1), delete (D, 2; a must for blank and duplicate rows);
an empty user or assistant turn can be inserted anywhere (I, 5). A truncated row that stays costs 5 more.

A node is a place between two rows and the state there: nothing yet, after system, after user, after assistant. The DP gives each node the least cost to the end; an arc is optimal if it keeps to that. Of the
optimal paths the one with the least audit (initials of its edits) is taken: nodes are ranked by the first 1, 2, 4, ... initials of their least audits, each round from the ranks of a node and of the
node that its doubled pointer leads to; among a node's optimal arcs that with the least initial, then with the least rank behind it, is the pointer of one step. The rounds end when all pointers
have reached an end; the path is read off the doubled pointers.

Rows are cut into blocks of `block` places within a conversation, and blocks are dealt to tasks by hash, so that a conversation of any length spreads over tasks. All blocks of a task move in step, as arrays. Where a conversation has
several blocks, each block first gives its least costs between the states at its ends, whose products from the right are the costs that the block before continues with; then the states at its end for each state at its start,
which composed from the left say where each block begins. Two optimal arcs of a node never share an initial (the initial and the row fix the state behind), so that ranks of different blocks never have to be compared.

Null role, text or turn: one space in role and text, first in the order. Rows without a conversation id take no part. Equal rows are copies of their own. Empty tables give an empty result. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, written
from tidemark.llm.neardup import joined_by_key
from tidemark.llm.ordered import content, digested, laid_out, numbered

BLOCK = 4096  # places of a conversation that one task ranks together
ROWS = 50_000  # rows that a task gets at once, about
WHITE = " \t\n\x0b\x0c\r"
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # fixed value
NONE, SYSTEM, USER, ASSISTANT = range(4)
RANKED = "DIKR"  # initials in ASCII order
FAR = 1 << 40
EDITS = "conv_id long, position long, inserted string, edit string, initial string, cost long"


def faults(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """A table of (conv_id, turn, role, text) with position (from 0), block, fault (or null) and initial of the role. copy, if it is a column, orders equal rows."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    known = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), *[c for c in ("place", "copy") if c in rows.columns])
    order = ["turn", "place", *(["copy"] if "copy" in rows.columns else [])]
    if "place" not in rows.columns:
        known = known.withColumn("place", content(F.col("role"), F.col("text")))
    laid = laid_out(known.withColumn("said", content(F.col("role"), F.col("text"))), "conv_id", order)
    placed = written(numbered(laid, "conv_id").withColumn("position", F.col("position") - 1).drop("_part", "_at", "size", "place", "copy"), "placed")
    first = written(placed.groupBy("conv_id", "said").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "first")
    again = joined_by_key(placed.select("conv_id", "said", "position"), first, ["conv_id", "said"], "n", placed.count()).filter("position > first").select("conv_id", "position", F.lit(True).alias("again"))
    stripped = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(stripped == "", "blank").when(F.col("again"), "duplicate").when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "truncated")
    found = placed.join(again, ["conv_id", "position"], "left").select("conv_id", "position", "turn", "role", "text", F.floor(F.col("position") / size).alias("block"), fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))
    out = written(found, "faults")
    dropped(laid, placed, first)
    return out


def illegal_pairs(found: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, 1) for each pair of neighbours whose initials aren't su, ua or au."""
    narrow = found.select("conv_id", "block", "position", "initial")
    inside = narrow.withColumn("before", F.lag("initial").over(Window.partitionBy("conv_id", "block").orderBy("position")))
    ends = narrow.filter(F.col("position") % size == size - 1).select("conv_id", (F.col("block") + 1).alias("block"), F.col("initial").alias("before"))
    across = narrow.filter((F.col("block") > 0) & (F.col("position") % size == 0)).join(ends, ["conv_id", "block"])
    pairs = inside.filter(F.col("before").isNotNull()).select("conv_id", "before", "initial").unionByName(across.select("conv_id", "before", "initial"))
    return pairs.filter(~F.concat("before", "initial").isin("su", "ua", "au")).select("conv_id", F.lit(1).cast("long").alias("illegal"))


class Blocks:
    """Rows of many blocks of conversations, sorted, and the arcs between their nodes."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows.sort_values(["conv_id", "position"], kind="stable").reset_index(drop=True)
        keys = self.rows[["conv_id", "block"]].to_numpy()
        self.start = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1]).astype(np.int64)
        self.length = np.diff(np.append(self.start, len(self.rows)))
        self.first = self.start + np.arange(len(self.start))  # each block's first place; it has one more than rows
        self.last = self.first + self.length
        self.keys = keys[self.start]
        self.initial = np.select([self.rows["initial"] == c for c in "sua"], [SYSTEM, USER, ASSISTANT], NONE)
        self.more = np.where(self.rows["fault"] == "truncated", 5, 0)
        self.gone = self.rows["fault"].isin(["blank", "duplicate"]).to_numpy()

    def _row(self, at: np.ndarray, after: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Cost and state behind, by edit, of the rows `at` from each state, if so much lies behind."""
        line, kept, more = np.arange(len(at)), self.initial[at], np.where(self.gone[at], FAR, self.more[at])
        target = np.array([USER, USER, ASSISTANT, USER])
        rerole = 1 + more[:, None] + after[:, target]
        fits = np.stack([(kept == SYSTEM) | (kept == USER), kept == USER, kept == ASSISTANT, kept == USER], axis=1)
        keep = np.where(fits, (more + after[line, kept])[:, None], FAR)
        return {"D": (2 + after, np.broadcast_to(np.arange(4), after.shape)), "K": (keep, np.broadcast_to(kept[:, None], after.shape)), "R": (rerole, np.broadcast_to(target, after.shape))}

    @staticmethod
    def _inserted(cost: np.ndarray) -> np.ndarray:
        """The costs with turns inserted at the place."""
        none, system, user, assistant = cost.T
        then = np.minimum(user, 5 + assistant)
        return np.stack([np.minimum(none, 5 + then), np.minimum(system, 5 + then), then, np.minimum(assistant, 5 + user)], axis=1)

    def costs(self, behind: np.ndarray) -> np.ndarray:
        """The least cost to the end of every node (place, state), by what lies behind each block's last place."""
        cost = np.full((len(self.rows) + len(self.start), 4), FAR, np.int64)
        cost[self.last] = behind
        for step in range(1, int(self.length.max(initial=0)) + 1):
            live = np.flatnonzero(self.length >= step)
            at = self.start[live] + self.length[live] - step
            cost[self.last[live] - step] = self._inserted(np.minimum.reduce([c for c, _ in self._row(at, cost[self.last[live] - step + 1]).values()]))
        return np.minimum(cost, FAR)

    def arcs(self, cost: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """label and target of each node's optimal arcs, by initial (0 to 3 for DIKR; target -1: none). At the last place only blocks that close a conversation insert."""
        n = len(cost)
        target = np.full((n * 4, 4), -1, np.int64)
        place = np.arange(len(self.rows)) + np.repeat(np.arange(len(self.start)), self.length)
        for name, (price, state) in self._row(np.arange(len(self.rows)), cost[place + 1]).items():
            at, s = np.nonzero((price == cost[place]) & (price < FAR))
            target[place[at] * 4 + s, RANKED.index(name)] = (place[at] + 1) * 4 + state[at, s]
        inner = np.ones(n, bool)
        inner[self.last[~closes]] = False
        for s, t in ((NONE, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            at = np.flatnonzero(inner & (cost[:, s] == 5 + cost[:, t]) & (cost[:, t] < FAR))
            target[at * 4 + s, RANKED.index("I")] = at * 4 + t
        return target


def least_paths(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """label (-1: an end) and next node of each node's least path, and its doubled pointers: to the node after 1, 2, 4, ... steps.

    target[node, label]: the node behind an optimal arc, -1: none.
    """
    nodes = np.arange(len(target))
    ends = (target < 0).all(1)
    rank = np.where(ends, 0, 1 + (target >= 0).argmax(1))
    pointers = []
    while True:
        behind = np.where(target >= 0, rank[np.maximum(target, 0)], 0)
        worth = np.where(target >= 0, np.arange(target.shape[1]) * (rank.max() + 1) + behind, np.iinfo(np.int64).max)
        label = np.where(ends, -1, worth.argmin(1))
        step = np.where(ends, nodes, target[nodes, label])
        if not pointers:
            pointers.append(step)
        jump = pointers[-1]
        if ends[jump].all():
            return label, step, pointers
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
        pointers.append(jump[jump])


def _closed() -> np.ndarray:
    """Costs behind the last place of a conversation, with turns inserted there."""
    return Blocks._inserted(np.array([[0, FAR, FAR, 0]]))[0]


def _products(rows: pd.DataFrame) -> pd.DataFrame:
    blocks, found = Blocks(rows), []
    for s in range(4):
        end = np.full((len(blocks.start), 4), FAR)
        end[:, s] = 0
        found.append(blocks.costs(end)[blocks.first])
    costs = np.stack(found, axis=2).reshape(len(blocks.start), 16)
    return pd.DataFrame({"conv_id": blocks.keys[:, 0], "block": blocks.keys[:, 1], "costs": list(costs)})


def _suffixes(rows: pd.DataFrame) -> pd.DataFrame:
    """What lies behind each block of one conversation: a row for each block."""
    rows = rows.sort_values("block", ascending=False)
    behind, out = _closed(), []
    for i, costs in enumerate(rows["costs"]):
        out.append(behind)
        behind = np.minimum((np.reshape(costs, (4, 4)) + behind).min(1), FAR)
    return pd.DataFrame({"conv_id": rows["conv_id"], "block": rows["block"], "behind": out, "closes": np.arange(len(rows)) == 0})


def _ends(rows: pd.DataFrame) -> tuple[Blocks, np.ndarray, np.ndarray]:
    blocks = Blocks(rows)
    of = blocks.rows.iloc[blocks.start]
    return blocks, np.stack(of["behind"].to_numpy()).astype(np.int64), of["closes"].to_numpy(bool)


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    blocks, behind, closes = _ends(rows)
    _, _, pointers = least_paths(blocks.arcs(blocks.costs(behind), closes))
    exits = pointers[-1][blocks.first[:, None] * 4 + np.arange(4)] % 4
    return pd.DataFrame({"conv_id": blocks.keys[:, 0], "block": blocks.keys[:, 1], "exits": list(exits)})


def _entries(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("block")
    state, out = NONE, []
    for exits in rows["exits"]:
        out.append(state)
        state = exits[state]
    return pd.DataFrame({"conv_id": rows["conv_id"], "block": rows["block"], "entry": out})


def _edited(rows: pd.DataFrame) -> pd.DataFrame:
    """The edits of each row; what is inserted behind the last row is a row of its own."""
    blocks, behind, closes = _ends(rows)
    target = blocks.arcs(blocks.costs(behind), closes)
    label, _, pointers = least_paths(target)
    node = blocks.first * 4 + blocks.rows["entry"].to_numpy(np.int64)[blocks.start]
    # the nodes of every path: from each known one, those after 2^k steps
    owner, nodes = np.arange(len(node)), node
    for jump in reversed(pointers):
        far = jump[nodes]
        owner, nodes = np.concatenate([owner, owner]), np.concatenate([nodes, far])
        nodes, at = np.unique(nodes, return_index=True)
        owner = owner[at]
    nodes = nodes[label[nodes] >= 0]
    place, state, edit = nodes // 4, nodes % 4, label[nodes]
    to = target[nodes, edit] % 4
    letters = np.array(["", "s", "u", "a"])
    inserted = np.full(len(label) // 4, "", object)
    insert = edit == RANKED.index("I")
    # at most two turns are inserted at a place, the user's first where both are
    for p, t, s in sorted(zip(place[insert], to[insert], state[insert]), key=lambda x: (x[0], x[2] == USER and x[1] == ASSISTANT)):
        inserted[p] += letters[t]
    own = np.arange(len(blocks.rows)) + np.repeat(np.arange(len(blocks.start)), blocks.length)
    by_place = np.full(len(inserted), -1)
    by_place[place[~insert]] = np.flatnonzero(~insert)
    of = by_place[own]
    names = np.array(list(RANKED))[edit[of]]
    price = np.select([names == "K", names == "R", names == "D"], [blocks.more, 1 + blocks.more, 2]) + 5 * np.array([len(x) for x in inserted[own]], int)
    out = pd.DataFrame({"conv_id": blocks.rows["conv_id"], "position": blocks.rows["position"], "inserted": inserted[own], "edit": names, "initial": letters[to[of]], "cost": price})
    tail = np.flatnonzero(inserted[blocks.last] != "")
    extra = inserted[blocks.last[tail]]
    behind_last = blocks.rows["position"].to_numpy()[blocks.start[tail] + blocks.length[tail] - 1] + 1
    return pd.concat([out, pd.DataFrame({"conv_id": blocks.keys[tail, 0], "position": behind_last, "inserted": extra, "edit": "", "initial": "", "cost": [5 * len(x) for x in extra]})])


def edits(found: DataFrame) -> DataFrame:
    """A row for each row of `faults`: inserted (initials of turns put before it), edit (D, K or R), initial (of its role afterwards, R and K) and cost; inserts behind the last row stand at a position of their own, with edit empty."""
    narrow = found.select("conv_id", "block", "position", "fault", "initial")
    several = written(narrow.filter("block > 0").select("conv_id").distinct(), "long")
    many = narrow.join(several, "conv_id", "left_semi")
    chunks = max(1, found.count() // ROWS)

    def dealt(rows: DataFrame):
        return rows.withColumn("chunk", F.pmod(F.xxhash64("conv_id", "block"), F.lit(chunks))).groupBy("chunk")

    products = dealt(many).applyInPandas(_products, "conv_id long, block long, costs array<long>")
    behind = written(products.groupBy("conv_id").applyInPandas(_suffixes, "conv_id long, block long, behind array<long>, closes boolean"), "behind")
    continued = many.join(behind, ["conv_id", "block"])
    exits = dealt(continued).applyInPandas(_exits, "conv_id long, block long, exits array<int>")
    entries = written(exits.groupBy("conv_id").applyInPandas(_entries, "conv_id long, block long, entry int").join(behind, ["conv_id", "block"]), "entries")
    single = narrow.join(several, "conv_id", "left_anti").withColumns({"behind": F.array(*[F.lit(int(c)).cast("long") for c in _closed()]), "closes": F.lit(True), "entry": F.lit(NONE)})
    ready = many.join(entries, ["conv_id", "block"]).select(single.columns).unionByName(single)
    out = written(dealt(ready).applyInPandas(_edited, EDITS), "edits")
    dropped(several, behind, entries)
    return out


def repaired(found: DataFrame, edited: DataFrame) -> DataFrame:
    """conv_id, position and turns: for each row the inserted turns and its own, if it stays, as (role, text)."""
    name = lambda c: F.when(c == "u", "user").when(c == "a", "assistant")
    inserted = F.transform(F.filter(F.split("inserted", ""), lambda c: c != ""), lambda c: F.struct(name(c).alias("role"), F.lit("").alias("text")))
    role = F.when(F.col("edit") == "R", name(F.col("new"))).otherwise(F.col("role"))
    own = F.when(F.col("edit").isin("K", "R"), F.array(F.struct(role.alias("role"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    joined = edited.withColumnRenamed("initial", "new").join(found.select("conv_id", "position", "role", "text"), ["conv_id", "position"], "left")
    return joined.select("conv_id", "position", F.concat(inserted, own).alias("turns"))


def report(rows: DataFrame, ids: DataFrame, size: int = BLOCK) -> DataFrame:
    """A row for each of the ids: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    found = faults(rows, size)
    edited = edits(found)
    zero = F.lit(0).cast("long")
    count = lambda kind: F.sum(F.when(F.col("fault") == kind, 1).otherwise(0)).alias(kind)
    turns = found.filter(F.col("turn").isNotNull()).select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    counts = found.groupBy("conv_id").agg(*[count(kind) for kind in ("blank", "duplicate", "truncated")])
    illegal = illegal_pairs(found, size).groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    pieces = edited.withColumn("piece", F.concat(F.regexp_replace("inserted", ".", "I"), F.col("edit"))).groupBy("conv_id", F.floor(F.col("position") / size).alias("block"))
    part = pieces.agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "piece"))), lambda p: p["piece"]), "").alias("audit"))
    audits = part.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    lines = repaired(found, edited).filter(F.size("turns") > 0).select("conv_id", "position", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").alias("piece"))
    hashes = digested(lines, ["conv_id"], ["position"], "piece", "\n").withColumnRenamed("sha256", "repaired_sha256")
    whole = ids.select(F.col("conv_id").cast("long").alias("conv_id")).filter(F.col("conv_id").isNotNull()).distinct()
    for table in (turns, counts, illegal, audits, hashes):
        whole = whole.join(table, "conv_id", "left")
    out = whole.select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256")
    )
    out = written(out, "report")
    dropped(found, edited)
    return out


def damaged(conversations: DataFrame, draw: Column) -> DataFrame:
    """Conversations with damage: draw 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's. Nulls become one space first. place and copy keep the order of what was there."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    known = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), draw.alias("draw")).withColumn("place", content(F.col("role"), F.col("text")))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return known.filter("draw <> 0").select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "place", F.explode(copies).alias("copy"))
