"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, and the shards' results merged.

Distinct vectors are dealt by hash into shards of about `size`. A shard's graph is one row of a table: its vectors, and for each layer the nodes and their neighbours as flat
arrays (-1 where a node has fewer). Nodes enter in the order of a hash; a node's layers fall off geometrically by another. On each layer it is linked to earlier nodes,
chosen from its nearest ones by the usual rule (a candidate is taken unless it lies nearer to one taken before), and linked back; a list that grows too long is chosen anew by the same rule. The nearest
earlier nodes come from matrix products over the shard, block by block, in place of searches of the unfinished graph: for shards of this size that costs less, and misses none.

A search goes down greedily to the lowest layer, and there keeps the `beam` nearest nodes met, until none of them is left to expand; many queries move in step.
Every query goes to every shard of its length, so that a task holds one graph and passes a batch of queries over it; shards give their best k and a window merges them.

Equal vectors are one node with the rows that hold it: the k + 1 smallest ids, as no more can be among any query's k nearest (one may be the query itself). Nearness is
the Euclidean distance in double precision of the original vectors. Shards of up to `beam` vectors are compared whole.

Vectors that are null, empty, all zero or hold a null or non-finite component take no part, nor do rows without an id. Rows are told apart by a number of their own: where an id is repeated, each
row is a candidate to the others, and a query of its own. Vectors of unlike length are not compared. Ties: the smaller id. Empty tables give an empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, written

SIZE = 16_384  # vectors of a shard
LINKS = 16  # links of a node as it enters; twice as many on the lowest layer at most
WIDE = 96  # nearest earlier nodes that links are chosen from
BEAM = 160
EXPANDED = 4  # nodes expanded in a step of the search
STEP_CELLS = 4_000_000  # of visited marks that a step of many queries holds
GRAPH = "dim int, shard int, n int, vectors binary, owners binary, ids binary, rows binary, layers array<struct<width: int, nodes: binary, links: binary>>"


def sound(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, id, x: array of doubles) of the vectors that take part."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = F.col(f"`{key}`").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.filter(fine).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("id"), x.alias("x"))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(-1)[:, None] - 2 * (a @ b.T) + (b * b).sum(-1)[None, :]


def _chosen(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates (nearest first; -1: none) at most so many, each nearer to the node than to any taken before; places left go to the nearest of the rest."""
    out = np.full((len(nodes), most), -1, np.int32)
    step = max(1, 16_000_000 // (near.shape[1] * (near.shape[1] + x.shape[1])))
    for lo in range(0, len(nodes), step):
        c, d = near[lo : lo + step], far[lo : lo + step]
        at = x[np.maximum(c, 0)]
        between = np.maximum((at * at).sum(-1)[:, :, None] + (at * at).sum(-1)[:, None, :] - 2 * at @ at.transpose(0, 2, 1), 0)
        taken = np.zeros(c.shape, bool)
        for i in range(c.shape[1]):
            blocked = (taken[:, :i] & (between[:, i, :i] < d[:, i, None])).any(1)
            taken[:, i] = (c[:, i] >= 0) & ~blocked & (taken[:, :i].sum(1) < most)
        order = np.argsort(np.where(c < 0, 2, ~taken), axis=1, kind="stable")[:, :most]
        picked = np.take_along_axis(c, order, 1)
        out[lo : lo + step, : picked.shape[1]] = picked
    return out


def _layer(x: np.ndarray, nodes: np.ndarray, links: int, most: int, wide: int) -> np.ndarray:
    """Neighbours (numbers of nodes of x) of the layer's nodes, which stand in the order of entering."""
    v, n = x[nodes], len(nodes)
    wide = min(wide, n)
    near, far = np.full((n, wide), -1, np.int64), np.full((n, wide), np.inf, np.float32)
    block = max(1, 8_000_000 // n)
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        d = np.maximum(_squares(v[lo:hi], v[:hi]), 0)
        d[np.arange(hi)[None, :] >= np.arange(lo, hi)[:, None]] = np.inf  # earlier nodes only
        k = min(wide, hi)
        best = np.argpartition(d, k - 1, axis=1)[:, :k] if k < hi else np.broadcast_to(np.arange(hi), d.shape)
        at = np.take_along_axis(d, best, 1)
        order = np.argsort(at, axis=1, kind="stable")
        near[lo:hi, :k], far[lo:hi, :k] = np.take_along_axis(best, order, 1), np.take_along_axis(at, order, 1)
    near[~np.isfinite(far)] = -1
    out = _chosen(v, np.arange(n), near, far, min(links, most))
    # links back: all that point to a node, with its own, nearest first, chosen anew
    source, target = np.repeat(np.arange(n), out.shape[1]), out.ravel().astype(np.int64)
    source, target = source[target >= 0], target[target >= 0]
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    d = np.empty(len(a), np.float32)
    for lo in range(0, len(a), 200_000):
        d[lo : lo + 200_000] = ((v[a[lo : lo + 200_000]] - v[b[lo : lo + 200_000]]) ** 2).sum(1)
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    lists = np.full((n, most), -1, np.int32)
    degree = np.bincount(a, minlength=n)
    few = degree[a] <= most
    lists[a[few], place[few]] = b[few]
    for width in (2 * most, 8 * most, n):  # long lists by length, so that one hub doesn't widen all
        many = np.flatnonzero((degree > most) & (degree <= width) & (lists[:, 0] < 0))
        if not len(many):
            continue
        row = np.full(n, -1)
        row[many] = np.arange(len(many))
        mine = row[a] >= 0
        near, far = np.full((len(many), int(degree[many].max())), -1, np.int64), np.full((len(many), int(degree[many].max())), np.inf, np.float32)
        near[row[a[mine]], place[mine]], far[row[a[mine]], place[mine]] = b[mine], d[mine]
        cut = near[:, : 8 * most], far[:, : 8 * most]  # of a hub the nearest are chosen from
        lists[many] = _chosen(v, many, *cut, most)
    return np.where(lists >= 0, nodes[np.maximum(lists, 0)], -1).astype("<i4")


def _built(links: int, wide: int):
    """A shard's graph from its distinct vectors (x, owners: pairs of id and row)."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("enters", kind="stable")  # a hash of the vector: the same order whenever a task runs again
        exact = np.stack(rows["x"].to_numpy()).astype("<f8")
        x, n = exact.astype(np.float32), len(rows)
        chance = (rows["level"].to_numpy().astype(np.uint64) >> np.uint64(11)).astype(float) / (1 << 53)
        level = np.floor(-np.log(np.maximum(chance, 1e-300)) / np.log(links)).astype(int)
        level[0] = max(level.max(), 0)  # the first node stands on all layers
        layers = []
        for at in range(level[0] + 1):
            nodes = np.flatnonzero(level >= at)
            layers.append({"width": 2 * links if at == 0 else links, "nodes": nodes.astype("<i4").tobytes(), "links": _layer(x, nodes, links, 2 * links if at == 0 else links, wide).tobytes()})
        held = rows["owners"].to_numpy()
        pairs = [(o["id"], o["row"]) for own in held for o in own]
        ids, numbers = (np.array(c, "<i8") for c in zip(*pairs))
        starts = np.concatenate([[0], np.cumsum([len(own) for own in held])]).astype("<i4")
        return pd.DataFrame([{"dim": rows["dim"].iloc[0], "shard": rows["shard"].iloc[0], "n": n, "vectors": exact.tobytes(), "owners": starts.tobytes(), "ids": ids.tobytes(), "rows": numbers.tobytes(), "layers": layers}])

    return build


def graphs(vectors: DataFrame, k: int, size: int = SIZE, links: int = LINKS, wide: int = WIDE) -> DataFrame:
    """A row of flat arrays for each shard of the vectors (row, id, x)."""
    of_one = Window.partitionBy("x").orderBy("id", "row")
    first = vectors.withColumn("_place", F.row_number().over(of_one)).filter(F.col("_place") <= k + 1)
    distinct = written(first.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("owners")), "distinct")
    counts = distinct.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    dealt = distinct.withColumn("dim", F.size("x")).join(F.broadcast(counts) if counts.count() <= 10_000 else counts, "dim")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / size)).cast("int"))
    seeds = dealt.select("dim", "shard", "x", "owners", F.xxhash64(F.lit("enters"), "x").alias("enters"), F.xxhash64(F.lit("level"), "x").alias("level"))
    return seeds.groupBy("dim", "shard").applyInPandas(_built(links, wide), GRAPH)


class _Graph:
    def __init__(self, row):
        self.exact = np.frombuffer(row["vectors"], "<f8").reshape(int(row["n"]), -1)
        self.x = self.exact.astype(np.float32)
        self.norms = (self.x * self.x).sum(1)
        self.owners, self.ids, self.rows = np.frombuffer(row["owners"], "<i4"), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], "<i8")
        self.layers = []
        for layer in row["layers"]:
            nodes = np.frombuffer(layer["nodes"], "<i4")
            self.layers.append((nodes, np.frombuffer(layer["links"], "<i4").reshape(len(nodes), int(layer["width"]))))

    def _far(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return self.norms[nodes] - 2 * (self.x[nodes] @ q[:, :, None])[:, :, 0]  # less the query's own square

    def nearest(self, q: np.ndarray, beam: int) -> np.ndarray:
        """The numbers of `beam` near nodes of each query; -1: none."""
        if len(self.x) <= beam:
            return np.broadcast_to(np.arange(len(self.x)), (len(q), len(self.x)))
        at = np.zeros(len(q), np.int64)
        for nodes, links in self.layers[:0:-1]:
            best, moving = self._far(q, at[:, None])[:, 0], np.arange(len(q))
            while len(moving):
                near = links[np.searchsorted(nodes, at[moving])]
                far = np.where(near >= 0, self._far(q[moving], np.maximum(near, 0)), np.inf)
                pick = far.argmin(1)
                low = far[np.arange(len(moving)), pick]
                better = low < best[moving]
                moving, pick, low, near = moving[better], pick[better], low[better], near[better]
                at[moving], best[moving] = near[np.arange(len(moving)), pick], low
        return self._beam(q, at, beam)

    def _beam(self, q: np.ndarray, at: np.ndarray, beam: int) -> np.ndarray:
        links, line = self.layers[0][1], np.arange(len(q))[:, None]
        held, far, done = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), np.inf, np.float32), np.ones((len(q), beam), bool)
        held[:, 0], far[:, :1], done[:, 0] = at, self._far(q, at[:, None]), False
        seen = np.zeros((len(q), len(self.x)), bool)
        seen[line[:, 0], at] = True
        alive = np.arange(len(q))
        while len(alive):
            open_ = np.where(done[alive], np.inf, far[alive])
            pick = np.argpartition(open_, EXPANDED, axis=1)[:, :EXPANDED]
            live = np.isfinite(np.take_along_axis(open_, pick, 1))
            some = live.any(1)
            alive, pick, live = alive[some], pick[some], live[some]
            if not len(alive):
                break
            rows = alive[:, None]
            done[rows, pick] = True
            near = np.where(live[:, :, None], links[np.where(live, held[rows, pick], 0)], -1).reshape(len(alive), -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            near = np.maximum(near, 0)
            fresh &= ~seen[rows, near]
            width = int(fresh.sum(1).max())
            if not width:
                continue
            front = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            near, fresh = np.take_along_axis(near, front, 1), np.take_along_axis(fresh, front, 1)
            seen[np.broadcast_to(rows, near.shape)[fresh], near[fresh]] = True
            distance = np.where(fresh, self._far(q[alive], near), np.inf)
            all_far = np.concatenate([far[alive], distance], axis=1)
            keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            held[alive] = np.take_along_axis(np.concatenate([held[alive], near], axis=1), keep, 1)
            far[alive] = np.take_along_axis(all_far, keep, 1)
            done[alive] = np.take_along_axis(np.concatenate([done[alive], ~fresh], axis=1), keep, 1)
        return np.where(np.isfinite(far), held, -1)

    def answers(self, row: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, beam: int) -> pd.DataFrame:
        found = []
        for lo in range(0, len(q), max(1, STEP_CELLS // len(self.x))):
            part = slice(lo, lo + max(1, STEP_CELLS // len(self.x)))
            near = self.nearest(q[part].astype(np.float32), beam)
            which, column = np.nonzero(near >= 0)
            node = near[which, column]
            exact = np.sqrt(((self.exact[node] - q[part][which]) ** 2).sum(1))
            copies = self.owners[node + 1] - self.owners[node]
            which, node, exact = np.repeat(which, copies), np.repeat(node, copies), np.repeat(exact, copies)
            owner = np.arange(len(node)) - np.repeat(np.cumsum(copies) - copies, copies) + self.owners[node]
            other = self.rows[owner] != row[part][which]
            which, owner, exact = which[other], owner[other], exact[other]
            order = np.lexsort((self.rows[owner], self.ids[owner], exact, which))
            which, owner, exact = which[order], owner[order], exact[order]
            top = np.arange(len(which)) - np.searchsorted(which, which) < k
            which, owner, exact = which[top], owner[top], exact[top]
            found.append(pd.DataFrame({"query_row": row[part][which], "query_id": ids[part][which], "id": self.ids[owner], "row": self.rows[owner], "score": exact}))
        return pd.concat(found)


def _searcher(k: int, beam: int):
    """A shard's graph comes first, then its queries in batches."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = None
        for batch in batches:
            if graph is None and len(batch):
                graph, batch = _Graph(batch.iloc[0]["graph"]), batch.iloc[1:]
            if len(batch):
                yield graph.answers(batch["row"].to_numpy("int64"), batch["id"].to_numpy("int64"), np.stack(batch["x"].to_numpy()).astype(float), k, beam)

    return search


def nearest(vectors: DataFrame, query_ids: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, links: int = LINKS, wide: int = WIDE, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), id and score of the k nearest other rows found for every row whose id is in query_ids (column id)."""
    stored = written(sound(vectors, key, vector), "vectors")
    index = written(graphs(stored, k, size, links, wide), "graphs")
    asked = stored.join(query_ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi").withColumn("dim", F.size("x"))
    spread = asked.join(index.select("dim", "shard"), "dim").select("dim", "shard", F.lit(1).alias("kind"), "row", "id", "x", F.lit(None).cast(_graph_type(index)).alias("graph"))
    whole = index.select("dim", "shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("x"), F.struct(*[c for c in index.columns if c not in ("dim", "shard")]).alias("graph"))
    lined = whole.unionByName(spread).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    found = lined.groupBy("dim", "shard").applyInPandas(_searcher(k, beam), "query_row long, query_id long, id long, row long, score double")
    best = Window.partitionBy("query_row").orderBy("score", "id", "row")
    out = written(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score"), "nearest")
    dropped(stored, index)
    return out


def _graph_type(index: DataFrame) -> str:
    return "struct<" + ",".join(f"{name}:{kind}" for name, kind in index.dtypes if name not in ("dim", "shard")) + ">"
