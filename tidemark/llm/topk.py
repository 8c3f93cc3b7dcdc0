"""Exact top-k search by distributed histogram selection.

Vectors are dealt by hash into blocks of bounded size, queries into blocks of their own; every query block meets every candidate block
of its dimension by an equi-join on a block number, and a task scores one such pair as a matrix product.
For each query an interval that holds its k-th best score starts as the whole range of scores. Each round scores everything again,
counts the scores of the interval by equal buckets, sums the counts of all blocks by query and bucket, and keeps the bucket in which the
count from above reaches k. When the interval is one score wide, that is the k-th value: all scores above it are taken, and of those
equal to it the smallest ids, as many as are missing.
A block leaves out buckets under its own k-th score: the k-th of all can't lie below it.

Components become floor(scale * x) in double precision; scores are integers, exact in double precision up to 2^53. Vectors that are null,
empty or hold a null or non-finite component take no part, nor do rows without an id. Rows are told apart by a number of their own, not by
their id: where an id is repeated, each of its rows is a candidate to all others, and a query with ranks of its own if the id is asked for.
Vectors of unlike length are not compared. Empty tables give an empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

BLOCK = 4096
QUERY_BLOCK = 1024
BUCKETS = 4096
_PACKED = "dim int, block int, rows binary, ids binary, cells binary"


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(row, id, cells: array of integers as double) of the vectors that take part. Row numbers hold for one run of the tasks."""
    x = F.col(f"`{vector}`").cast("array<double>")
    sound = F.col(f"`{key}`").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    cells = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("double"))
    return vectors.filter(sound).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("id"), cells.alias("cells"))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors packed into blocks of about `size` by a hash of the row number, each in the order of its ids."""
    counts = vectors.groupBy(F.size("cells").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    dealt = vectors.withColumn("dim", F.size("cells")).join(F.broadcast(counts) if counts.count() <= 10_000 else counts, "dim")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / size)).cast("int"))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "row"])
        packed = {c: rows[c].to_numpy("<i8").tobytes() for c in ("row", "id")}
        return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "block": [rows["block"].iloc[0]], "rows": [packed["row"]], "ids": [packed["id"]], "cells": [np.stack(rows["cells"].to_numpy()).astype("<f8").tobytes()]})

    return dealt.select("row", "id", "cells", "dim", "block").groupBy("dim", "block").applyInPandas(packed, _PACKED)


def _places(among: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted row numbers stand among others; of those that don't stand there, any place."""
    order = np.argsort(among)
    return order[np.minimum(np.searchsorted(among, wanted, sorter=order), len(among) - 1)]


def _scores(row, queries: np.ndarray) -> np.ndarray:
    """Scores of the row's queries (rows) and candidates (columns); a query's own row gets -inf."""
    candidates = np.frombuffer(row.rows, "<i8")
    scores = np.frombuffer(row.query_cells, "<f8").reshape(len(queries), row.dim) @ np.frombuffer(row.cells, "<f8").reshape(len(candidates), row.dim).T
    at = _places(candidates, queries)
    own = np.flatnonzero(candidates[at] == queries)
    scores[own, at[own]] = -np.inf
    return scores


def top_k(vectors: DataFrame, query_ids: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), id and score of the k best other rows of every row whose id is in query_ids (column id)."""
    cells = written(quantised(vectors, key, vector, scale), "cells")
    stored = written(blocks(cells, block), "blocks")
    asked = written(blocks(cells.join(query_ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi"), query_block), "queries")
    asked = asked.select("dim", F.col("block").alias("query_block"), F.col("rows").alias("query_rows"), F.col("ids").alias("query_ids"), F.col("cells").alias("query_cells"))
    spread = asked.groupBy("dim").agg(F.collect_list("query_block").alias("query_blocks"))
    pairs = stored.join(spread, "dim").withColumn("query_block", F.explode("query_blocks")).drop("query_blocks").repartition("dim", "query_block", "block").join(asked, ["dim", "query_block"])
    largest = cells.select(F.size("cells").alias("dim"), F.greatest(F.array_max("cells"), -F.array_min("cells")).alias("x")).agg((F.max("dim") * F.max("x") * F.max("x")).alias("bound")).first().bound
    if largest is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    low, high = -int(largest), int(largest) + 1  # all scores are in [low, high)
    state = None  # per query block: ids, low ends of the intervals, missing
    width = high - low
    while True:
        width = max(1, -(-width // BUCKETS))
        buckets = (pairs if state is None else pairs.join(state, ["dim", "query_block"])).mapInPandas(_counter(k, low, width, state is not None), "dim int, query_block int, query_row long, bucket long, n long")
        summed = buckets.groupBy("dim", "query_block", "query_row", "bucket").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("dim", "query_block", "query_row").orderBy(F.desc("bucket"))
        running = summed.withColumn("upto", F.sum("n").over(above)).withColumn("most", F.max("upto").over(above.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        # `n` of the bucket -1 are the scores above the interval; a query with fewer than k candidates keeps its last bucket
        chosen = running.filter((F.col("upto") >= F.least(F.lit(k), "most")) & (F.col("upto") - F.col("n") < F.least(F.lit(k), "most")))
        rows = chosen.select("dim", "query_block", "query_row", F.col("bucket").alias("low"), (F.least(F.lit(k), "most") - (F.col("upto") - F.col("n"))).alias("missing"))
        packed = rows.groupBy("dim", "query_block").agg(F.sort_array(F.collect_list(F.struct("query_row", "low", "missing"))).alias("s"))
        state = written(packed.select("dim", "query_block", F.col("s.query_row").alias("known"), F.col("s.low").alias("lows"), F.col("s.missing").alias("missing")), "intervals")
        if width == 1:
            break
    taken = pairs.join(state, ["dim", "query_block"]).mapInPandas(_taker(), "query_row long, query_id long, id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    return taken.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _state(row, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which queries have an interval, its low end, and how many scores are missing in it."""
    at = _places(queries, np.asarray(row.known))
    low, missing = np.full(len(queries), np.inf), np.zeros(len(queries), np.int64)
    low[at], missing[at] = row.lows, row.missing
    return np.isfinite(low), low, missing


def _counter(k: int, low: int, width: int, narrowed: bool):
    """Counts by bucket; buckets are named by their low end."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                queries = np.frombuffer(row.query_rows, "<i8")
                scores = _scores(row, queries)
                base = np.full(len(queries), float(low))
                if narrowed:
                    _, base, _ = _state(row, queries)
                kth = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(queries), -np.inf)
                at, column = np.nonzero((scores >= kth[:, None]) & (scores >= base[:, None]) & np.isfinite(scores))
                bucket = (base[at] + (scores[at, column] - base[at]) // width * width).astype(np.int64)
                pair, n = np.unique(np.stack([at, bucket]), axis=1, return_counts=True)
                if len(n):
                    yield pd.DataFrame({"dim": row.dim, "query_block": row.query_block, "query_row": queries[pair[0]], "bucket": pair[1], "n": n})

    return count


def _taker():
    """All scores above the k-th value, and of those equal to it this block's smallest ids, as many as are missing."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                queries, ids = np.frombuffer(row.query_rows, "<i8"), np.frombuffer(row.ids, "<i8")
                scores = _scores(row, queries)
                known, value, missing = _state(row, queries)
                at, column = np.nonzero((scores >= value[:, None]) & known[:, None] & np.isfinite(scores))
                equal = scores[at, column] == value[at]
                nth = np.cumsum(equal)
                nth -= np.concatenate([[0], nth])[np.searchsorted(at, at)]  # place among the query's equal scores, ids ascending
                keep = ~equal | (nth <= missing[at])
                at, column = at[keep], column[keep]
                yield pd.DataFrame({"query_row": queries[at], "query_id": np.frombuffer(row.query_ids, "<i8")[at], "id": ids[column], "score": scores[at, column].astype(np.int64)})

    return take
