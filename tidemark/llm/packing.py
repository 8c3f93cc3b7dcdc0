"""Best-fit packing of tokenized documents into sequences of a fixed capacity, bulk-synchronously.

1. Tasks tokenize whole texts and cut those over the capacity (the first piece may be shorter); each task numbers its pieces by length.
2. Pieces of one length are interchangeable, and so are sequences with one gap. Both are therefore held as runs, in tables:
   (length, first rank, pieces) and (gap, first sequence, sequences), which the one task that sweeps a band sorts by size. There are at most as many lengths and gaps as the capacity has
   values, however large the corpus is; only the tables' counts grow.
3. Supersteps over bands of lengths, the longest first (each band's limit is half the one before). A sweep goes down the band's lengths:
   their successor is the smallest gap that fits. Where several lengths want one gap, the longer ones come first; ranks say which pieces
   get which sequences. Gaps are updated at once and meet the next pieces; where none fits, as many sequences open as the pieces fill.
4. The superstep's runs and gaps are written, and the next band starts from them.
5. Pieces (place in the task plus the counts of earlier tasks give the rank) are joined with the runs.

Every superstep is one Spark job that reads the tables of the one before from the shared folder and writes its own, so that a lost executor
costs one superstep; the driver learns only how many sequences are open. A superstep's tables are runs, not rows, so that one task holds them.

Null text: empty; its one piece is the end mark. Equal lengths, repeated rows and ties are told apart by rank alone, so that any of them
may come first. An empty table gives an empty result. Other columns are left out but for `keep`, where the results' names (piece, start,
length, ids_crc32, ids, sequence_id, offset, and shard, number and rank) may not stand.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.llm.common import release, sliced, written
from tidemark.llm.merges import Encoder, MergeModel

CAPACITY = 2048
END_ID = 0
LAST_BAND = 32  # lengths up to this one are one band
RANKS = 1 << 16


@cache
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(MergeModel(vocabulary), byte_level=True)


def tokenized_pieces(documents: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Per piece: the columns of keep, piece, start, length, ids_crc32, ids (if asked for), and its place: shard and number within shard and length.

    Every document ends with `end_id`. The places hold for one run of the tasks; `pack` needs them from a written table.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, shard = _encoder(vocabulary), Counter(), TaskContext.get().partitionId()
        end = array("I", [end_id]).tobytes()
        for batch in sliced(batches, len(keep)):
            at, columns = [], [[] for _ in range(7 if with_ids else 6)]
            for row, value in enumerate(encoder(batch.column(len(keep)).to_pylist())):
                data = value + end
                total = len(data) // 4
                first = (total - 1) % capacity + 1
                for piece, (lo, hi) in enumerate(zip([0, *range(first, total, capacity)], range(first, total + 1, capacity))):
                    body = data[4 * lo : 4 * hi]
                    at.append(row)
                    for column, x in zip(columns, (piece, lo, hi - lo, zlib.crc32(body), shard, seen[hi - lo], body)):
                        column.append(x)
                    seen[hi - lo] += 1
            kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(keep)]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c, t) for c, t in zip(columns, types)], [*keep, *names])
        encoder.forget()  # the worker goes on to other tasks
        release()

    names = ["piece", "start", "length", "ids_crc32", "shard", "number"] + ["ids"] * with_ids
    kept = documents.select(*[f"`{c}`" for c in keep], text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])
    return kept.mapInArrow(cut, f"{schema}, piece int, start long, length long, ids_crc32 long, shard int, number long" + ", ids binary" * with_ids)


_RUNS = "part string, length long, first_rank long, n long, first_sequence long, offset long"


def swept(lengths: list[tuple[int, int]], gaps: list[tuple[int, int, int]], capacity: int, opened: int) -> list[tuple]:
    """One sweep of lengths (length, pieces) over gaps (gap, first sequence, sequences); `opened` sequences exist. Rows of `_RUNS`."""
    free: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # of free gaps, ascending
    out = []

    def put(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in free:
                free[size] = []
                insort(sizes, size)
            free[size].append((first, n))

    for gap in sorted(gaps):
        put(*gap)
    for length, n in sorted(lengths, reverse=True):
        rank = 0
        while rank < n:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                new = -(-(n - rank) // (capacity // length))
                put(capacity, opened, new)
                opened += new
                continue
            size = sizes[at]
            first, many = free[size].pop()
            if not free[size]:
                del free[size]
                sizes.pop(at)
            each = size // length  # what is left of a gap that took a piece is the smallest again
            full = min(many, (n - rank) // each)
            rest = min(n - rank - full * each, each) if full < many else 0
            put(size, first + full + (rest > 0), many - full - (rest > 0))
            put(size - each * length, first, full)
            put(size - rest * length, first + full, int(rest > 0))
            for turn in range(each):
                if full:
                    out.append(("run", length, rank + turn * full, full, first, capacity - size + turn * length))
                if turn < rest:
                    out.append(("run", length, rank + each * full + turn, 1, first + full, capacity - size + turn * length))
            rank += each * full + rest
    return out + [("gap", size, None, n, first, None) for size in sizes for first, n in free[size]]


def superstep(lengths: DataFrame, gaps: DataFrame, capacity: int, opened: int) -> DataFrame:
    """`swept` over the tables lengths (length, n) and gaps (length, first_sequence, n), as one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [tuple(map(int, r)) for batch in batches for r in batch.itertuples(index=False)]
        found = swept([r[1:3] for r in rows if not r[0]], [(r[1], r[3], r[2]) for r in rows if r[0]], capacity, opened)
        yield pd.DataFrame(found, columns=["part", "length", "first_rank", "n", "first_sequence", "offset"]).astype({c: "Int64" for c in ("length", "first_rank", "n", "first_sequence", "offset")})

    both = gaps.selectExpr("1 as gap", "length", "n", "first_sequence as first").unionByName(lengths.selectExpr("0 as gap", "length", "n", "0 as first"))
    return both.coalesce(1).mapInPandas(run, _RUNS)


def best_fit_runs(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Runs of lengths (length, n): the n pieces from first_rank on go to the sequences from first_sequence on, at the offset."""
    runs, gaps, opened = [], lengths.sparkSession.createDataFrame([], _RUNS), 0
    for low, high in bands(capacity):
        seen = Observation()
        band = lengths.filter((F.col("length") > low) & (F.col("length") <= high))
        found = superstep(band, gaps, capacity, opened).observe(seen, F.max(F.when(F.col("part") == "run", F.col("first_sequence") + F.col("n"))).alias("opened"))
        table = written(found, "superstep")
        runs.append(table.filter("part = 'run'").drop("part"))
        gaps = table.filter("part = 'gap'")
        opened = max(opened, seen.get["opened"] or 0)
    return reduce(DataFrame.unionByName, runs)


def bands(capacity: int) -> list[tuple[int, int]]:
    """Bands of lengths (over low, up to high), the longest first."""
    found, high = [], capacity
    while high > LAST_BAND:
        found.append((high // 2, high))
        high //= 2
    return [*found, (0, high)]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A written table of `tokenized_pieces` with sequence_id and offset."""
    counts = pieces.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("pieces"))
    earlier = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = written(counts.select("shard", "length", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("before")), "places")  # Spark knows its size
    lengths = written(counts.groupBy("length").agg(F.sum("pieces").alias("n")), "lengths")
    runs = written(best_fit_runs(lengths, capacity), "runs")
    # a run is cut at every multiple of RANKS, so that the join's key is a length and a block of ranks, and no length is hot
    block = lambda rank: F.floor(rank / RANKS)
    cut = written(runs.withColumn("block", F.explode(F.sequence(block(F.col("first_rank")), block(F.col("first_rank") + F.col("n") - 1)))).withColumnRenamed("n", "run"), "cut")
    ranked = pieces.join(places, ["shard", "length"]).withColumn("rank", F.col("before") + F.col("number")).withColumn("block", block(F.col("rank")))
    inside = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("run"))
    fitted = ranked.join(cut, ["length", "block"]).filter(inside)
    kept = [c for c in pieces.columns if c not in ("shard", "number")]
    return fitted.select(*kept, (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def pack_documents(documents: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Tokenizes, writes the pieces to the shared folder, and packs them."""
    return pack(written(tokenized_pieces(documents, vocabulary, keep, text, capacity, with_ids=with_ids), "pieces"), capacity)
