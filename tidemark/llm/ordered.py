"""Places and digests within long keys: rows are range-partitioned by key and order, so that a hot key lies in many tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written


def content(role: Column, text: Column) -> Column:
    """32 bytes that stand for a turn's role and text."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def laid_out(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows as a table in the order of key and order (nulls first), with _part and _at: the range they lie in and a number that rises with the order. Rows without a key are left out."""
    columns = [F.col(c).asc_nulls_first() for c in (key, *order)]
    placed = rows.filter(F.col(key).isNotNull()).repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id())
    return written(placed.withColumn("_part", F.shiftright("_at", 33)), "ordered")


def _ahead(of: str, key: str, total):
    """total of a key's rows in the ranges before each of its own."""
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(total(of).over(before), F.lit(0).cast("long"))


def numbered(table: DataFrame, key: str, position: str = "position", size: str = "size") -> DataFrame:
    """A table of `laid_out` with each row's place in its key (from 1) and the key's number of rows. Each range gives one row for a key; what lies before it comes from those."""
    parts = table.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ahead = parts.select(key, "_part", "_first", _ahead("_n", key, F.sum).alias("_before"), F.sum("_n").over(Window.partitionBy(key)).alias(size))
    return table.join(ahead, [key, "_part"]).withColumn(position, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_first", "_before")


def xored(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table with each of the columns exclusive-ored from its key's first row on."""
    parts = table.groupBy(key, "_part").agg(*[F.bit_xor(c).alias(f"_{c}") for c in columns])
    ahead = parts.select(key, "_part", *[_ahead(f"_{c}", key, F.bit_xor).alias(f"_{c}") for c in columns])
    upto = Window.partitionBy(key, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    joined = table.withColumns({c: F.bit_xor(c).over(upto) for c in columns}).join(ahead, [key, "_part"])
    return joined.withColumns({c: F.col(c).bitwiseXOR(F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])


def digested(pieces: DataFrame, keys: list[str], order: list[str], piece: str, between: str) -> DataFrame:
    """keys and sha256: the digest of each key's pieces in order, joined by `between`. A task takes the sorted pieces one by one and keeps the digest's state alone."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            found = []
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            texts = batch.column(len(keys))
            for i, key in enumerate(zip(*columns)):
                if key != last:
                    if state is not None:
                        found.append((*last, state.hexdigest()))
                    state, last = hashlib.sha256(), key
                else:
                    state.update(between.encode())
                state.update(texts[i].as_py().encode("utf-8", "surrogatepass"))
            yield _batch(found)
        if state is not None:
            yield _batch([(*last, state.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * (len(keys) + 1)
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.string())], [*keys, "sha256"])

    sorted_ = pieces.repartition(*keys).sortWithinPartitions(*keys, *order).select(*[F.col(k).cast("long") for k in keys], piece)
    return sorted_.mapInArrow(digest, ", ".join(f"{k} long" for k in keys) + ", sha256 string")
