"""Literal tables, replaced columns and slices of batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import dropped, same_table, written

__all__ = ["added", "dropped", "literal_table", "release", "same_table", "sliced", "slices", "written"]


def release() -> None:
    """At the end of a task: what Arrow and the C library keep for later goes back to the system, for the other processes of the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of constants that Catalyst knows the size of."""
    structs = [F.struct(*[F.lit(value).alias(name) for name, value in zip(columns, row, strict=True)]) for row in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))


def added(df: DataFrame, **columns) -> DataFrame:
    """df with new columns; columns of df with those names (in any case) make way for them."""
    names = {name.lower() for name in columns}
    kept = [f"`{c}`" for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])


def sliced(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts with so many bytes of text (column number `text`) at most, so that a task holds little beside the batch that it was given.

    A longer text is a part of its own, and whole.
    """
    for batch in batches:
        lo, used = 0, 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
            if used and used + size > most_bytes:
                yield batch.slice(lo, i - lo)
                lo, used = i, 0
            used += size
        if lo < batch.num_rows:
            yield batch.slice(lo)


def slices(texts: list[str | None], most_chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that a task holds in parts at once; a longer text is a run of its own."""
    lo, chars = 0, 0
    for i, text in enumerate(texts):
        if chars and chars + len(text or "") > most_chars:
            yield lo, i
            lo, chars = i, 0
        chars += len(text or "")
    if texts:
        yield lo, len(texts)
