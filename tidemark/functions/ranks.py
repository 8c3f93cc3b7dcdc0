"""Ranks and quantiles over a whole table without a window in one partition.

Values are first counted, so that ties and hot values are one row, and the counts are written once, in ranges of their values; each
range sums up on its own, and only the totals of the ranges (one for each partition) pass through the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import dropped, same_table, written

FEW = 2_000_000


def _counted(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """`counted_values`, and the number of rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranged = written(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "counts")
    totals = {r.part: r.n for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts = list(accumulate([0, *(totals.get(part, 0) for part in range(max(totals, default=-1) + 1))]))
    earlier = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    before = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("part")) + F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return same_table(ranged.select("value", "n", before.alias("before")), ranged), starts[-1]


def with_average_rank_by(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """df with the rank from 1 of a column within the keys; ties get the mean of their ranks. No task needs the rows of a key: what is ordered are counts of its values, in ranges."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    ranged = written(counts.repartitionByRange(*keys, column).withColumn("_part", F.spark_partition_id()), "counts")
    totals = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"))  # one row for each key, and one for each cut
    parts = totals.withColumn("_before", F.coalesce(F.sum("_in").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_in")
    earlier = Window.partitionBy(*keys, "_part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    ranks = _joined(ranged, parts, [*keys, "_part"], "inner").select(*keys, column, (before + (F.col("_n") + 1) / 2.0).alias(name))
    few = ranged.count() <= FEW  # values of few digits: the rows needn't be moved
    return _joined(df, ranks, [*keys, column], "left", few)


def _joined(df: DataFrame, other: DataFrame, keys: list[str], how: str, few: bool = False) -> DataFrame:
    """The join by keys, of which NULL is a value like any other."""
    own = other.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return df.join(F.broadcast(own) if few else own, on, how).drop(*[f"_key{i}" for i in range(len(keys))])


def counted_values(df: DataFrame, column: str) -> DataFrame:
    """(value, n, before): the distinct values, their rows, and the rows of smaller values. NULL values are left out."""
    return _counted(df, column)[0]


def with_average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the rank from 1 of a column over all rows; ties get the mean of their ranks."""
    ranks = counted_values(df, column).select(F.col("value").alias(column), (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))
    return df.join(ranks, column, "left")


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, as `percentile`, of a column over all rows."""
    counts, total = _counted(df, column)
    if not total:
        return [None] * len(shares)
    places = [(total - 1) * q for q in shares]
    wanted = sorted({int(p) for p in places} | {min(int(p) + 1, total - 1) for p in places})
    hit = F.exists(F.array(*[F.lit(w) for w in wanted]), lambda w: (w >= F.col("before")) & (w < F.col("before") + F.col("n")))
    found = [(r.before, r.before + r.n, r.value) for r in counts.filter(hit).collect()]
    dropped(counts)
    at = {w: next(float(v) for lo, hi, v in found if lo <= w < hi) for w in wanted}
    return [at[int(p)] + (at[min(int(p) + 1, total - 1)] - at[int(p)]) * (p - int(p)) for p in places]
