"""Sorted layouts, shards, splits, slices and reconciliation of listings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import counted_values
from tidemark.sources.tars import store


BLOCK_ROWS, FILE_ROWS = 250_000, 1_000_000


def files_for(rows: int, least: int) -> int:
    """So many files, and more where one would have over `FILE_ROWS` rows, as a task sorts a file."""
    return max(least, -(-rows // FILE_ROWS))


def sorted_layout(ticks: DataFrame, files: int, keys: tuple[str, ...] = ("symbol", "date", "seq")) -> DataFrame:
    """Rows range-partitioned by symbol and sorted within: written so, readers skip row groups by their symbols. A symbol with many rows is split by its later keys."""
    return ticks.repartitionByRange(files, *keys).sortWithinPartitions(*keys)


def ordered_by_available(df: DataFrame) -> DataFrame:
    """Sorted by symbol and timestamp, else date and time, else date, by what columns there are."""
    for keys in (("timestamp",), ("date", "time"), ("date",)):
        if all(k in df.columns for k in keys):
            return df.orderBy("symbol", *keys)
    return df.orderBy("symbol")


def unsorted_rows(table: DataFrame, key: str = "symbol") -> DataFrame:
    """(unsorted, rows) of a table read from files: rows whose key is under that of the row before in their file."""
    rows = table.select("_metadata.file_path", "_metadata.row_index", key).withColumn("_block", F.floor(F.col("row_index") / BLOCK_ROWS)).repartition(max(1, -(-table.count() // BLOCK_ROWS)), "file_path", "_block")
    before = F.lag(key).over(Window.partitionBy("file_path", "_block").orderBy("row_index"))
    falls = F.coalesce(F.sum((F.col(key) < F.col("_b")).cast("int")), F.lit(0))
    blocks = rows.withColumn("_b", before).groupBy("file_path", "_block").agg(falls.alias("_falls"), F.count(F.lit(1)).alias("_n"), F.min_by(key, "row_index").alias("_first"), F.max_by(key, "row_index").alias("_last"))
    ends = F.lag("_last").over(Window.partitionBy("file_path").orderBy("_block"))  # one row for each block
    joints = F.coalesce((F.col("_first") < F.col("_end")).cast("int"), F.lit(0))
    return blocks.withColumn("_end", ends).agg(F.coalesce(F.sum(F.col("_falls") + joints), F.lit(0)).alias("unsorted"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))


def new_partitions(source: DataFrame, done: DataFrame, key: str = "date") -> DataFrame:
    """Rows of the keys that the target doesn't have yet."""
    return source.join(done.select(key).distinct(), key, "left_anti")


def shard_ranges(days: DataFrame, shards: int) -> DataFrame:
    """(date, first_shard, last_shard): shards apportioned to dates by their rows (date, n), in order; a date gets one at least."""
    order = Window.orderBy("date")  # one row for each date
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    placed = days.withColumns({"_to": upto, "_total": total})
    first = F.floor((F.col("_to") - F.col("n")) / F.col("_total") * shards)
    last = F.greatest(F.floor(F.col("_to") / F.col("_total") * shards) - 1, first)
    return placed.select("date", first.cast("long").alias("first_shard"), last.cast("long").alias("last_shard"))


def shard_dates(ranges: DataFrame, shards: int, reach: int = 9) -> DataFrame:
    """(shard, date) for shards 0..shards - 1: the later date where two claim one; a shard without a date takes that of the nearest before, within `reach`."""
    claimed = ranges.select(F.explode(F.sequence("first_shard", "last_shard")).alias("shard"), "date").groupBy("shard").agg(F.max("date").alias("date"))
    spine = ranges.sparkSession.range(shards).select(F.col("id").alias("shard"))
    before = F.last("date", ignorenulls=True).over(Window.orderBy("shard").rowsBetween(-reach, -1))  # one row for each shard
    return spine.join(claimed, "shard", "left").withColumn("date", F.coalesce("date", before))


def with_shard_date(samples: DataFrame, dates: DataFrame, shard: str = "shard_idx") -> DataFrame:
    """samples with mapped_date; a shard without one gets a name of its own."""
    named = dates.select(F.col("shard").alias(shard), F.col("date").alias("mapped_date"))
    return samples.join(named, shard, "left").withColumn("mapped_date", F.coalesce("mapped_date", F.format_string("shard_%05d", F.col(shard))))


def temporal_split(samples: DataFrame, key: str = "date", validation: float = 0.2, embargo: int = 1) -> DataFrame:
    """samples with part: train or validation by the order of their dates (or shards); the embargo on both sides of the cut is left out."""
    keys = samples.select(key).distinct().withColumn("_k", F.row_number().over(Window.orderBy(key)) - 1)  # one row for each date
    n = keys.count()
    cut = int(n * (1 - validation) + 1e-9)
    part = F.when(F.col("_k") < cut - embargo, F.lit("train")).when(F.col("_k") >= cut + embargo, F.lit("validation"))
    return samples.join(keys.withColumn("part", part).drop("_k").filter("part is not null"), key)


def shard_slice(samples: DataFrame, first: int, last: int, shard: str = "shard_idx") -> DataFrame:
    """Samples of the shards at places first..last - 1 in order."""
    places = counted_values(samples.select(shard).distinct(), shard).filter((F.col("before") >= first) & (F.col("before") < last))
    return samples.join(places.select(F.col("value").alias(shard)), shard, "left_semi")


def symbol_slice(rows: DataFrame, first: int, last: int, order: str = "seq") -> DataFrame:
    """Rows first..last - 1 of each symbol; all of them if the symbol has no more than `last`, then its first last - first."""
    own = Window.partitionBy("symbol")
    placed = rows.withColumns({"_r": F.row_number().over(own.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(own)})
    start = F.when(F.col("_n") > last, F.lit(first)).otherwise(F.lit(0))
    return placed.filter((F.col("_r") >= start) & (F.col("_r") < start + (last - first))).drop("_r", "_n")


def shuffled_batches(samples: DataFrame, keys: list[str], size: int = 256, seed: int = 7) -> DataFrame:
    """samples with batch: a shuffle by a seeded hash of the keys, cut every `size` rows. Equal hashes share their place's batch."""
    hashed = samples.withColumn("_h", F.xxhash64(*keys, F.lit(seed)))
    places = counted_values(hashed, "_h").select(F.col("value").alias("_h"), F.floor(F.col("before") / size).alias("batch"))
    return hashed.join(places, "_h").drop("_h")


def first_week(dates: DataFrame, days: int = 5) -> DataFrame:
    """The first Monday among the dates (yyyyMMdd) with enough later dates, and the dates that follow it, `days` in all."""
    day = F.to_date("date", "yyyyMMdd")
    order = Window.orderBy("date")  # one row for each date
    numbered = dates.select("date").distinct().withColumns({"_k": F.row_number().over(order), "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})
    start = numbered.filter((F.dayofweek(day) == 2) & (F.col("_k") + days - 1 <= F.col("_n"))).agg(F.min("_k").alias("_s"))
    return numbered.join(start, (F.col("_k") >= F.col("_s")) & (F.col("_k") < F.col("_s") + days)).select("date")


def sampled_files(listing: DataFrame, share: float = 0.01, seed: int = 7) -> DataFrame:
    """A share of the distinct paths, one at least, by a seeded hash."""
    paths = listing.select("path").distinct()
    k = max(1, int(paths.count() * share))
    return paths.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(k)


def reconciled(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(name, local_length, remote_length, status) of files (path, length) that one listing lacks or that differ in size."""
    named = lambda df, c: df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias(c))
    both = named(local, "local_length").join(named(remote, "remote_length"), "name", "full_outer")
    status = F.when(F.col("remote_length").isNull(), F.lit("missing")).when(F.col("local_length").isNull(), F.lit("extra")).when(F.col("local_length") != F.col("remote_length"), F.lit("size differs"))
    return both.withColumn("status", status).filter("status is not null")


def row_counts(table: DataFrame, key: str = "date") -> DataFrame:
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def partition_counts(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Rows of a partitioned Parquet table by its partition columns (all rows without any), from file footers: the aggregate goes down into the scan, which reads no column.

    That takes Spark's newer Parquet reader; it is asked for in a session of its own.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", True)
    return own.read.parquet(folder).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def footer_counts(files: DataFrame) -> DataFrame:
    """path and n of Parquet files (path) that lie where Arrow's file systems reach: tasks read their footers. A file that isn't Parquet has n null."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for path in rows["path"]:
                fs, at = store(path)
                try:
                    with fs.open_input_file(at) as file:
                        found.append(pq.ParquetFile(file).metadata.num_rows)
                except pa.ArrowInvalid:
                    found.append(None)
            yield pd.DataFrame({"path": rows["path"], "n": pd.array(found, "Int64")})

    return files.select("path").mapInPandas(count, "path string, n long")
