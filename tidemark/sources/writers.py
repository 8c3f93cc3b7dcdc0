"""Writing sorted lakes, registries, predictions, curves and tar shards."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.layout import files_for, new_partitions, ordered_by_available, sorted_layout
from tidemark.operators.ticks import of_symbols
from tidemark.sources.scratch import written
from tidemark.sources.tars import files_below, registered, store


def write_sorted(ticks: DataFrame, path: str, files: int, row_group_bytes: int = 16 << 20, done: DataFrame | None = None) -> None:
    """The sorted layout as zstd Parquet, in `files` files or more where they would be large; with `done`, only dates that it lacks are added."""
    rows = ticks if done is None else new_partitions(ticks, done)
    sorted_layout(rows, files_for(rows.count(), files)).write.mode("append" if done is not None else "errorifexists").option("compression", "zstd").option("parquet.block.size", row_group_bytes).parquet(path)


def write_subset(ticks: DataFrame, symbols: list[str], path: str) -> None:
    """The ticks of the symbols, sorted by symbol and by what times there are, as Parquet; an empty table where no tick is theirs."""
    ordered_by_available(of_symbols(ticks, symbols)).write.parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.repartition("date").write.mode("append").partitionBy("date").parquet(path)


def write_registry(registry: DataFrame, path: str) -> None:
    registry.select("symbol", F.round("c", 6).alias("c")).write.json(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.json(path)


def write_curve(curve: DataFrame, path: str) -> None:
    curve.write.option("header", True).csv(path)


def write_trades(trades: DataFrame, path: str, order: list[str], most: int = 10_000) -> None:
    """The first trades in order; the limit is the report's."""
    trades.orderBy(*order).limit(most).write.json(path)


def write_samples(rows: DataFrame, path: str, digits: int = 4) -> None:
    """JSON lines with doubles rounded."""
    rows.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]).write.json(path)


def write_tar_shards(samples: DataFrame, folder: str, per_shard: int = 5000, mode: str = "errorifexists", seed: int = 0) -> None:
    """Samples (key, values, shape, meta) as tar shards in a seeded shuffle: ranges of a hash of the key go to tasks, which cut them into shards of so many samples."""
    registered(samples.sparkSession)
    place = F.xxhash64(F.lit(seed), "key")
    shuffled = samples.select("key", "shape", "values", "meta").repartitionByRange(place, "key").sortWithinPartitions(place, "key")
    if mode == "errorifexists":
        if files_below_if_any(folder):
            raise FileExistsError(f"{folder} holds shards")
        mode = "append"
    shuffled.write.format("tar_shards").option("per_shard", per_shard).mode(mode).save(folder)


def files_below_if_any(folder: str) -> list[tuple[str, int]]:
    fs, path = store(folder)
    return files_below(folder, "*.tar") if fs.get_file_info(path).type == pafs.FileType.Directory else []


def merge_shards(spark: SparkSession, outputs: list[str], folder: str) -> int:
    """Shards of several finished outputs, as copies in one folder with one numbering: output by output, each in the order of its names. Gives their number.

    An output without `_SUCCESS` stops it before anything is copied. Numbers come from the outputs' counts, added up over outputs; tasks copy, and what they copied must have the size of its source.
    """
    if unfinished := [path for path in outputs if (lambda at: at[0].get_file_info(f"{at[1].rstrip('/')}/_SUCCESS").type != pafs.FileType.File)(store(path))]:
        raise RuntimeError(f"outputs aren't finished: {', '.join(unfinished)}")
    listed = [(i, path, size) for i, output in enumerate(outputs) for path, size in files_below(output, "*.tar")]
    if not listed:
        return 0
    numbers = merged_numbers(spark.createDataFrame(listed, "output int, path string, size long"))
    copied = written(numbers.repartition("number").mapInPandas(_copier(folder), "number long, whole boolean"), "copied")
    count = copied.agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("whole")).first()
    if not count.whole:
        raise OSError("a copy has another size than its shard")
    fs, path = store(folder)
    with fs.open_output_stream(f"{path.rstrip('/')}/_SUCCESS") as done:
        done.write(json.dumps({"shards": count.n}).encode())
    return count.n


def merged_numbers(shards: DataFrame) -> DataFrame:
    """Shards (output, path) with number from 0: place in their output, after all shards of the outputs before."""
    counts = shards.groupBy("output").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("output", F.coalesce(F.sum("_n").over(Window.orderBy("output").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_before"))  # one row for each output
    return shards.join(before, "output").withColumn("number", F.col("_before") + F.row_number().over(Window.partitionBy("output").orderBy("path")) - 1).drop("_before")


def _copier(folder: str):
    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, target = store(folder)
        to.create_dir(target)
        for rows in batches:
            whole = []
            for path, size, number in rows[["path", "size", "number"]].itertuples(index=False, name=None):
                fs, source = store(path)
                name = f"{target.rstrip('/')}/shard-{number:06d}.tar"
                for ending in (".index", ""):
                    if ending and fs.get_file_info(f"{source}{ending}").type != pafs.FileType.File:
                        continue
                    part = f"{target.rstrip('/')}/_{uuid.uuid4().hex}"
                    with fs.open_input_stream(f"{source}{ending}") as data, to.open_output_stream(part) as out:
                        while block := data.read(1 << 20):
                            out.write(block)
                    to.move(part, f"{name}{ending}")
                whole.append(to.get_file_info(name).size == size)
            yield pd.DataFrame({"number": rows["number"].astype("int64"), "whole": whole})

    return copy
