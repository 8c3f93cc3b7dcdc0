"""Reading lakes of daily files, registries, predictions and tar shards."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.book import date_of_file
from tidemark.sources import tars



def read_lake(spark: SparkSession, folder: str, columns: list[str] | None = None, corrupt: bool = False) -> DataFrame:
    """All Parquet files below a folder with file_date, the date that their name starts with. Of `columns`, those that exist are read."""
    reader = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).option("ignoreCorruptFiles", corrupt)
    table = reader.parquet(folder)
    kept = [c for c in columns if c in table.columns] if columns else table.columns
    return table.select(*kept, date_of_file(F.col("_metadata.file_name")).alias("file_date"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.parquet(*paths)


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder, by Spark's own file systems."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length")


def first_rows(table: DataFrame, order: list[str], n: int = 1_000_000) -> DataFrame:
    return table.orderBy(*order).limit(n)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or JSON records if the name says so."""
    return spark.read.option("multiLine", True).json(path) if path.endswith(".json") else spark.read.parquet(path)


def read_chunks(spark: SparkSession, folder: str, pattern: str = "chunk_*.parquet") -> DataFrame:
    """The chunk files of a folder as one table."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{pattern}")


def united(tables: list[DataFrame]) -> DataFrame:
    """Tables of the same columns, in any order, as one; an error names what a table has or lacks."""
    for i, table in enumerate(tables):
        if odd := set(table.columns) ^ set(tables[0].columns):
            raise ValueError(f"table {i} has other columns: {', '.join(sorted(odd))}")
    return reduce(DataFrame.unionByName, tables)


def _object(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON object as a row of one, or None where there is no such file."""
    try:
        return spark.read.option("multiLine", True).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_report(spark: SparkSession, folder: str, results: str = "results.json", meta: str = "meta.json") -> DataFrame:
    """The results of a run as one row, with the values of its meta file, which lies in the same folder or, where it doesn't, in the one above. Without one the results stand alone; a value that both have is the results'."""
    found = _object(spark, f"{folder.rstrip('/')}/{results}")
    if found is None:
        raise FileNotFoundError(f"{folder} has no {results}")
    places = (folder.rstrip("/"), folder.rstrip("/").rpartition("/")[0])
    extra = next((m for m in (_object(spark, f"{place}/{meta}") for place in places) if m is not None), None)
    return found if extra is None else found.join(F.broadcast(extra.drop(*found.columns)))  # one row with one row


def read_registry(spark: SparkSession, path: str, global_key: str = "__GLOBAL__") -> DataFrame:
    """(symbol, c) of a JSON object of coefficients; the global one is left out, and read by `global_friction`."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("symbol", "c"))
    return pairs.filter(F.col("symbol") != global_key)


def global_friction(spark: SparkSession, path: str, default: float, global_key: str = "__GLOBAL__") -> float:
    value = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>")[global_key].alias("c")).first().c
    return default if value is None else value


def read_equity(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_tar_ranges(spark: SparkSession, folder: str, columns: list[str] | None = None, pattern: str = "*.tar", split_bytes: int = tars.SPLIT_BYTES, task_bytes: int = tars.TASK_BYTES) -> DataFrame:
    """Samples of tar shards by byte ranges, from a folder that Arrow's file systems reach; only members that the columns need are read."""
    fields = [f for f in tars.SCHEMA.split(", ") if columns is None or f.split()[0] in columns]
    return tars.registered(spark).read.format("tar_shards").schema(", ".join(fields)).option("pattern", pattern).option("split_bytes", split_bytes).option("task_bytes", task_bytes).load(folder)


def read_tar_shards(spark: SparkSession, folder: str, pattern: str = "*.tar") -> DataFrame:
    """Samples of tar shards: members grouped by key, the array (.npy) as shape and flat values, the record (.json) as text.

    A shard that can't be read gives one row with corrupt set, so that it is seen; an empty one gives none. Shards go to tasks whole, through Spark's file systems; `read_tar_ranges` reads parts of them.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                samples: dict[str, dict] = {}
                broken = False
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as shard:
                        for member in shard:
                            key, _, kind = member.name.partition(".")
                            sample = samples.setdefault(key, {"shape": None, "values": None, "meta": None})
                            data = shard.extractfile(member).read()
                            if kind.endswith("npy"):
                                array = np.load(io.BytesIO(data), allow_pickle=False)
                                sample["shape"], sample["values"] = list(array.shape), array.astype(np.float32).ravel()
                            elif kind.endswith("json"):
                                sample["meta"] = json.dumps(json.loads(data))
                except (tarfile.TarError, ValueError, EOFError):
                    broken = len(content) > 0
                rows = [(path, key, s["shape"], s["values"], s["meta"], False) for key, s in samples.items()] + [(path, None, None, None, None, True)] * broken
                yield pd.DataFrame(rows, columns=["path", "key", "shape", "values", "meta", "corrupt"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInPandas(unpack, tars.SCHEMA)
