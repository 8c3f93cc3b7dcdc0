"""The shared folder, and tables written to it between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; where it is unset, one of our own.

    Only a local session may use a temporary folder of this machine; elsewhere the warehouse, which all machines share, holds it.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidemark.shared.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-") if context.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        spark.conf.set("tidemark.shared.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and a lost executor loses none of it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tidemark_path = path
    return table


def same_table(view: DataFrame, table: DataFrame) -> DataFrame:
    """view, known as the table that it reads, so that `dropped` deletes that."""
    view._tidemark_path = table._tidemark_path
    return view


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._tidemark_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
