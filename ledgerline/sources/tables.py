"""Intermediate tables in the folder that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where a session on one machine (master ``local``) names none, as in tests, a folder under the warehouse is used; any
    other session has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir has to name a shared folder when the master is {master}")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/ledgerline-scratch"


def many_tasks(spark: SparkSession) -> int:
    """A number of tasks for work that is long for its bytes. A shuffle to a number that is said is not merged into few tasks by its bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def stored(df: DataFrame, name: str) -> str:
    """Write ``df`` once as Parquet in the shared folder; gives the path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs only a reread, not the work before.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def released(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` has written, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
