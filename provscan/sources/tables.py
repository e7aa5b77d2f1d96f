"""Reading tables with enough partitions to work on."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A small file of one row group would be read, and all that follows computed,
    by a single task. Tables with more splits than cores, as any large one has,
    come back as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, spread over the cores if it is a small one."""
    df = spark.read.parquet(path)
    return spread(df.select(*columns) if columns else df)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; one of our own only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_root()


@functools.cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="provscan-")
