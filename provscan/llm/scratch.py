"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a Parquet table and reading it
back, so that a lost executor costs no more than the tasks it was running.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from provscan.sources.tables import shared_root


class Scratch:
    """Tables of one operator run. ``drop`` removes a table no later step reads; the rest go at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def write(self, df: DataFrame, name: str, dictionaries: bool = True) -> DataFrame:
        """``df`` written and read again; without ``dictionaries`` where hardly a value comes twice."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("parquet.enable.dictionary", str(dictionaries).lower()).parquet(path)
        # The JVM frees shuffle files only when their owner is collected.
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session has ended; nothing is left to call
            pass
