"""The same inspection and scoring on streams: maps over rows, and running summaries with event time.

Reports are row-wise, so a streaming DataFrame passes through the functions of
``provscan.operators`` unchanged. What keeps state is here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provscan.operators.audit import is_actionable


def file_stream(spark: SparkSession, root: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content) of files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob)
    return reader.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(per_trigger)).load(root)


def table_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Rows of a Parquet table, a directory or a single file, as its files arrive; ``like`` has its columns."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target)
    directory, glob = (path, "*.parquet") if status.isDirectory() else path.rsplit("/", 1)
    return spark.readStream.schema(like.schema).option("pathGlobFilter", glob).parquet(directory)


def without_copies(rows: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Rows whose content is new: state for a content hash is dropped once the watermark has passed it."""
    return rows.withWatermark(time, late).withColumn("__hash", F.sha2(F.col(key).cast("binary"), 256)).dropDuplicatesWithinWatermark(["__hash"]).drop("__hash")


def running_summary(items: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Totals of audit items (with a time column) per window and kind."""
    actionable = is_actionable(F.col("has_c2pa"), F.col("findings"))
    return items.withWatermark(time, late).groupBy(F.window(time, window), "kind").agg(
        F.count("*").alias("total"),
        F.count_if("has_c2pa").alias("with_c2pa"),
        F.count_if("has_ai_metadata").alias("with_ai_metadata"),
        F.count_if(F.col("suspicious_total") > 0).alias("with_suspicious_text"),
        F.count_if(actionable).alias("actionable_files"),
    )


def windowed_counts(events: DataFrame, time: str, keys: list[str], value: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, keys, n, total) per tumbling window."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), *keys, "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; results go to Parquet, progress to the checkpoint, so a restart goes on."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Hands each micro-batch to ``work`` and stops when all are done."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
