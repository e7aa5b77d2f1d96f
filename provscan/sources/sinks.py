"""Writing reports: JSON lines, CSV, Markdown and SARIF. Each writes a new directory through Spark's committer."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provscan.operators.audit import RULES, sarif_results


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Flat columns with a header; nested ones as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("errorifexists").option("header", "true").csv(path)


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("-")), r"[|\x00-\x1f]", " ") for c in cells)), F.lit(" |"))


def write_markdown(df: DataFrame, path: str, title: str) -> None:
    """A table of a small report, in one file."""
    spark = df.sparkSession
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines = df.select(markdown_row(*(F.col(c) for c in df.columns)).alias("value"))
    top = spark.createDataFrame([("\n".join(head),)], "value string")
    top.unionByName(lines).coalesce(1).write.mode("errorifexists").text(path)


def sarif_result_json(items: DataFrame) -> DataFrame:
    """(value): one SARIF 2.1.0 result object per finding."""
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation")).alias("physicalLocation"))
    rows = sarif_results(items)
    return rows.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def write_sarif(items: DataFrame, path: str, name: str = "provscan", version: str = "1.0.0") -> None:
    """A directory whose parts, read in order, are one SARIF 2.1.0 file: a head, results, a tail.

    Results stay distributed: each part but the ends holds a task's results.
    """
    rules = [{"id": i, "name": n, "shortDescription": {"text": t}, "defaultConfiguration": {"level": level}} for i, (n, level, t) in RULES.items()]
    driver = dict(name=name, version=version, rules=rules)
    head = dict([("$schema", "https://json.schemastore.org/sarif-2.1.0.json"), ("version", "2.1.0"), ("runs", [dict(tool=dict(driver=driver), results=[])])])
    start, end = json.dumps(head)[:-4], "]}]}"
    spark = items.sparkSession
    one = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    # A comma before every result but the first.
    rest = sarif_result_json(items).withColumn("__id", F.monotonically_increasing_id())
    least = rest.agg(F.min("__id")).scalar()
    lines = rest.select(F.when(F.col("__id") == least, F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    one(start).unionByName(lines).unionByName(one(end)).write.mode("errorifexists").text(path)
