"""The corpus pipeline: toxicity, near-duplicates, repeated passages, packing.

Every stage takes all rows that its predecessor kept. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provscan.llm import packing, simhash, suffix, toxicity
from provscan.llm.registry import word_vocabulary
from provscan.llm.scratch import Scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; learns from the labels that are not held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each near-duplicate class."""
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte that lies in a 200-byte string which starts elsewhere too; no document goes."""
    found = suffix.deduplicated(docs)
    text = F.coalesce("__kept_text", "text")
    changed = F.col("__kept_text").isNotNull()
    n_chars = F.when(changed, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(text.alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.packed_documents(docs, word_vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("best-fit packing", packed),
]

#: Hashing, tokenizing and learning are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after the other over ``documents``; each stage's rows are written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
