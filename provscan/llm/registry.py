"""The queries of this subpackage by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provscan.llm import avi, bpe, hnsw, packing, preferences, sharding, simhash, suffix, toxicity, urls
from provscan.sources.tables import read_table


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", list(columns) or None)


def word_vocabulary() -> str:
    """Path of the vocabulary that the registered queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.round_trips(_table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents", "doc_id", "text"), word_vocabulary()).withColumnRenamed("id", "doc_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents", "doc_id", "text"), word_vocabulary()).withColumnRenamed("id", "doc_id")


def op5_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents", "doc_id", "text"), sharding.topology(8), sharding.topology(9))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return hnsw.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages", "page_id", "url")).withColumnRenamed("id", "page_id")


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.deduplicated(_table(spark, sf_dir, "documents", "doc_id", "text"))
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    return found.select("doc_id", *(F.col(f"__{c}").alias(c) for c in names))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation up to its last answer, against the same with the turn before echoed as the answer."""
    chosen, rejected = preferences.echo_pairs(_table(spark, sf_dir, "conversations"), "conv_id")
    found = preferences.format_pairs(chosen, rejected, "conv_id")

    def spans(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias(c)

    return found.select("conv_id", "prompt", "prompt_turns", "chosen", spans("chosen_mask"), "rejected", spans("rejected_mask"))


QUERIES = {"op1_motion_jpeg": op1_motion_jpeg, "op2_best_fit": op2_best_fit, "op3_simhash": op3_simhash, "op4_bpe": op4_bpe, "op5_hash_tree": op5_hash_tree, "op6_toxicity": op6_toxicity, "op7_hnsw": op7_hnsw, "op8_url_filter": op8_url_filter, "op9_suffix": op9_suffix, "op10_preferences": op10_preferences}

_ORACLE_10 = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations),
l AS (SELECT *, max(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY conv_id) AS last,
             lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY pos) AS echo FROM t),
b AS (SELECT conv_id, pos, role, text AS c, CASE WHEN pos = last THEN echo ELSE text END AS r
      FROM l WHERE last IS NULL OR pos <= last),
d AS (SELECT *, coalesce(min(CASE WHEN c <> r THEN pos END) OVER (PARTITION BY conv_id) - 1, count(*) OVER (PARTITION BY conv_id)) AS lcp FROM b),
o AS (SELECT *, length('<|' || role || '|>' || chr(10)) AS head,
        coalesce(sum(CASE WHEN pos > lcp THEN length('<|' || role || '|>' || chr(10) || c || '<|end|>' || chr(10)) END)
          OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_at,
        coalesce(sum(CASE WHEN pos > lcp THEN length('<|' || role || '|>' || chr(10) || r || '<|end|>' || chr(10)) END)
          OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r_at
      FROM d)
SELECT conv_id,
  coalesce(string_agg(CASE WHEN pos <= lcp THEN '<|' || role || '|>' || chr(10) || c || '<|end|>' || chr(10) END, '' ORDER BY pos), '') AS prompt,
  CAST(any_value(lcp) AS BIGINT) AS prompt_turns,
  coalesce(string_agg(CASE WHEN pos > lcp THEN '<|' || role || '|>' || chr(10) || c || '<|end|>' || chr(10) END, '' ORDER BY pos), '') AS chosen,
  coalesce(string_agg(CASE WHEN pos > lcp AND role = 'assistant' THEN CAST(CAST(c_at + head AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(c_at + head + length(c) + 7 AS BIGINT) AS VARCHAR) END, ',' ORDER BY pos), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN pos > lcp THEN '<|' || role || '|>' || chr(10) || r || '<|end|>' || chr(10) END, '' ORDER BY pos), '') AS rejected,
  coalesce(string_agg(CASE WHEN pos > lcp AND role = 'assistant' THEN CAST(CAST(r_at + head AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(r_at + head + length(r) + 7 AS BIGINT) AS VARCHAR) END, ',' ORDER BY pos), '') AS rejected_mask
FROM o GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op10_preferences": _ORACLE_10}
