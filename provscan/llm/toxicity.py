"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates let a rare insult be learnt as fast as a common
word, and the L1 term keeps a coordinate at zero until its evidence outweighs
it, so a model is a few thousand (index, weight) pairs: small enough to send to
every task, whatever the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 20  #: coordinates: 2**BITS hashed features, and one more for the bias
MAX_ROWS = 10_000  #: labelled rows a model is fitted on at most
EPOCHS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
_SPACED = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def hashed(text: bytes) -> np.ndarray:
    """Coordinates of all words, pairs of neighbours and pairs one word apart, repeats included."""
    words = text.translate(_SPACED).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    pairs = h[:-1] * np.uint32(0x9E3779B1) + h[1:] * np.uint32(0x85EBCA77) + np.uint32(1)
    skips = h[:-2] * np.uint32(0xC2B2AE3D) + h[2:] * np.uint32(0x27D4EB2F) + np.uint32(2)
    return (np.concatenate([h, pairs, skips]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def fit_ftrl(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) other than zero, the bias at 2**BITS, after EPOCHS passes over (coordinates, label)."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1
    l1 = np.full(size, L1)
    l1[bias] = 0.0

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1[at], 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for at, label in rows:
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size))
    at = np.flatnonzero(w)
    return at, w[at]


def _feature_batches(batches):
    for batch in batches:
        features = [np.append(np.unique(hashed(t or b"")), np.uint32(1 << BITS)).astype(np.int32) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.list_(pa.int32()))], names=["at", "label", "features"])


def _fit_batches(batches):
    rows = []
    for batch in batches:
        labels, features = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
        rows += zip(map(np.asarray, features), labels)
    at, w = fit_ftrl(rows) if rows else (np.zeros(0, np.int64), np.zeros(0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["index", "weight"])


def held_out(id_col: str):
    """Rows whose labels are never learnt from: crc32 of the id as text (null: empty) is divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS):
    """(indices, weights) learnt from at most ``max_rows`` labelled rows that are not held out, least hash of the id first.

    Rows whose label or id is null are passed over; of several labels of one id
    the greatest counts, of several documents of one id the one whose text has
    the least hash, so ``max_rows`` bounds what the one fitting task reads,
    however often an id is repeated. Without labelled rows the model is empty
    and scores 0.5.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    order = F.xxhash64("__id", F.lit("fit"))
    sample = known.orderBy(order, "__id").limit(max_rows)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    held = texts.join(F.broadcast(sample), "__id")
    # Cut to one row an id in the map tasks already, before texts are shuffled.
    first = Window.partitionBy("__id").orderBy(F.xxhash64("__text"), "__text")
    held = held.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    rows = held.select(order.alias("at"), F.col("__label").alias("label"), "__text")
    featured = rows.mapInArrow(_feature_batches, "at long, label int, features array<int>")
    model = featured.repartition(1).sortWithinPartitions("at").mapInArrow(_fit_batches, "index long, weight double").toPandas()
    return model["index"].to_numpy(), model["weight"].to_numpy()


def _score_batches(index: np.ndarray, weight: np.ndarray):
    def run(batches):
        dense = np.zeros((1 << BITS) + 1)
        dense[index] = weight
        active = dense != 0
        bias = dense[-1]
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                at = hashed(text or b"")
                scores.append(bias + dense[np.unique(at[active[at]])].sum())
            scores = 1.0 / (1.0 + np.exp(-np.clip(np.array(scores, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return run


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row's whole text; a null or empty text gets the bias alone.

    Null and repeated ids and repeated rows are scored like any others; an
    empty table gives an empty result; only the two named columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_score_batches(*model), f"id {kind}, score double")


def _filter_batches(text_col: str, index: np.ndarray, weight: np.ndarray, threshold: float):
    scored = _score_batches(index, weight)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            both = pa.RecordBatch.from_arrays([texts, texts], names=["id", "text"])
            clean = [s < threshold for s in next(scored([both])).column(1).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all their columns as they were."""
    return docs.mapInArrow(_filter_batches(text_col, *model, threshold), docs.schema)
