"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most three bits differ in at most one
bit of their upper or of their lower half. Each 32-bit half is covered by the
code Hamming(31, 26) x {0, 1}: a perfect code, so that its covering radius is 1.
A fingerprint is at home at the one anchor within the covering radius of its
half, and is replicated to every anchor within covering radius plus threshold,
1 + 1: at most 17 of 2**27. Linked fingerprints therefore meet at the home
anchor of either, where all 64 bits are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provscan.llm.components import connected_components
from provscan.llm.scratch import Scratch

THRESHOLD = 3
SEED = 42


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """The signed 64-bit SimHash of a whole text; 0 when it holds no word.

    Lower-cases A-Z, splits at ASCII white space, hashes every shingle
    (repeats included; fewer words than a shingle: the whole sequence) by XXH64.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprint_batches(batches):
    for batch in batches:
        texts = batch.column(2).to_pylist()
        marks = np.fromiter((fingerprint(t or b"") for t in texts), dtype=np.int64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks)], names=["id", "of", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, of, fp long) per row: ``of`` is a hash of the text; a null text counts as empty. Ids are of any type with an order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("of"), text.cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, f"id {docs.schema[id_col].dataType.simpleString()}, of long, fp long")


def syndromes(halves: np.ndarray) -> np.ndarray:
    """Hamming(31, 26) syndromes of the low 31 bits: the xor of the numbers 1..31 of the bits set."""
    found = np.zeros(len(halves), dtype=np.int64)
    for bit in range(31):
        found ^= ((halves >> bit) & 1) * (bit + 1)
    return found


def _pairs_by_syndrome() -> np.ndarray:
    """[s, k]: the k-th mask of two bits whose numbers xor to s (15 for each s from 1 to 31)."""
    masks = np.zeros((32, 15), dtype=np.int64)
    for s in range(1, 32):
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        masks[s] = [1 << (i - 1) | 1 << (j - 1) for i, j in pairs]
    return masks


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchors, index of half, all anchors within distance 2) of 32-bit halves.

    Bit 31 is the free coordinate: flipping it costs one of the two steps.
    """
    s = syndromes(halves)
    home = halves ^ np.where(s > 0, np.left_shift(1, np.maximum(s, 1) - 1), 0)
    off = np.flatnonzero(s)
    far = halves[off, None] ^ _pairs_by_syndrome()[s[off]]
    each = np.arange(len(halves))
    return home, np.concatenate([each, each, np.repeat(off, 15)]), np.concatenate([home, home ^ (1 << 31), far.ravel()])


def _halves(fps: np.ndarray):
    unsigned = fps.view(np.uint64)
    yield 0, (unsigned & np.uint64(0xFFFFFFFF)).astype(np.int64)
    yield 1, (unsigned >> np.uint64(32)).astype(np.int64)


def _home_batches(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for which, half in _halves(fps):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(half)[0] | which << 32), pa.array(fps)], names=["anchor", "a"])


def _replica_batches(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for which, half in _halves(fps):
            _, index, reached = anchors(half)
            yield pa.RecordBatch.from_arrays([pa.array(reached | which << 32), pa.array(fps[index])], names=["anchor", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) for every two different fingerprints of ``distinct`` (fp long) at most three bits apart.

    Fingerprints stand for their documents, so copies are never expanded. The
    join is by sorting: adaptive execution splits an anchor that many share.
    """
    home = distinct.mapInArrow(_home_batches, "anchor long, a long")
    replicas = distinct.mapInArrow(_replica_batches, "anchor long, b long")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD)
    met = home.join(replicas.hint("shuffle_merge"), "anchor").where(near)
    return met.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, of, fp) per row, (fp, root) per different fingerprint): the same root is reached over links."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(docs, id_col, text_col), "marked")
    distinct = scratch.write(marked.select("fp").distinct(), "distinct")
    roots = connected_components(links(distinct), scratch)
    return marked, distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the least id that links of near fingerprints reach.

    Rows with equal fingerprints are grouped first, so thousands of copies cost
    one fingerprint in the search. A row with a null id gets a fingerprint and a
    component but never names one (null if nobody else does); a null text counts
    as empty; repeated rows come back as often as they came in; an empty table
    gives an empty result. Only the two named columns are read.
    """
    marked, rooted = _classes(docs, id_col, text_col)
    least = marked.groupBy("fp").agg(F.min("id").alias("least"))  # before the join: a fingerprint may have very many rows
    named = rooted.join(least, "fp")
    components = named.groupBy("root").agg(F.min("least").alias("component"))
    classes = named.join(components, "root").select("fp", "component")
    return marked.join(classes, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the least id, then of the least hash of its text.

    Ids don't decide more than that: texts that share an id stay if their
    classes differ, and of rows without ids, which come last, one stays, too, in a
    class that has no others. Of rows that are alike in id and text one stays.
    Null texts count as empty; an empty table gives an empty result; all columns
    pass through.
    """
    marked, rooted = _classes(docs, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "of")).alias("first")
    kept = marked.groupBy("fp").agg(first).join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(_row_key(F.col("first.id"), F.col("first.of")).alias("__kept"))
    rows = docs.withColumn("__key", _row_key(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    rows = rows.join(kept, F.col("__key") == F.col("__kept"), "left_semi")
    alike = Window.partitionBy("__key").orderBy(F.lit(0))  # as the join has it: no further shuffle
    return rows.withColumn("__n", F.row_number().over(alike)).where("__n = 1").drop("__n", "__key")


def _row_key(id_: Column, of: Column) -> Column:
    """One string of an id, null or not, and the hash of a text."""
    return F.concat(of.cast("string"), F.coalesce(F.concat(F.lit(" "), id_.cast("string")), F.lit("")))
