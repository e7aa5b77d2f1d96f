"""Ranks over many different values against numpy, and the optional import of the driver's contract."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from provscan.operators import corpus, pairwise, ranks


def midranks(first, second):
    """AUC of ``second`` over ``first``, ties counting half."""
    ordered = np.sort(first)
    low, high = np.searchsorted(ordered, second, "left"), np.searchsorted(ordered, second, "right")
    return float((low + high).sum() / 2 / len(first) / len(second))


def test_auc_of_a_million_values_is_exact_and_stable(spark):
    n = 1_000_000
    x = F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / F.lit(float(1 << 52)) + F.when(F.col("id") % 2 == 0, 0.03).otherwise(0.0)
    rows = spark.range(n).select((F.col("id") % 2).alias("side"), x.alias("x")).repartition(7)
    local = rows.toPandas()
    first, second = (local.x[local.side == s].to_numpy() for s in (0, 1))
    want = (midranks(first, second), float(np.median(first)), float(np.median(second)))
    runs = [corpus.effect(rows, "side", "x", 0, 1).select("auc", "median1", "median2").first() for _ in range(2)]
    assert tuple(runs[0]) == tuple(runs[1]) == pytest.approx(want, abs=1e-12)


def test_effect_of_odd_tables(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, None), (1, 2.0), (None, 3.0), (2, 9.0)], "side int, x double")
    one = corpus.effect(rows, "side", "x", 0, 1).first()
    assert (one["n1"], one["n2"], one["auc"], one["median1"], one["median2"]) == (1, 1, 1.0, 1.0, 2.0)
    none = corpus.effect(rows.where("false"), "side", "x", 0, 1).first()
    assert none["n1"] == 0 and none["auc"] is None and none["median1"] is None
    lone = corpus.effect(rows.where("side = 0"), "side", "x", 0, 1).first()
    assert lone["n2"] == 0 and lone["auc"] is None and lone["median1"] == 1.0


def test_running_per_group(spark):
    rng = np.random.default_rng(2)
    data = {(g, float(v)): int(rng.integers(0, 4)) for g in "ab" for v in rng.choice(500, 200, replace=False)}
    df = spark.createDataFrame([(g, v, n) for (g, v), n in data.items()], "g string, v double, n long")
    got = {(r["g"], r["v"]): (r["before_n"], r["all_n"]) for r in ranks.running(df, "v", ["n"], ranks.bounds_of(df, "v", 8), ["g"]).collect()}
    for g, v in data:
        assert got[g, v] == (sum(k for (h, w), k in data.items() if h == g and w < v), sum(k for (h, _), k in data.items() if h == g))


def test_variants_without_rows_of_one_in_one_task(spark):
    zero = F.lit(0.0)
    quality = F.struct(*(zero.alias(c) for c in ("lexical_divergence", "length_ratio", "numbers_preserved", "tokens_in", "tokens_out")))
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("variant"), F.lit(True).alias("before_pos"), F.lit(False).alias("after_pos"), F.lit(True).alias("cleared"),
        F.when(F.col("id") % 5 > 0, F.col("id") * 0.5).alias("score_before"), zero.alias("score_after"), quality.alias("quality"),
        F.lit(1).alias("attempts"), zero.alias("seconds"), zero.alias("usd"), F.when(F.col("id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"))).alias("notes"),
    )
    found = pairwise.by_variant(rows)
    got = {r["variant"]: (r["median_score_delta"], r["notes"]) for r in found.collect()}
    for name, keep in (("a", lambda i: i % 3 == 0), ("b", lambda i: i % 3 > 0)):
        deltas = sorted(i * 0.5 for i in range(2000) if keep(i) and i % 5)
        assert got[name] == (deltas[len(deltas) // 2], ["x", "y"])
    assert pairwise.by_variant(rows.where("false")).count() == 0


@pytest.mark.parametrize("missing", ["provscan.llm", "corpus_pipeline", "ahocorasick"])
def test_entry_without_the_optional_part(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; names = set(e.queries()); assert 'corpus_effect' in names and 'pipeline' not in names and set(e.oracle_sql()) <= names"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
