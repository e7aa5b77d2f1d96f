"""What decides whether a query gets through a large table: work a text, and Python objects a batch."""

import hmac
import math
import time
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from provscan.functions import cadence, naturalize, slices, style, watermark
from provscan.functions import unicode as U
from provscan.sources import files


def _seconds(work) -> float:
    found = []
    for _ in range(3):
        began = time.process_time()
        work()
        found.append(time.process_time() - began)
    return min(found)


def test_a_pass_costs_no_more_than_its_text():
    texts = [f"Let's delve into item {i}. It's worth noting that it works." for i in range(300)]
    analyzer, patterns = style.analyzer(), naturalize.Patterns()
    analysed = _seconds(lambda: [analyzer.analyze(t) for t in texts])
    assert _seconds(lambda: [naturalize.naturalize_python(t, analyzer, patterns) for t in texts]) < 7 * analysed


def test_spans_of_a_line_are_those_of_all_kinds():
    line = "`a` [b](c) <i> www.d.e f@g.hi \"j\" k/l deadbee1 M_n oP QR x"
    step = naturalize.Pass(line, frozenset(), [], naturalize.Patterns())
    assert [s[0] for s in step.spans] == ["code", "link", "html", "url", "email", "quote", "path", "hash", "identifier", "identifier", "identifier"]
    assert step.restore(step.lines[0]) == line


def test_chained_digests_are_hmacs():
    for key in (b"", b"key", b"k" * 64, b"k" * 100):
        seed = hmac.digest(key, b"context", "sha256")
        assert watermark.Hmac(key).chained([b"context"], [b"8 bytes."]) == [hmac.digest(seed, b"8 bytes.", "sha256")]


def test_keyed_test_of_texts_needs_no_column_of_tokens(spark):
    df = spark.createDataFrame([("A b c d e f. A b c d e, A B C D E g",), ("KKIİ one two three four",), ("",), (None,)], "t string")
    ids = watermark.simple_tokens(F.col("t"))
    rows = df.select(watermark.detect_ids(ids, "key").alias("a"), watermark.detect_text(F.col("t"), "key").alias("b"), watermark.positions(F.col("t")).alias("p")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[3]["b"] is None and rows[3]["p"] is None
    assert all(r["a"][n] == r["p"][n] for r in rows[:3] for n in ("tokens_total", "skipped_no_context", "skipped_repeated", "counted")) and rows[0]["p"]["skipped_repeated"] > 0
    plan = df.select(watermark.detect(F.col("t"), gumbel={"key": "key"})["gumbel"])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "sha2" not in plan


def test_gamma_tail_with_kept_logarithms():
    logs = []
    for s, n in ((3.0, 2), (700.0, 640), (20.0, 1), (5.0, 9)):
        terms = [k * math.log(s) - math.lgamma(k + 1) for k in range(n)]
        assert math.isclose(watermark.gamma_tail(s, n, logs), min(1.0, math.exp(-s) * sum(map(math.exp, terms))) if s < 600 else watermark.gamma_tail(s, n), rel_tol=1e-9)


def test_literals_are_looked_up_in_python(spark):
    texts = ["We DELVE into a rich\n tapestry.", "Key role", "an\x1cera", "An era", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    low = df.withColumn("low", cadence.squeezed(F.col("text")))
    old = [r[0] for r in low.select(cadence.phrase_matches(F.col("text"), F.col("low"))).collect()]
    assert [r[0] for r in df.withColumn("h", cadence.literals_held(F.col("text"))).select(cadence.phrase_matches(F.col("text"), held=F.col("h"))).collect()] == old
    assert "Contains" not in cadence.report(df)._jdf.queryExecution().optimizedPlan().toString()


def test_suspects_are_told_quickly(spark):
    df = spark.range(1).select(F.concat(F.lit("￼"), F.repeat(F.lit("plain text "), 300_000)).alias("t"))
    df.select(U.suspect(F.col("t"))).collect()
    began = time.time()
    assert df.select(U.suspect(F.col("t"))).collect() == [(False,)]
    assert time.time() - began < 5


def test_few_rows_are_objects_at_once(spark):
    texts, most = pa.array(["x" * 20_000] * 1000), 0

    def work(rows):
        nonlocal most
        most = max(most, len(rows))
        return [len(r) for r in rows]

    tracemalloc.start()
    assert slices.sliced(work, pa.int64(), texts).to_pylist() == [20_000] * 1000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= slices.ROWS and peak < 6e6
    assert slices.sliced(work, pa.int64(), pa.array([], pa.string())).to_pylist() == []
    assert slices.sliced(lambda a, b: [x and x + y for x, y in zip(a, b)], pa.string(), pa.array(["a", None] * 200), pa.array(["b"] * 400)).to_pylist() == ["ab", None] * 200
    for column in (cadence.counts(F.col("t")), style.analyze(F.col("t")), files.html_text(F.col("t"))):
        assert spark.createDataFrame([], "t string").select(column).collect() == []
