"""Statistics of two sides of a corpus, and before/after comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provscan.functions import style
from provscan.operators import ranks

LARGE, SMALL = 0.8, 0.5
Z95 = 1.96
MIN_SIDE = 10
ADVICE = {
    "em_dash_density": "use a comma, full stop or brackets where a dash adds nothing",
    "not_just_but": "state the point without the contrast",
    "delve_family": "say what will be shown instead of announcing it",
    "worth_noting": "cut the opening and state the fact",
    "fast_paced_world": "start with the subject",
    "on_the_other_hand_cascade": "keep one or two of these turns",
    "hedge_double": "keep one qualifier per claim",
    "bold_lead_in": "drop the bold openings or write prose",
    "tricolon_uniform": "vary the number of items in a series",
    "template_heading": "name what the section holds",
    "emoji_heading": "drop the emoji from headings",
    "meta_commentary": "go to the content",
    "paragraph_uniformity": "vary the sentences per paragraph",
    "sentence_uniformity": "alternate short and long sentences",
    "declarative_close": "write the contrast as one plain sentence",
    "here_is_why": "answer directly",
    "comparison_table_symmetry": "use a table only where its columns differ",
    "type_token_ratio": "vary the words at the start",
    "sentence_length_stddev": "let sentence lengths vary more",
    "paragraph_length_stddev": "let paragraph lengths vary more",
    "em_dash_to_comma_ratio": "turn some dashes into commas",
}


def cohens_d(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """(m2 - m1) over the pooled sample deviation; null where neither side varies."""
    pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    return F.when(pooled > 0, (m2 - m1) / F.sqrt(pooled))


def verdict(d: Column, n1: Column, n2: Column) -> tuple[Column, Column, Column]:
    """(low, high, label): the 95 % interval of d and the band that all of it lies in, else inconclusive."""
    both = n1 + n2
    error = F.sqrt(F.try_divide(both, n1 * n2) + F.try_divide(F.pow(d, 2), both) / 2)
    low, high = d - Z95 * error, d + Z95 * error
    band = lambda x: F.when(x >= LARGE, "sufficient").when(x >= SMALL, "inconclusive").otherwise("insufficient")
    return low, high, F.when(band(low) == band(high), band(low)).otherwise("inconclusive")


def effect(scores: DataFrame, side: str, value: str, first, second) -> DataFrame:
    """One row: sizes, means, Cohen's d with its interval and label, AUC, and whether each side has enough.

    AUC and medians come from exact ranks: values are counted per side first,
    so ties, however many, are one row, and only different values are ordered,
    in buckets (``ranks.running``) whose bounds are taken in a pass of its own
    before the query runs. Rows with a null value or another side are passed
    over; without rows of a side what needs it is null.
    """
    rows = scores.where(F.col(side).isin(first, second) & F.col(value).isNotNull()).select((F.col(side) == second).alias("s"), F.col(value).cast("double").alias("x"))
    one, two = F.when(~F.col("s"), F.col("x")), F.when(F.col("s"), F.col("x"))
    moments = rows.agg(*(f(c).alias(f"{name}{i}") for i, c in ((1, one), (2, two)) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp), ("lo", F.min), ("hi", F.max))))
    at = rows.groupBy("x").agg(F.count_if(~F.col("s")).alias("a"), F.count_if("s").alias("b"))
    ranked = ranks.running(at, "x", ["a", "b"], ranks.bounds_of(rows, "x"))
    wins = F.sum(F.col("b") * (F.col("before_a") + F.col("a") / 2))
    placed = ranked.agg(wins.alias("wins"), ranks.median("x", "a").alias("mid1"), ranks.median("x", "b").alias("mid2"))  # one row
    d = cohens_d(F.col("n1"), F.col("m1"), F.col("v1"), F.col("n2"), F.col("m2"), F.col("v2"))
    with_d = moments.withColumns({"cohens_d": d, "p": placed.select(F.struct("wins", "mid1", "mid2")).scalar()}).select("*", "p.*")
    low, high, label = verdict(F.col("cohens_d"), F.col("n1"), F.col("n2"))
    pairs = F.col("n1") * F.col("n2")
    return with_d.select(
        "n1", "n2",
        F.col("m1").alias("mean1"), F.col("m2").alias("mean2"),
        F.col("mid1").alias("median1"), F.col("mid2").alias("median2"),
        F.col("lo1").alias("min1"), F.col("hi1").alias("max1"), F.col("lo2").alias("min2"), F.col("hi2").alias("max2"),
        "cohens_d", low.alias("d_low"), high.alias("d_high"), label.alias("verdict"),
        F.when(pairs > 0, F.col("wins") / pairs).alias("auc"),
        ((F.col("n1") >= MIN_SIDE) & (F.col("n2") >= MIN_SIDE)).alias("enough"),
    )


def pair_up(before: DataFrame, after: DataFrame, path: str = "path") -> DataFrame:
    """(path, before, after): structs of the rows of both sides that share a path."""
    pack = lambda df, name: df.select(F.col(path), F.struct(*(c for c in df.columns if c != path)).alias(name))
    return pack(before, "before").join(pack(after, "after"), path)


def unmatched(one: DataFrame, other: DataFrame, other_skipped: DataFrame | None = None, path: str = "path") -> DataFrame:
    """Paths of ``one`` that ``other`` neither has nor skipped."""
    left = one.select(path).distinct().join(other.select(path), path, "left_anti")
    return left if other_skipped is None else left.join(other_skipped.select(path), path, "left_anti")


def effectiveness(delta: Column) -> Column:
    d = F.round(delta, 4)
    return F.when(d < -0.30, "high").when(d < -0.10, "medium").otherwise("low")


def only_signals(reports: DataFrame, names: list[str], report: str = "report") -> DataFrame:
    """Reports restricted to some signals and scored again."""
    kept = F.filter(F.col(f"{report}.signals"), lambda s: s["name"].isin(names))
    return reports.withColumn(report, F.col(report).withField("signals", kept).withField("score", style.score(kept)))


def compare_pairs(pairs: DataFrame, before: str = "before.report", after: str = "after.report") -> DataFrame:
    """(path, before_score, after_score, delta, effectiveness, remaining, eliminated, introduced, recommendation) of each pair."""
    b, a = F.col(before), F.col(after)
    names = lambda r: F.array_sort(F.array_distinct(F.transform(r["signals"], lambda s: s["name"])))
    delta = F.round(a["score"] - b["score"], 4)
    sure = F.least(*(style.rank(r["confidence"]) for r in (b, a)))
    return pairs.select(
        "path",
        b["score"].alias("before_score"),
        a["score"].alias("after_score"),
        delta.alias("delta"),
        effectiveness(delta).alias("effectiveness"),
        F.array_intersect(names(b), names(a)).alias("signals_remaining"),
        F.array_except(names(b), names(a)).alias("signals_eliminated"),
        F.array_except(names(a), names(b)).alias("signals_introduced"),
        recommend(a["signals"], names(b)).alias("recommendation"),
        F.element_at(F.array(*map(F.lit, style.SEVERITIES)), sure.cast("int")).alias("confidence"),
    )


def recommend(signals: Column, earlier: Column) -> Column:
    """The worst signal left and what to do about it: by severity, then those that survived, then weight, then name."""
    weights = F.create_map(*(F.lit(x) for n, c in style.CATEGORY.items() for x in (n, style.WEIGHT[c])))
    advice = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))
    order = F.transform(signals, lambda s: F.struct((-style.rank(s["severity"])).alias("s"), (~F.array_contains(earlier, s["name"])).alias("new"), (-weights[s["name"]]).alias("w"), s["name"].alias("name"), s["severity"].alias("level")))
    top = F.array_min(order)
    lead = F.when(top["level"] == "high", "").otherwise("No signal of high severity left. ")
    origin = F.when(top["new"], "Introduced").otherwise("Still firing")
    return F.when(F.size(signals) == 0, "No signal left.").otherwise(F.concat(lead, origin, F.lit(": "), top["name"], F.lit(" ("), top["level"], F.lit("): "), advice[top["name"]]))


def signal_deltas(pairs: DataFrame, before: str = "before.report", after: str = "after.report") -> DataFrame:
    """Per signal: files, worst severity and largest value on both sides of all pairs."""
    sides = []
    for name, column in (("before", before), ("after", after)):
        rows = pairs.select("path", F.explode(f"{column}.signals").alias("s")).groupBy("path", F.col("s.name").alias("signal")).agg(F.max(style.rank(F.col("s.severity"))).alias("r"), F.max("s.value").alias("v"))
        level = F.element_at(F.array(*map(F.lit, style.SEVERITIES)), F.max("r").cast("int"))
        sides.append(rows.groupBy("signal").agg(F.count("*").alias(f"files_{name}"), level.alias(f"severity_{name}"), F.max("v").alias(f"value_{name}")))
    joined = sides[0].join(sides[1], "signal", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("signal", zero("files_before"), zero("files_after"), "severity_before", "severity_after", zero("value_before"), zero("value_after"))
