"""Metrics of text pairs and their aggregation by variant, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provscan.operators import ranks

SHORT = 50  #: stripped characters below which a sample is excluded


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9]+"), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def bigrams(toks: Column) -> Column:
    """Distinct pairs of neighbours."""
    n = F.size(toks)
    pairs = F.zip_with(F.slice(toks, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(toks, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def lexical_divergence(original: Column, candidate: Column) -> Column:
    """1 - Jaccard of bigram sets: 0 for equal or for texts without any bigram, 1 if just one has no token."""

    def of_tokens(t: Column) -> Column:
        sets = F.struct(F.size(t["a"]).alias("a"), F.size(t["b"]).alias("b"), bigrams(t["a"]).alias("x"), bigrams(t["b"]).alias("y"))
        return let(sets, of_sets)

    def of_sets(s: Column) -> Column:
        return let(F.struct(s["a"].alias("a"), s["b"].alias("b"), F.size(F.array_intersect(s["x"], s["y"])).alias("both"), (F.size(s["x"]) + F.size(s["y"])).alias("sum")), of_sizes)

    def of_sizes(n: Column) -> Column:
        lone = (n["a"] == 0) | (n["b"] == 0)
        return F.when(lone, F.when(n["a"] == n["b"], 0.0).otherwise(1.0)).when(n["sum"] == 0, 0.0).otherwise(1 - n["both"] / (n["sum"] - n["both"]))

    return let(F.struct(tokens(original).alias("a"), tokens(candidate).alias("b")), of_tokens)


def kept_share(original: Column, candidate: Column, pattern: str) -> Column:
    """Share of the different matches in ``original`` that ``candidate`` has too; 1 if there are none."""
    found = [F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).alias(n) for n, t in (("a", original), ("b", candidate))]
    return let(F.struct(*found), lambda m: F.when(F.size(m["a"]) == 0, 1.0).otherwise(F.size(F.array_intersect(m["a"], m["b"])) / F.size(m["a"])))


def numbers_preserved(original: Column, candidate: Column) -> Column:
    return kept_share(original, candidate, r"(?U)\d+")


def urls_preserved(original: Column, candidate: Column) -> Column:
    return kept_share(original, candidate, r"(?U)https?://\S+")


def length_ratio(original: Column, candidate: Column) -> Column:
    return F.length(candidate) / F.greatest(F.length(original), F.lit(1))


def token_estimate(text: Column, chars_per_token: float = 4.0) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(max(chars_per_token, 1.0))))


def quality(original: Column, candidate: Column, chars_per_token: float = 4.0) -> Column:
    """Struct of all of these, rounded to four places."""
    return F.struct(
        F.round(lexical_divergence(original, candidate), 4).alias("lexical_divergence"),
        F.round(length_ratio(original, candidate), 4).alias("length_ratio"),
        F.round(numbers_preserved(original, candidate), 4).alias("numbers_preserved"),
        F.round(urls_preserved(original, candidate), 4).alias("urls_preserved"),
        token_estimate(original, chars_per_token).alias("tokens_in"),
        token_estimate(candidate, chars_per_token).alias("tokens_out"),
    )


def select_candidate(df: DataFrame, key: str, index: str, original: str, candidate: str) -> DataFrame:
    """Of each key's candidates the one most diverged, 0.15 less where the length is not within a factor of two; ties to the least index."""
    ratio = F.length(candidate) / F.length(original)
    guard = F.when((F.length(original) > 0) & ((ratio > 2) | (ratio < 0.5)), 0.15).otherwise(0.0)
    scored = df.withColumn("score", lexical_divergence(F.col(original), F.col(candidate)) - guard)
    order = Window.partitionBy(key).orderBy(F.desc("score"), index)
    return scored.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def gate(text: Column, detected: Column) -> Column:
    """Why a sample is left out of the benchmark; null if it is in."""
    return F.when(F.length(F.trim(text)) < SHORT, "watermarked sample too short").when(~F.coalesce(detected, F.lit(False)), "watermarked sample not detected (sanity gate)")


def variants(docs: DataFrame, seeds: list[int], rewrites: list[str], restamp: bool = False) -> DataFrame:
    """One row per document, seed and variant; the grid is a literal, so nothing is joined."""
    names = ["control", "layer-a", *(f"rewrite-{r}" for r in rewrites), *(f"restamp-{r}" for r in rewrites if restamp)]
    grid = F.array(*(F.struct(F.lit(s).alias("seed"), F.lit(v).alias("variant"), F.lit(i).alias("variant_order")) for s in seeds for i, v in enumerate(names)))
    return docs.withColumn("__grid", F.explode(grid)).select("*", "__grid.*").drop("__grid")


def by_variant(rows: DataFrame) -> DataFrame:
    """Aggregates benchmark rows (variant, before_pos, after_pos, cleared, score_before, score_after, quality, attempts, seconds, usd, notes).

    The median is the upper one: the element at n // 2 of the sorted deltas. It
    comes from counts of different deltas, ordered in buckets, so that no task
    sees all rows of a variant. Null deltas are passed over; an empty table
    gives an empty result.
    """
    delta = F.col("score_before") - F.col("score_after")
    mean = lambda c, places=4: F.round(F.avg(c), places)
    found = rows.groupBy("variant").agg(
        F.count("*").alias("n"),
        F.count_if("before_pos").alias("before_positive"),
        F.count_if("after_pos").alias("after_positive"),
        F.count_if("cleared").alias("cleared"),
        mean("score_before").alias("mean_score_before"),
        mean("score_after").alias("mean_score_after"),
        mean(delta).alias("mean_score_delta"),
        mean("quality.lexical_divergence").alias("mean_lexical_divergence"),
        mean("quality.length_ratio").alias("mean_length_ratio"),
        mean("quality.numbers_preserved").alias("mean_numbers_preserved"),
        F.avg("quality.tokens_in").alias("__in"),
        F.avg("quality.tokens_out").alias("__out"),
        mean("attempts", 2).alias("mean_attempts"),
        mean("seconds", 2).alias("mean_seconds"),
        F.round(F.sum(F.coalesce("usd", F.lit(0.0))), 6).alias("est_usd"),
    )
    deltas = rows.where(delta.isNotNull() & F.col("variant").isNotNull()).select("variant", delta.cast("double").alias("d"))
    counted = deltas.groupBy("variant", "d").agg(F.count("*").alias("k"))
    ranked = ranks.running(counted, "d", ["k"], ranks.bounds_of(deltas, "d"), ["variant"])
    middle = ranked.groupBy("variant").agg(F.round(ranks.element("d", "k", F.floor(F.col("all_k") / 2)), 4).alias("median_score_delta"))
    said = rows.select("variant", F.explode("notes").alias("note")).distinct().groupBy("variant").agg(F.sort_array(F.collect_list("note")).alias("notes"))  # as long as the result is
    rate = F.when(F.col("before_positive") > 0, F.col("cleared") / F.col("before_positive"))
    joined = found.join(middle, "variant", "left").join(said, "variant", "left").withColumns(
        {
            "notes": F.coalesce("notes", F.array().cast("array<string>")),
            "clear_rate": F.round(rate, 4),
            "mean_tokens_in": F.round("__in"),
            "mean_tokens_out": F.round("__out"),
            "clears_per_mtok_out": F.when(F.col("__out") > 0, F.round(rate / (F.col("__out") / 1e6), 2)),
        }
    )
    return joined.drop("__in", "__out")
