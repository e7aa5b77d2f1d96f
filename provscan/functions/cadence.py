"""English cadence: sentence burstiness, lexical diversity and formulaic phrases in one score.

A score is an indicator for review, never a verdict about who wrote a text. The
bands are tuned for English prose; other languages get a notice and low
confidence. Words, sentences and the moving type-token ratio are counted in one
pass in Python, another tells which phrases a text may hold; phrases, tiers and
the score are JVM expressions.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provscan.functions.phrases import CADENCE, cadence_pattern
from provscan.functions.slices import sliced

MIN_WORDS, FULL_WORDS, LONG_WORDS = 30, 100, 150
THRESHOLD = 0.65
WINDOW = 50
NOTICE = "This detector is calibrated for English. Results in other languages may be inaccurate."
ENGLISH = tuple("the and of to is that it for with are this be was by not you have from which they".split())
PORTUGUESE = tuple("que não uma para com dos das os em por mais são foi como isso ele ela mas ou também pelo".split())
COUNTS = "struct<word_count:int,sentence_count:int,measured:int,mean:double,burstiness_cv:double,lexical_diversity:double,en:int,pt:int>"

_WORD, _SENTENCE_END = re.compile(r"\b[\w'-]+\b"), re.compile(r"\n+|(?<=[?!.])\s+")


def sentences_of(text: str) -> list[str]:
    """Sentences of the lines outside ``` fences; a line break ends one too."""
    lines, fenced = [], False
    for line in map(str.strip, text.splitlines()):
        if line.startswith("```"):
            fenced = not fenced
        elif line and not fenced:
            lines.append(line)
    return [s for s in map(str.strip, _SENTENCE_END.split("\n".join(lines))) if s]


def moving_ratio(words: list[str], window: int = WINDOW) -> float:
    """Mean share of different words over all windows; of the whole text where it is no longer than one."""
    n = len(words)
    if n <= window:
        return len(set(words)) / n if n else 0.0
    # A word counts in every window that it is the first of its kind in.
    kinds = {w: k for k, w in enumerate(set(words))}
    codes, at = np.fromiter(map(kinds.__getitem__, words), np.int32, n), np.arange(n)
    order = np.argsort(codes, kind="stable")
    again = codes[order[1:]] == codes[order[:-1]]
    last = np.full(n, -1)
    last[order[1:][again]] = order[:-1][again]
    first = np.maximum(np.maximum(last + 1, at - window + 1), 0)
    total = int(np.maximum(np.minimum(at, n - window) - first + 1, 0).sum())
    return total / window / (n - window + 1)


def burstiness(lengths: list[int]) -> tuple[int, float, float | None]:
    """(sentences with words, their mean, coefficient of variation or None below two)."""
    lengths = [x for x in lengths if x]
    if len(lengths) < 2:
        return len(lengths), float(lengths[0]) if lengths else 0.0, None
    n, total = len(lengths), sum(lengths)
    mean = total / n
    squares = sum((x - mean) ** 2 for x in lengths)
    return n, mean, (squares / (n - 1)) ** 0.5 / mean


_COUNTS_ARROW = [("word_count", pa.int32()), ("sentence_count", pa.int32()), ("measured", pa.int32()), ("mean", pa.float64()), ("burstiness_cv", pa.float64()), ("lexical_diversity", pa.float64()), ("en", pa.int32()), ("pt", pa.int32())]


def counts(text: Column) -> Column:
    """COUNTS of a text; null for null."""

    def run(texts: pa.Array) -> pa.Array:
        english, portuguese = frozenset(ENGLISH), frozenset(PORTUGUESE)
        names = [n for n, _ in _COUNTS_ARROW]

        def row(t: str) -> dict:
            sentences = sentences_of(t)
            parts = list(map(_WORD.findall, sentences))
            # No word crosses white space, so the words of a text without fences are those of its sentences.
            words = list(map(str.lower, _WORD.findall(t) if "```" in t else chain.from_iterable(parts)))
            measured = burstiness(list(map(len, parts)))
            return dict(zip(names, (len(words), len(sentences), *measured, moving_ratio(words), sum(map(english.__contains__, words)), sum(map(portuguese.__contains__, words)))))

        return sliced(lambda rows: [None if t is None else row(t) for t in rows], pa.struct(_COUNTS_ARROW), texts)

    return F.arrow_udf(run, COUNTS)(text)


def squeezed(text: Column) -> Column:
    """Lower case with single spaces: what the literals of the phrases are looked up in."""
    return F.lower(F.regexp_replace(text, "(?U)\\s+", " "))


#: White space as Java's (?U)\\s has it.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def literals_held(text: Column) -> Column:
    """Bit k: whether the squeezed text holds a literal of phrase k; null for null.

    The search of the JVM goes byte by byte, Python's skips ahead.
    """
    literals = [(1 << k, x.split("|")) for k, (_, _, x, _) in enumerate(CADENCE)]

    def row(t: str) -> int:
        low, bits = _SPACES.sub(" ", t).lower(), 0
        for bit, some in literals:
            for x in some:
                if x in low:
                    bits |= bit
                    break
        return bits

    def run(texts: pa.Array) -> pa.Array:
        return sliced(lambda rows: [None if t is None else row(t) for t in rows], pa.int64(), texts)

    return F.arrow_udf(run, "long")(text)


def phrase_matches(text: Column, low: Column | None = None, held: Column | None = None) -> Column:
    """array<struct<phrase,count,weight,samples>> of the phrases found, in table order.

    A pattern runs only where the text holds one of its literals, as ``held``
    (see ``literals_held``) or a substring search in ``low`` (see ``squeezed``) tells.
    """
    low = squeezed(text) if low is None else low
    bits, found = held, []
    for k, (name, weight, literals, spec) in enumerate(CADENCE):
        pattern = F.lit("(?iU)" + cadence_pattern(spec))
        held = reduce(or_, (low.contains(x) for x in literals.split("|"))) if bits is None else bits.bitwiseAND(F.lit(1 << k).cast("long")) != 0
        hits = F.array(F.regexp_extract_all(text, pattern, F.lit(0)))  # as an array of one, so that the search runs once
        told = F.transform(hits, lambda h: F.struct(F.lit(name).alias("phrase"), F.size(h).alias("count"), F.lit(weight).alias("weight"), F.slice(h, 1, 3).alias("samples")))  # noqa: B023
        found.append(F.when(held, told[0]))
    return F.filter(F.array(*found), lambda m: m["count"] > 0)


def tier(value: Column, bounds: list[tuple[float, float]], otherwise: float, below: bool) -> Column:
    """The score of the first bound that ``value`` is below (or reaches)."""
    out = F.lit(otherwise)
    for bound, score in reversed(bounds):
        out = F.when(value < bound if below else value >= bound, F.lit(score)).otherwise(out)
    return out


def burstiness_score(cv: Column) -> Column:
    return F.when(cv.isNotNull(), tier(cv, [(0.25, 0.95), (0.35, 0.80), (0.45, 0.50), (0.55, 0.25)], 0.05, True))


def density_score(density: Column) -> Column:
    return F.when(density > 0, tier(density, [(2.0, 1.0), (1.0, 0.75), (0.5, 0.45)], 0.20, False)).otherwise(0.0)


def diversity_score(ratio: Column) -> Column:
    return F.when(ratio.between(0.68, 0.76), 0.4).otherwise(0.1)


def composite(words: Column, cv: Column, density: Column, ratio: Column) -> Column:
    """Score from 0 to 1; without a measurable burstiness the other parts are scaled up, short texts damped."""
    b, n, d = burstiness_score(cv), density_score(density), diversity_score(ratio)
    raw = F.when(b.isNull(), (n * 0.45 + d * 0.10) / 0.55).otherwise(b * 0.45 + n * 0.45 + d * 0.10)
    damp = F.when(words < FULL_WORDS, 0.4 + 0.6 * ((words - MIN_WORDS) / F.lit(FULL_WORDS - MIN_WORDS))).otherwise(1.0)
    return F.when(words < MIN_WORDS, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw * damp)))


def level(score: Column) -> Column:
    return F.when(score >= 0.75, "HIGH").when(score >= 0.5, "MEDIUM").when(score >= 0.25, "LOW").otherwise("CLEAN")


def language(en: Column, pt: Column) -> Column:
    return F.when((F.greatest(en, pt) < 3) | (en == pt), "unknown").when(en > pt, "en").otherwise("pt")


def report(df: DataFrame, text_col: str = "text", out: str = "cadence") -> DataFrame:
    """``df`` with a struct column of the whole report; null where the text is null."""
    c = F.col("__counts")
    with_parts = df.withColumns({"__counts": counts(F.col(text_col)), "__held": literals_held(F.col(text_col))})
    with_parts = with_parts.withColumn("__phrases", phrase_matches(F.col(text_col), held=F.col("__held")))
    short = c["word_count"] < MIN_WORDS
    total = F.aggregate("__phrases", F.lit(0.0), lambda done, m: done + m["count"] * m["weight"])
    with_parts = with_parts.withColumn("__density", F.when(short, 0.0).otherwise(total / (c["word_count"] / 100.0)))
    cv = F.when(~short, c["burstiness_cv"])
    score = composite(c["word_count"], cv, F.col("__density"), c["lexical_diversity"])
    spoken = language(c["en"], c["pt"])
    said = F.transform("__phrases", lambda m: F.when(short, F.format_string("AI phrase marker '%s' found (%dx)", m["phrase"], m["count"])).otherwise(F.format_string("AI cadence phrase '%s' (%dx)", m["phrase"], m["count"])))
    uniform = F.when((cv < 0.35) & (c["sentence_count"] >= 3), F.format_string("Unnaturally uniform sentence cadence (CV=%.2f < 0.35)", cv))
    dense = F.when(F.col("__density") >= 1.0, F.format_string("Elevated AI formulaic transition density (%.2f/100w)", F.col("__density")))
    parts = F.struct(
        c["word_count"].alias("word_count"),
        c["sentence_count"].alias("sentence_count"),
        cv.alias("burstiness_cv"),
        c["lexical_diversity"].alias("lexical_diversity"),
        F.col("__density").alias("ai_ngram_density"),
        F.col("__phrases").alias("matched_markers"),
        score.alias("score"),
        level(score).alias("confidence_level"),
        F.when(short, "insufficient_length").otherwise("ok").alias("status"),
        spoken.alias("language"),
        F.when((spoken == "en") & ~short & (c["word_count"] >= LONG_WORDS), "medium").otherwise("low").alias("confidence"),
        F.when(spoken != "en", NOTICE).alias("notice"),
        F.concat(said, F.array_compact(F.array(uniform, dense))).alias("findings"),
    )
    return with_parts.withColumn(out, F.when(F.col(text_col).isNotNull(), parts)).drop("__counts", "__held", "__phrases", "__density")
