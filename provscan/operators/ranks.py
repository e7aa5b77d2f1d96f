"""Running counts and medians over an order, without gathering a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def bounds_of(rows: DataFrame, order: str, buckets: int = BUCKETS) -> list[float]:
    """Approximate quantiles of ``order``: at most ``buckets`` - 1 numbers, from one pass without a shuffle of rows."""
    found = rows.approxQuantile(order, [k / buckets for k in range(1, buckets)], 0.5 / buckets)
    return sorted({float(x) for x in found})


def bucket_of(order: str, bounds: list[float]) -> Column:
    """How many bounds a value exceeds: a function of the value alone, so every plan that uses it agrees."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order)))


def running(at: DataFrame, order: str, counts: list[str], bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """``at`` with before_<count> and all_<count> for each of ``counts``: their sums over lesser rows of the group, and over all.

    ``at`` has one row per group and value. Rows are summed inside buckets of
    ``bounds`` first; only the buckets' totals, at most len(bounds) + 1 a
    group, are summed in one place. Groups are the values of ``by``, not null.
    """
    by = by or []
    held = at.withColumn("__p", bucket_of(order, bounds))
    totals = held.groupBy(*by, "__p").agg(*(F.sum(c).alias(f"__t_{c}") for c in counts))
    whole = Window.partitionBy(*by, F.lit(0))
    earlier = whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = totals.select(*by, "__p", *(x for c in counts for x in (zero(F.sum(f"__t_{c}").over(earlier)).alias(f"__o_{c}"), F.sum(f"__t_{c}").over(whole).alias(f"all_{c}"))))
    inside = Window.partitionBy(*by, "__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = held.withColumns({f"__i_{c}": zero(F.sum(c).over(inside)) for c in counts})
    joined = ranked.join(offsets, [*by, "__p"])
    return joined.withColumns({f"before_{c}": F.col(f"__o_{c}") + F.col(f"__i_{c}") for c in counts}).drop("__p", *(f"__{k}_{c}" for k in "io" for c in counts))


def element(order: str, count: str, index: Column) -> Column:
    """Aggregate of ``running`` rows: the value at a 0-based place of the sorted, repeated values."""
    holds = (F.col(f"before_{count}") <= index) & (index < F.col(f"before_{count}") + F.col(count))
    return F.max(F.when(holds, F.col(order)))


def median(order: str, count: str) -> Column:
    """Aggregate of ``running`` rows: the exact median (mean of the middle two)."""
    n = F.col(f"all_{count}")
    return (element(order, count, F.floor((n - 1) / 2)) + element(order, count, F.floor(n / 2))) / 2
