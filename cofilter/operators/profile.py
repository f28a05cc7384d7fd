"""Profiling (A1-A4): summaries, shape, distinct counts, value histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.operators.matrix import materialize
from cofilter.operators.selection import kth_values

QUANTILES = (0.25, 0.5, 0.75)


def exact_quantiles(df: DataFrame, col: str, qs=QUANTILES) -> dict[float, float | None]:
    """Linearly interpolated quantiles (pandas / quantile_cont rule) from the at
    most two values per quantile at the wanted ranks, which are found by counting
    (``selection``). ``percentile`` would hold every distinct value in one task."""
    vals = df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    n = vals.count()
    if n == 0:
        return {q: None for q in qs}
    want = {}
    for q in qs:
        h = q * (n - 1)
        lo = int(h // 1)
        want[q] = (h, lo, min(lo + 1, n - 1))
    got = kth_values(vals, "_v", sorted({p for _, lo, hi in want.values() for p in (lo, hi)}))
    return {q: got[lo] + (h - lo) * (got[hi] - got[lo]) if got[hi] != got[lo] else got[lo] for q, (h, lo, hi) in want.items()}


def describe(df: DataFrame, col: str) -> DataFrame:
    """One row: count, mean, std (sample), min, p25, p50, p75, max (A1)."""
    df = materialize(df, (col,))  # read by every pass
    qv = exact_quantiles(df, col)
    base = df.agg(F.count(col).alias("count"), F.avg(col).alias("mean"),
                  F.stddev_samp(col).alias("std"),
                  F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"))
    lit = {name: F.lit(qv[q]).cast("double") for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))}
    return base.select("count", "mean", "std", "min", lit["p25"].alias("p25"),
                       lit["p50"].alias("p50"), lit["p75"].alias("p75"), "max")


def shape(df: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """(n_rows, n_columns, n_users, n_items) (A2, A3)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.countDistinct(user).alias("n_users"),
                  F.countDistinct(item).alias("n_items")) \
        .withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Exact (or HyperLogLog++) distinct counts per column (A3)."""
    f = F.approx_count_distinct if approx else F.countDistinct
    return df.agg(*[f(c).alias(f"n_{c}") for c in cols])


def value_histogram(df: DataFrame, value: str) -> DataFrame:
    """Non-null count of every other column per ``value`` (A4)."""
    others = [c for c in df.columns if c != value]
    return df.groupBy(value).agg(*[F.count(c).alias(f"n_{c}") for c in others])
