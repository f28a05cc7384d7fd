"""Scalar column expressions.

Everything here is a plain ``pyspark.sql.functions`` expression so it stays
inside whole-stage codegen. ANSI mode is on in Spark 4, so divisions and
square roots are guarded instead of relying on NULL-on-error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits used before ranking / tie-breaking on scores, and on output.
TIE_DIGITS = 9
OUT_DIGITS = 6


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def log_scale_col(col) -> Column:
    """ln(1 + x)."""
    return F.log1p(_c(col))


def log_scale(df: DataFrame, col: str = "counts", out: str | None = None) -> DataFrame:
    """Replace (or add as ``out``) a column with ln(1 + x)."""
    return df.withColumn(out or col, log_scale_col(col))


def inv_sqrt(col) -> Column:
    """x = 0 -> 0, else 1/sqrt(x); zero-guarded so empty rows/columns score 0."""
    c = _c(col)
    return F.when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0) / F.sqrt(c))


def squared_error(actual, predicted) -> Column:
    d = _c(actual) - _c(predicted)
    return d * d


def round_score(col, digits: int = OUT_DIGITS) -> Column:
    return F.round(_c(col), digits)


def md5_order_key(cols: list[str], seed) -> Column:
    """Seeded pseudo-random but engine-independent order key: md5 of the
    keys and the seed joined by '|'."""
    parts = [F.col(c).cast("string") for c in cols] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts))
