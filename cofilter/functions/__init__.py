"""Column expressions used across the operators (all built-in, JVM-side)."""

from cofilter.functions.scalar import (  # noqa: F401
    inv_sqrt,
    log_scale,
    log_scale_col,
    md5_order_key,
    round_score,
    squared_error,
    TIE_DIGITS,
    OUT_DIGITS,
)
