"""Id indexing (I1-I3, I5): string or long keys to dense integer ids.

All rules are deterministic and computed on executors: distinct keys (or
first positions) get global row numbers from ``with_row_number``; maps
are DataFrames joined back, never driver dicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.operators.ordering import with_row_number
from cofilter.operators.products import TASK_ROWS, HotKeys, hot_keys, salted_join


def index_dense(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(col, out): ids 0..n-1 over the distinct keys in key order."""
    out = out or f"{col}_idx"
    keys = df.select(col).distinct()
    numbered, _ = with_row_number(keys, [col], out)
    return numbered.select(col, out)


def index_first_seen(df: DataFrame, col: str, order: str, out: str | None = None) -> DataFrame:
    """(col, out): ids 0..n-1 by first appearance in ``order``."""
    out = out or f"{col}_idx"
    first = df.groupBy(col).agg(F.min(order).alias("_first"))
    numbered, _ = with_row_number(first, ["_first", col], out)
    return numbered.select(col, out)


def index_first_row(df: DataFrame, col: str, order, out: str | None = None) -> DataFrame:
    """(col, out): id = 0-based position of the first row with that key in
    ``order`` over all rows (I3; sparse ids)."""
    out = out or f"{col}_idx"
    order = [order] if isinstance(order, str) else list(order)
    numbered, _ = with_row_number(df.select(col, *[o for o in order if o != col]), order, "_pos")
    return numbered.groupBy(col).agg(F.min("_pos").alias(out))


def encode(df: DataFrame, maps: dict[str, DataFrame], drop_keys: bool = True) -> DataFrame:
    """Replace key columns with ids (I5). Each map is (key, id); a key absent
    from its map drops the row (inner join), as the ALS path needs. Hot keys
    are split inside the join."""
    out = df
    # one count says whether any key can be hot; only then each key is probed, on df itself
    small = df.count() <= TASK_ROWS
    for key, m in maps.items():
        other = next((c for c in out.columns if c != key), key)
        out = salted_join(out, m, key, other, hot=HotKeys(None, 0, 0) if small else hot_keys(df, key))
        if drop_keys:
            out = out.drop(key)
    return out
