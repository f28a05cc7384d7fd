"""The user x item matrix R in sparse long form.

R is never materialised dense: a cell is a row (user, item, value); a
missing row is a zero. Row and column sums are plain grouped sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.functions.scalar import inv_sqrt
from cofilter.session import written


def last_write(rows: DataFrame, keys=("user_id", "item_id"), value: str = "counts",
               order=("src_ord", "row_no")) -> DataFrame:
    """Keep the last written value per key in source order (W2). A grouped
    ``max_by`` is a declarative aggregate: partial per task, then final, so a
    hot key never gathers its rows in one place."""
    return (rows.groupBy(*keys)
            .agg(F.max_by(F.col(value), F.struct(*[F.col(c) for c in order])).alias(value)))


def build_matrix(rows: DataFrame, keys=("user_id", "item_id"), value: str = "counts",
                 order=None) -> DataFrame:
    """R from triples (M1). Duplicate cells keep the last written value when
    an order is given; without an order the triples must already be unique.
    Zero cells are dropped (they are implicit)."""
    m = last_write(rows, keys, value, order) if order else rows.select(*keys, value)
    return m.filter(F.col(value) != 0)


def row_sums(R: DataFrame, key: str = "user_id", value: str = "counts", out: str = "p") -> DataFrame:
    return R.groupBy(key).agg(F.sum(value).alias(out))


def degree_norms(R: DataFrame, user: str = "user_id", item: str = "item_id",
                 value: str = "counts") -> DataFrame:
    """(side, key, total, inv_sqrt) for users (row sums P) and items (column
    sums Q), with the zero-guarded inverse square root (A6, P6)."""
    p = R.groupBy(F.col(user).alias("key")).agg(F.sum(value).alias("total")) \
        .withColumn("side", F.lit("user"))
    q = R.groupBy(F.col(item).alias("key")).agg(F.sum(value).alias("total")) \
        .withColumn("side", F.lit("item"))
    both = p.unionByName(q)
    return both.select("side", "key", "total", inv_sqrt("total").alias("inv_sqrt"))


def pivot_matrix(R: DataFrame, user: str = "user_id", item: str = "item_id",
                 value: str = "counts", items: list | None = None) -> DataFrame:
    """Wide view (M2), one column per item, zero-filled. Only for small item
    sets: Spark refuses more than spark.sql.pivotMaxValues distinct values
    when ``items`` is not given, instead of silently truncating."""
    g = R.groupBy(user)
    g = g.pivot(item, items) if items is not None else g.pivot(item)
    wide = g.agg(F.first(value))
    cols = [c for c in wide.columns if c != user]
    return wide.select(user, *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in cols])


def transpose(R: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Rᵀ with the same column names (rows become items)."""
    return R.select(F.col(item).alias(user), F.col(user).alias(item),
                    *[c for c in R.columns if c not in (user, item)])


def materialize(R: DataFrame, cols=("user_id", "item_id", "counts")) -> DataFrame:
    """Compute R once and cut its lineage: a model reads R five or six times
    (norms, both sides of the self-join, the scoring join); without this
    each read would rescan and re-aggregate the source. Written to the shared folder
    as compressed columns, so a lost executor does not lose it."""
    return written(R.select(*cols), "matrix")
