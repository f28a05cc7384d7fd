"""Set operations on interaction pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.operators.indexing import index_first_seen


def union_sources(pieces: list[DataFrame], tag: str = "src_ord") -> DataFrame:
    """Bag union (UNION ALL) of pieces, each tagged with its position."""
    out = None
    for i, p in enumerate(pieces):
        t = p.withColumn(tag, F.lit(i).cast("int"))
        out = t if out is None else out.unionByName(t)
    return out


def universe(pieces: list[DataFrame], col: str) -> DataFrame:
    """Distinct keys of a column over all pieces."""
    out = None
    for p in pieces:
        s = p.select(col)
        out = s if out is None else out.unionByName(s)
    return out.distinct()


def universes(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """(side, key): distinct keys of several columns of one type, in one scan."""
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).alias("key")) for n, c in cols.items()]))
    return df.select(both.alias("x")).select("x.side", "x.key").distinct()


def same_keys(a: DataFrame, b: DataFrame, col: str, order: str | None = None) -> DataFrame:
    """One row: (same_set, same_order, n_left, n_right).

    same_set: the distinct keys agree both ways. same_order: also the same
    first-appearance order, i.e. equal first-seen ids for every key. Both
    come from one full outer join of the two key maps and one aggregate."""
    if order is not None:
        ia = index_first_seen(a, col, order, "ia")
        ib = index_first_seen(b, col, order, "ib")
    else:
        ia = a.select(col).distinct().withColumn("ia", F.lit(0).cast("bigint"))
        ib = b.select(col).distinct().withColumn("ib", F.lit(0).cast("bigint"))
    j = ia.join(ib, col, "full_outer")
    out = j.agg(F.count("ia").alias("n_left"), F.count("ib").alias("n_right"),
                F.count(F.lit(1)).alias("_n"),
                F.sum(F.when(F.col("ia").eqNullSafe(F.col("ib")), 0).otherwise(1)).alias("_d"))
    same_set = (F.col("n_left") == F.col("_n")) & (F.col("n_right") == F.col("_n"))
    cols = [same_set.alias("same_set")]
    if order is not None:
        cols.append((same_set & (F.coalesce(F.col("_d"), F.lit(0)) == 0)).alias("same_order"))
    return out.select(*cols, "n_left", "n_right")
