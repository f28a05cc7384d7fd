"""Error and rank metrics.

Per-user Spearman = Pearson correlation of average-tie ranks. Ranks come
from one global ordering on (user, value) rather than a per-user window, so
a user holding a large share of the rows is spread over many range
partitions instead of one task; positions and tie counts are then grouped
aggregates (combined map-side). Pearson is written by moments with an
explicit zero-variance rule (smallest = largest, which rounding of large
sums cannot hide), because ``corr`` throws DIVIDE_BY_ZERO under
ANSI mode on a constant group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.functions.scalar import TIE_DIGITS, squared_error
from cofilter.operators.ordering import with_row_number
from cofilter.operators.products import TASK_ROWS, HotKeys, salted_join
from cofilter.session import checkpoint_dir


def _list(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def rmse(df: DataFrame, actual: str = "counts", pred: str = "pred", by=None) -> DataFrame:
    """(by..., n, mse, rmse); one row per group, null error on an empty input."""
    se = squared_error(actual, pred)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(se).alias("mse")]
    g = df.groupBy(*_list(by)).agg(*aggs) if by else df.agg(*aggs)
    return g.withColumn("rmse", F.sqrt("mse"))


def rank_table(df: DataFrame, group, col: str, out: str, tiebreak: str | None = None, ties: bool = False) -> DataFrame:
    """(group..., col, out): 1-based average-tie rank of each distinct value
    of ``col`` within ``group`` (scipy's 'average' method), i.e. rank() over
    (partition by group order by col) + (ties - 1) / 2.

    ``ties`` adds _ties, the number of rows of the value.

    ``tiebreak``: any other column; it only spreads a heavily tied value over
    several range partitions (positions inside a tie do not matter)."""
    group = _list(group)
    extra = [tiebreak] if tiebreak else []
    numbered, _ = with_row_number(df.select(*group, col, *extra), [*group, col, *extra], "_pos")
    per_value = numbered.groupBy(*group, col).agg(F.min("_pos").alias("_first"),
                                                  F.count(F.lit(1)).alias("_ties"))
    per_group = per_value.groupBy(*group).agg(F.min("_first").alias("_gfirst"))
    return (per_value.join(per_group, group)
            .select(*group, col,
                    (F.col("_first") - F.col("_gfirst") + F.lit(1)
                     + (F.col("_ties") - F.lit(1)) / F.lit(2.0)).alias(out), *(["_ties"] if ties else [])))


def average_rank(df: DataFrame, group, col: str, out: str, **skew) -> DataFrame:
    """``df`` with ``out`` = average-tie rank of ``col`` within ``group``."""
    group = _list(group)
    other = next((c for c in df.columns if c not in (*group, col)), col)
    return salted_join(df, rank_table(df, group, col, out, other if other != col else None),
                       [*group, col], other, **skew)


def spearman_per_user(df: DataFrame, user: str = "user_id", actual: str = "counts",
                      pred: str = "pred", item: str = "item_id", by=None,
                      materialize: bool = True, **skew) -> DataFrame:
    """(by..., user, n, rho): rho null when the user has one row or either
    side has zero variance (scipy gives NaN there). Predictions are rounded
    to 9 digits before ranking so float summation order cannot split ties.

    Both rank columns come from one global ordering of (group, side, value)
    rows; rows are matched to their ranks by (group, value), so duplicate
    rows are fine. ``materialize=False`` when ``df`` is already a checkpoint."""
    group = [*_list(by), user]
    base = df.select(*group, item, F.col(actual).cast("double").alias("_x"),
                     F.round(F.col(pred), TIE_DIGITS).alias("_y"))
    if materialize:
        checkpoint_dir(df.sparkSession)
        # cut lineage once: the rank table and the join back both read these rows
        base = base.checkpoint(eager=True)
    sides = (base.select(*group, item, F.lit(0).alias("_side"), F.col("_x").alias("_v"))
             .unionByName(base.select(*group, item, F.lit(1).alias("_side"), F.col("_y").alias("_v"))))
    checkpoint_dir(df.sparkSession)
    ranks = rank_table(sides, [*group, "_side"], "_v", "_r", tiebreak=item, ties=True).checkpoint(eager=True)
    # a value's ties are its rows in the joins below: one small read instead of a probe for each
    if "hot" not in skew and (ranks.agg(F.max("_ties")).first()[0] or 0) <= skew.get("task_rows", TASK_ROWS):
        skew = skew | {"hot": HotKeys(None, 0, 0)}
    rx = ranks.filter(F.col("_side") == 0).select(*group, F.col("_v").alias("_x"), F.col("_r").alias("rx"))
    ry = ranks.filter(F.col("_side") == 1).select(*group, F.col("_v").alias("_y"), F.col("_r").alias("ry"))
    both = salted_join(base, rx, [*group, "_x"], item, **skew)
    both = salted_join(both, ry, [*group, "_y"], item, **skew)
    return pearson_by_group(both, group, "rx", "ry")


def pearson_by_group(df: DataFrame, group, x: str, y: str) -> DataFrame:
    group = _list(group)
    m = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"),
        F.sum(F.col(x) * F.col(y)).alias("sxy"),
        (F.min(x) == F.max(x)).alias("cx"), (F.min(y) == F.max(y)).alias("cy"))
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    rho = F.when((F.col("n") < 2) | F.col("cx") | F.col("cy"), F.lit(None).cast("double")) \
        .otherwise(cxy / F.sqrt(vx * vy))
    return m.select(*group, "n", rho.alias("rho"))


def spearman_summary(per_user: DataFrame, by=None) -> DataFrame:
    """(by..., n_defined, mean_rho, n_users); mean null when none is defined."""
    aggs = [F.count("rho").alias("n_defined"), F.avg("rho").alias("mean_rho"),
            F.count(F.lit(1)).alias("n_users")]
    return per_user.groupBy(*_list(by)).agg(*aggs) if by else per_user.agg(*aggs)


def ranking_quality(df: DataFrame, user: str = "user_id", actual: str = "counts", pred: str = "pred", item: str = "item_id",
                    relevant: float = 1.0, k: int = 10, by=None) -> DataFrame:
    """(by..., user, n, n_relevant, ap, ndcg): average precision of the ranking by
    ``pred``, with rows of at least ``relevant`` as the relevant ones, and NDCG at k with
    ``actual`` as the gain. Ties count as one step (precision after all of them; their
    places share their mean gain). ap is null without a relevant row, ndcg without a gain.

    Positions come from one global order of (group, value) rows, as in Spearman: a user
    with a large share of the rows is spread over many tasks."""
    group = [*_list(by), user]
    checkpoint_dir(df.sparkSession)
    base = df.select(*group, item, F.col(actual).cast("double").alias("_g"), F.round(F.col(pred), TIE_DIGITS).alias("_p")).checkpoint(eager=True)

    def side(rows: DataFrame, no: int, column: str) -> DataFrame:
        return rows.select(*group, item, F.lit(no).alias("_side"), (-F.col(column)).alias("_v"))

    rows = side(base, 0, "_p").unionByName(side(base.where(F.col("_g") >= relevant), 1, "_p")).unionByName(side(base, 2, "_g"))
    ranks = rank_table(rows, [*group, "_side"], "_v", "_r", tiebreak=item, ties=True)
    half = (F.col("_ties") - 1) / 2.0
    ranks = ranks.select(*group, "_side", "_v", "_ties", (F.col("_r") - half).alias("_a"), (F.col("_r") + half).alias("_z"))
    discount = [0.0]
    for place in range(1, k + 1):
        discount.append(discount[-1] + 1 / math.log2(place + 1))
    table = F.array(*[F.lit(x) for x in discount])

    def share(a: str, z: str):  # discounts of the places from a to z, up to k
        return F.when(F.col(a) > k, 0.0).otherwise(F.get(table, F.least(F.col(z), F.lit(k)).cast("int")) - F.get(table, (F.col(a) - 1).cast("int")))

    gains = base.groupBy(*group, (-F.col("_p")).alias("_v")).agg(F.sum("_g").alias("_sum"))
    whole = ranks.where("_side = 0").join(gains, [*group, "_v"])
    good = ranks.where("_side = 1").select(*group, "_v", F.col("_ties").alias("_rel"), F.col("_z").alias("_relz"))
    steps = whole.join(good, [*group, "_v"], "left").withColumn("_d", share("_a", "_z") * F.col("_sum") / F.col("_ties"))
    out = steps.groupBy(*group).agg(F.sum("_ties").alias("n"), F.coalesce(F.sum("_rel"), F.lit(0)).alias("n_relevant"),
                                    F.sum(F.col("_rel") * F.col("_relz") / F.col("_z")).alias("_ap"), F.sum("_d").alias("_dcg"))
    ideal = (ranks.where("_side = 2").withColumn("_i", -F.col("_v") * share("_a", "_z")).groupBy(*group).agg(F.sum("_i").alias("_idcg")))
    return out.join(ideal, group).select(
        *group, "n", "n_relevant", (F.col("_ap") / F.when(F.col("n_relevant") > 0, F.col("n_relevant"))).alias("ap"),
        (F.col("_dcg") / F.when(F.col("_idcg") > 0, F.col("_idcg"))).alias("ndcg"))
