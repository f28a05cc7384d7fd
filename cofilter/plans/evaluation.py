"""Whole evaluations.

E1/E2: neighbourhood model fitted on train, evaluation rows scored with the
matrix rule (no path -> 0, kept). Train and test rows are scored in one
pass (one co-occurrence kernel), the scored rows are written once, and
RMSE and per-user Spearman are grouped by part.

Output is long: (part, metric, value), a union of grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.functions.scalar import md5_order_key
from cofilter.operators.factor import als_fit_predict, mse_rmse
from cofilter.operators.matrix import build_matrix
from cofilter.operators.metrics import rmse, spearman_per_user, spearman_summary
from cofilter.operators.neighbourhood import score_pairs
from cofilter.operators.ordering import exact_floor, with_row_number
from cofilter.session import written

U, I, V = "user_id", "item_id", "counts"


def scored_parts(train: DataFrame, test: DataFrame, model: str, association: str = "auto",
                 blend_weight: float = 0.5, order=None, **skew) -> DataFrame:
    """(part, user_id, item_id, counts, pred) for test and train rows. With
    ``order`` the matrix keeps the last written value of duplicate cells,
    while every train row is still scored against its own count.

    The rows are written once up front: the model, the hot-key probes
    and the metrics then all plan over a short scan instead of re-planning
    (and re-reading) the sources."""
    extra = list(order or [])
    rows = (test.select(U, I, V, *[F.lit(0).cast("int").alias(c) for c in extra])
            .withColumn("part", F.lit("test"))
            .unionByName(train.select(U, I, V, *extra).withColumn("part", F.lit("train"))))
    rows = written(rows, "rows")
    R = build_matrix(rows.filter(F.col("part") == "train"), order=order)
    # without an order R is a filter over the written rows: no second write
    scored = score_pairs(R, rows.select("part", U, I, V), model, association, blend_weight,
                         materialized=order is None, **skew)
    return written(scored, "scored")


def metrics_long(scored: DataFrame, **skew) -> DataFrame:
    """(part, metric, value) with rmse, n, n_defined, mean_rho, n_users."""
    r = rmse(scored, V, "pred", by="part")
    s = spearman_summary(spearman_per_user(scored, by="part", materialize=False, **skew), by="part")
    # one row per part, then turned long: each aggregate runs once
    names = ["rmse", "n", "n_defined", "mean_rho", "n_users"]
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return r.join(s, "part").select("part", F.explode(cells).alias("m")).select("part", "m.metric", "m.value")


def evaluate(train: DataFrame, test: DataFrame, model: str = "item", **kw) -> DataFrame:
    return metrics_long(scored_parts(train, test, model, **kw))


def size_study(R: DataFrame, fracs=(0.25, 0.5, 1.0), model: str = "item",
               split_frac=0.7, seed=41, **kw) -> DataFrame:
    """E1 at several data sizes: for each fraction f, the first floor(f·n)
    rows of train and of test in split order (the heads of the reference's
    files). Output (frac, part, metric, value)."""
    keyed = R.withColumn("_k", md5_order_key([U, I], seed))
    numbered, n = with_row_number(keyed, ["_k", U, I], "_r")
    cut = exact_floor(split_frac, n)
    out = None
    for f in fracs:
        n_tr, n_te = exact_floor(f, cut), exact_floor(f, n - cut)
        tr = numbered.filter(F.col("_r") < n_tr)
        te = numbered.filter((F.col("_r") >= cut) & (F.col("_r") < cut + n_te))
        m = evaluate(tr, te, model, **kw).withColumn("frac", F.lit(float(f)))
        out = m if out is None else out.unionByName(m)
    return out


def als_evaluate(train: DataFrame, test: DataFrame, **kw):
    """(report row, metrics rows, test predictions) of the ALS job."""
    res = als_fit_predict(train, test, **kw)
    metrics = mse_rmse(res.train_pred, "train").unionByName(mse_rmse(res.test_pred, "test"))
    return res, metrics
