"""Neighbourhood models on sparse R (M3-M7).

With P = diag(row sums), Q = diag(column sums), inverse roots zero-guarded:

* item similarity  S_I = Q^-1/2 RᵀR Q^-1/2
* user similarity  S_U = P^-1/2 RRᵀ P^-1/2
* item-item scores Γ_I = R S_I
* user-user scores Γ_U = S_U R = P^-1/2 R (Rᵀ P^-1/2 R)
* blend            (Γ_U + Γ_I) / 2

Both Γ share one shape, R times an item x item matrix built from one
co-occurrence pass: K(a,b) = Σ_u r_ua r_ub gives S_I, and the same pass
weighted by P_u^-1/2 gives the user-user kernel. So Γ_I, Γ_U and the blend
come out of one self-join and one scoring join.

Association (which pairs to build) is chosen by cost: item pairs cost
Σ_u deg(u)², user pairs Σ_i deg(i)². The user-pair route is the same code on
Rᵀ, because Γ_I(R) = Γ_U(Rᵀ)ᵀ and Γ_U(R) = Γ_I(Rᵀ)ᵀ.

While there are few items, both kernels are dense matrices in tasks (``narrow``), whatever
the number of users. While R is small by count, scores come from compressed rows and columns in tasks
(``compressed``) and no pair becomes a row; above that rows are scored where pieces of R
meet (``panels``); ``association`` items or users, or a skew argument, asks for the joins.

With ``pairs`` only the wanted (user, item) cells are scored: pairs join R
on the user before the scoring join, and the co-occurrence is restricted to
the pairs' items on one side and the items of the pairs' users on the other (the aggregate would otherwise block that pushdown)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.functions.scalar import inv_sqrt
from cofilter.operators import compressed, narrow, panels
from cofilter.operators.matrix import materialize, transpose
from cofilter.operators.products import (HotKeys, cooccurrence, degree_stats, pair_partitions,
                                         salted_join, square_degree_cost)

U, I, V = "user_id", "item_id", "counts"


def _norms(R: DataFrame, key: str, out: str) -> DataFrame:
    return R.groupBy(key).agg(F.sum(V).alias(out))


def _with_norms(R: DataFrame, skew: dict, hot_u: HotKeys, hot_i: HotKeys) -> DataFrame:
    """R rows with w = P_u^-1/2 and q = Q_i (column sum) attached. Row and
    column sums are grouped aggregates; joining them onto R (hot keys split)
    is cheaper than joining them onto the pair kernel, which is much larger."""
    p = _norms(R, U, "_p")
    q = _norms(R, I, "_q")
    rp = salted_join(R.select(U, I, V), p, U, I, hot=hot_u, **skew)
    return salted_join(rp, q, I, U, hot=hot_i, **skew) \
        .withColumn("_w", inv_sqrt("_p")).drop("_p")


def _kernels(rn: DataFrame, items: DataFrame | None, skew: dict, hot_u: HotKeys,
             parts: int, own: DataFrame | None = None) -> DataFrame:
    """M(a, b, m_item, m_user): m_item = S_I(a,b), m_user = Σ_u r_ua r_ub P_u^-1/2."""
    k = cooccurrence(rn, by=U, col=I, val=V, weight="_w", right_keys=items, norm="_q",
                     left_keys=own, hot=hot_u, partitions=parts, **skew)
    return k.select("a", "b", (F.col("c") * inv_sqrt(F.col("na") * F.col("nb"))).alias("m_item"),
                    F.col("cw").alias("m_user"))


def _stats(R: DataFrame, key: str, skew: dict) -> tuple[float, HotKeys]:
    return degree_stats(R, key, **skew)


def _engine(R: DataFrame, pairs: DataFrame | None, skew: dict,
            stats_u: tuple | None = None, stats_i: tuple | None = None) -> DataFrame:
    """Item-pair association. Returns (user_id, item_id, score_user, score_item).
    ``stats_u``/``stats_i``: (Σ deg², hot keys) of users and items; Σ_u deg(u)²
    sizes the pair-generating joins."""
    stats_u = stats_u or _stats(R, U, skew)
    stats_i = stats_i or _stats(R, I, skew)
    (pair_count, hot_u), (_, hot_i) = stats_u, stats_i
    parts = pair_partitions(R.sparkSession, pair_count)
    rn = _with_norms(R, skew, hot_u, hot_i)
    rows = rn.select(U, F.col(I).alias("a"), F.col(V).alias("v"), "_w")
    if pairs is None:
        m = _kernels(rn, None, skew, hot_u, parts)
        x = salted_join(rows, m, "a", U, hot=hot_i.on("a"), partitions=parts, split_right="b", **skew)
    else:
        e = pairs.select(U, F.col(I).alias("b")).distinct()
        # only the items that the pairs' users hold meet the pairs' items
        own = rn.join(e.select(U).distinct(), U, "left_semi").select(I)
        m = _kernels(rn, e.select(F.col("b").alias(I)), skew, hot_u, parts, own)
        x = salted_join(e, rows, U, "b", partitions=parts, split_right="a", **skew)
        # adaptive execution may split this exchange where an item pair is popular
        x = x.join(m, ["a", "b"], "inner")
    return (x.groupBy(U, F.col("b").alias(I))
            .agg(F.sum(F.col("v") * F.col("_w") * F.col("m_user")).alias("score_user"),
                 F.sum(F.col("v") * F.col("m_item")).alias("score_item")))


def association_costs(R: DataFrame) -> dict[str, float]:
    """{'items': Σ_u deg(u)², 'users': Σ_i deg(i)²}: pair products of each
    association (two small aggregates, one job)."""
    c = (square_degree_cost(R, U).withColumn("side", F.lit("items"))
         .unionByName(square_degree_cost(R, I).withColumn("side", F.lit("users"))).collect())
    return {r["side"]: r["cost"] for r in c}


def choose_association(R: DataFrame) -> str:
    """'items' when Σ_u deg(u)² <= Σ_i deg(i)², else 'users'."""
    cost = association_costs(R)
    return "items" if cost["items"] <= cost["users"] else "users"


def neighbourhood_scores(R: DataFrame, pairs: DataFrame | None = None,
                         association: str = "auto", materialized: bool = False,
                         **skew) -> DataFrame:
    """(user_id, item_id, score_user, score_item) for every reachable cell,
    or for the given (user_id, item_id) pairs that have a path. R has columns
    user_id, item_id, counts with unique cells. ``materialized``: R is already
    a cheap read of a checkpoint, so it is not written again."""
    if not materialized:
        R = materialize(R)
    if association not in ("auto", "items", "users"):
        raise ValueError(f"association must be auto, items or users, not {association!r}")
    if association == "auto" and not skew and (items := narrow.narrow_items(R)):
        of = None if pairs is None else R.join(pairs.select(U).distinct(), U, "left_semi")
        g = narrow.scores(R, items, of=of)
        return g if pairs is None else g.join(pairs.select(U, I).distinct(), [U, I], "left_semi")
    if association == "auto" and not skew and compressed.fits(R):
        g = compressed.scores_walk(R)
        return g if pairs is None else g.join(pairs.select(U, I).distinct(), [U, I], "left_semi")
    # one pass per side gives both the association costs and the hot keys
    su, si = _stats(R, U, skew), _stats(R, I, skew)
    if association == "auto":
        association = "items" if su[0] <= si[0] else "users"
    if association == "items":
        return _engine(R, pairs, skew, su, si)
    rt = transpose(R)
    pt = transpose(pairs) if pairs is not None else None
    g = _engine(rt, pt, skew, (si[0], si[1].on(U)), (su[0], su[1].on(I)))
    return g.select(F.col(I).alias(U), F.col(U).alias(I),
                    F.col("score_item").alias("score_user"),
                    F.col("score_user").alias("score_item"))


def model_score(g: DataFrame, model: str, blend_weight: float = 0.5):
    """Pick one score column: 'user', 'item' or 'blend' (w·Γ_U + (1-w)·Γ_I)."""
    if model == "user":
        return F.col("score_user")
    if model == "item":
        return F.col("score_item")
    if model == "blend":
        return F.lit(blend_weight) * F.col("score_user") + F.lit(1.0 - blend_weight) * F.col("score_item")
    raise ValueError(f"model must be user, item or blend, not {model!r}")


def scores(R: DataFrame, model: str, pairs: DataFrame | None = None,
           association: str = "auto", blend_weight: float = 0.5,
           materialized: bool = False, **skew) -> DataFrame:
    """(user_id, item_id, score) for one model."""
    g = neighbourhood_scores(R, pairs, association, materialized, **skew)
    return g.select(U, I, model_score(g, model, blend_weight).alias("score"))


def item_similarity(R: DataFrame, **skew) -> DataFrame:
    """S_I as (item_i, item_j, sim), self pairs kept, zero cells absent."""
    R = materialize(R)
    (cost_u, hot_u), (_, hot_i) = _stats(R, U, skew), _stats(R, I, skew)
    rq = salted_join(R, _norms(R, I, "_q"), I, U, hot=hot_i, **skew)
    k = cooccurrence(rq, by=U, col=I, val=V, norm="_q", hot=hot_u,
                     partitions=pair_partitions(R.sparkSession, cost_u), **skew)
    return k.select(F.col("a").alias("item_i"), F.col("b").alias("item_j"),
                    (F.col("c") * inv_sqrt(F.col("na") * F.col("nb"))).alias("sim"))


def user_similarity(R: DataFrame, **skew) -> DataFrame:
    """S_U as (user_u, user_v, sim): the item similarity of Rᵀ; with few items by products
    of pieces of R, without a row for each pair of cells."""
    R = materialize(R)
    if not skew and (items := narrow.narrow_items(R)):
        return narrow.user_pairs(R, items)
    s = item_similarity(transpose(R), **skew)
    return s.select(F.col("item_i").alias("user_u"), F.col("item_j").alias("user_v"), "sim")


def score_pairs(R: DataFrame, rows: DataFrame, model: str = "item",
                association: str = "auto", blend_weight: float = 0.5,
                materialized: bool = False, **skew) -> DataFrame:
    """Evaluation rows with ``pred`` = model score, 0 where no path exists
    (the matrix rule: such rows stay and count in the error) (J2)."""
    if association == "auto" and not skew:
        if not materialized:
            R, materialized = materialize(R), True
        items = narrow.narrow_items(R)
        if items or (cells := compressed.positive_cells(R)):
            if model not in ("user", "item", "blend"):
                raise ValueError(f"model must be user, item or blend, not {model!r}")
            weights = {"blend": {"user": blend_weight, "item": 1.0 - blend_weight}}.get(model, {model: 1.0})
            if items:
                return narrow.score_rows(R, items, rows, weights)
            if cells <= compressed.LOCAL_CELLS:
                return compressed.score_rows_walk(R, rows, weights)
            if choose_association(R) == "users":
                return panels.score_rows(R, rows, weights, cells)
            turned = {{"user": "item", "item": "user"}[m]: x for m, x in weights.items()}
            return transpose(panels.score_rows(transpose(R), transpose(rows), turned, cells)).select(*rows.columns, "pred")
    pairs = rows.select(U, I).distinct()
    s = scores(R, model, pairs, association, blend_weight, materialized, **skew)
    return (rows.join(s, [U, I], "left")
            .withColumn("pred", F.coalesce(F.col("score"), F.lit(0.0))).drop("score"))
