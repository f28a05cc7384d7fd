"""Top-k by factor products, saved models, ALS normal equations and ranking metrics
against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cofilter.operators import factor, factor_topk, metrics

TRIPLES = "user_id long, item_id long, counts double"


def brute(users, items, k):
    out = []
    for u, y in users:
        best = sorted((-round(float(np.dot(y, x)), 9), i) for i, x in items)[:k]
        out += [(u, r + 1, i, round(-s, 6)) for r, (s, i) in enumerate(best)]
    return sorted(out)


def check(spark, users, items, k, report=None, key="long"):
    u = spark.createDataFrame(users + [(users[0][0].__class__(77777), None)] if users else [], f"user_id {key}, y array<double>")
    i = spark.createDataFrame(items, f"item_id {key}, x array<float>")
    got = sorted((r.user_id, r.rank, r.item_id, round(r.score, 6)) for r in factor_topk.top_k_products(u, i, k, report=report).collect())
    exact = [(a, np.array(x, np.float32).astype(float)) for a, x in items]
    assert got == brute(users, exact, k)
    return got


def vectors(rng, n, width, spread=1.0):
    return [(int(i), (rng.normal(size=width) * rng.lognormal(0, spread)).tolist()) for i in range(n)]


@pytest.mark.parametrize("block, group", [(2048, 1024), (16, 7)])
def test_top_k_products(spark, monkeypatch, block, group):
    monkeypatch.setattr(factor_topk, "ITEM_BLOCK", block)
    monkeypatch.setattr(factor_topk, "USER_GROUP", group)
    rng = np.random.default_rng(6)
    users, items = vectors(rng, 60, 5), vectors(rng, 300, 5)
    users += [(900, [0.0] * 5), (901, users[0][1])]
    items += [(2000 + i, items[3][1]) for i in range(12)]  # ties
    report = {}
    check(spark, users, items, 6, report)
    if block == 16:
        assert report["met"] < 0.7 * report["pairs"]  # long vectors first: later blocks are not met


def test_top_k_products_edges(spark, monkeypatch):
    rng = np.random.default_rng(7)
    users, items = vectors(rng, 5, 3), vectors(rng, 4, 3)
    check(spark, users, items, 10)  # fewer items than k
    check(spark, [(str(a), x) for a, x in users], [(f"i{a}", x) for a, x in items], 2, key="string")
    assert check(spark, users, [], 3) == [] and check(spark, [], items, 3) == []
    monkeypatch.setattr(factor_topk, "ITEM_BLOCK", 2)  # the first block holds fewer than k
    check(spark, users, vectors(rng, 9, 3), 4)


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(3)
    rows = [(int(u), int(i), float(1 + (u * 7 + i * 3) % 5)) for u in range(40) for i in range(25) if rng.random() < 0.5]
    train, test = spark.createDataFrame(rows, TRIPLES).randomSplit([0.8, 0.2], 1)
    return factor.als_fit_predict(train, test, rank=4, max_iter=5, reg=0.05, seed=1), test


def test_als_solves_its_normal_equations(spark, rated):
    """The residual operator against numpy, and small for the fitted side only."""
    res, _ = rated
    gap = {r.user_id: r.residual for r in factor.als_residual(res.model, res.ratings).collect()}
    assert max(gap.values()) < 1e-4
    y = {r.user_id: np.array(r.y) for r in res.model.users.collect()}
    x = {r.item_id: np.array(r.x) for r in res.model.items.collect()}
    bent = factor.ALSModel(res.model.users.select("user_id", F.transform("y", lambda v: v * F.lit(1.5).cast("float")).alias("y")),
                           res.model.items, 4, 0.05)
    rows = res.ratings.collect()
    for r in factor.als_residual(bent, res.ratings).collect():
        own = [(np.array(x[q.item_id]), q.counts) for q in rows if q.user_id == r.user_id]
        a = sum(np.outer(v, v) for v, _ in own) + 0.05 * len(own) * np.eye(4)
        b = sum(v * c for v, c in own)
        assert r.n == len(own) and r.residual == pytest.approx(np.linalg.norm(a @ (1.5 * y[r.user_id]) - b) / np.linalg.norm(b), rel=1e-3)


def test_saved_models_predict_the_same(spark, rated, tmp_path):
    res, test = rated
    factor.save_als(res.model, str(tmp_path / "als"))
    back = factor.load_als(spark, str(tmp_path / "als"))
    assert (back.rank, back.reg) == (4, 0.05)
    again = {(r.user_id, r.item_id): r.prediction for r in factor.als_predict(back, test).collect()}
    want = {(r.user_id, r.item_id): r.prediction for r in res.test_pred.collect()}
    assert again.keys() == want.keys() and all(again[k] == pytest.approx(want[k], rel=1e-4) for k in want)
    with pytest.raises(ValueError):
        factor.load_svd(spark, str(tmp_path / "als"))
    with pytest.raises(Exception):
        factor.save_als(res.model, str(tmp_path / "als"))  # never overwritten
    R = res.ratings
    m = factor.svd_fit(R)
    factor.save_svd(m, str(tmp_path / "svd"))
    n = factor.load_svd(spark, str(tmp_path / "svd"))
    pairs = R.limit(20)
    one, two = ({(r.user_id, r.item_id): r.score for r in factor.svd_scores(R, x, 3, pairs).collect()} for x in (m, n))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)
    assert n.energy(3) == pytest.approx(m.energy(3))


def test_svd_and_als_lists_for_all_users(spark, rated):
    res, _ = rated
    m = factor.svd_fit(res.ratings)
    got = sorted((r.user_id, r.rank, r.item_id) for r in factor.svd_top_k(res.ratings, m, 3, 4).collect())
    every = factor.svd_scores(res.ratings, m, 3).collect()
    want = []
    for u in {r.user_id for r in every}:
        best = sorted((-round(r.score, 9), r.item_id) for r in every if r.user_id == u)[:4]
        want += [(u, n + 1, i) for n, (_, i) in enumerate(best)]
    assert got == sorted(want)
    users = [(r.user_id, [float(v) for v in r.y]) for r in res.model.users.collect()]
    items = [(r.item_id, [float(v) for v in r.x]) for r in res.model.items.collect()]
    top = factor.top_k_products(res.model.users, res.model.items, 3).collect()
    assert sorted((r.user_id, r.rank, r.item_id, round(r.score, 6)) for r in top) == brute(users, items, 3)


def quality(rows, relevant, k):
    """Average precision by distinct thresholds; NDCG with mean gains of ties."""
    n, rel = len(rows), sum(g >= relevant for g, _ in rows)
    ap, dcg, seen, hits = 0.0, 0.0, 0, 0
    for p in sorted({p for _, p in rows}, reverse=True):
        tied = [g for g, q in rows if q == p]
        seen, hits, new = seen + len(tied), hits + sum(g >= relevant for g in tied), sum(g >= relevant for g in tied)
        ap += new * hits / seen
        dcg += sum(1 / math.log2(place + 1) for place in range(seen - len(tied) + 1, seen + 1) if place <= k) * sum(tied) / len(tied)
    best = sum(g / math.log2(place + 2) for place, g in enumerate(sorted((g for g, _ in rows), reverse=True)[:k]))
    return n, rel, ap / rel if rel else None, dcg / best if best else None


def test_ranking_quality(spark):
    rng = np.random.default_rng(11)
    rows = [(int(u), i, float(rng.integers(0, 4)), float(rng.integers(0, 6)) / 3) for u in range(12) for i in range(int(rng.integers(1, 30)))]
    rows += [(50, i, 0.0, 1.0) for i in range(4)] + [(51, 1, 5.0, 0.0)] + [(52, i, 2.0, 2.0) for i in range(40)]
    df = spark.createDataFrame(rows, TRIPLES + ", pred double")
    for k in (3, 10):
        got = {r.user_id: r for r in metrics.ranking_quality(df, relevant=2.0, k=k).collect()}
        assert got.keys() == {r[0] for r in rows}
        for u, r in got.items():
            want = quality([(g, p) for w, _, g, p in rows if w == u], 2.0, k)
            assert (r.n, r.n_relevant) == want[:2]
            for a, b in zip((r.ap, r.ndcg), want[2:], strict=True):
                assert a is b is None or a == pytest.approx(b)
