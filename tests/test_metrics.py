"""Spearman fixture and rank rules."""

import pytest

from cofilter.operators import metrics

ROWS = [("u1", "a", 1.0, 0.1), ("u1", "b", 2.0, 0.4), ("u1", "c", 3.0, 0.9),
        ("u2", "a", 1.0, 0.2), ("u2", "b", 1.0, 0.5), ("u2", "c", 3.0, 0.5), ("u2", "d", 5.0, 0.1),
        ("u3", "a", 1.0, 0.3), ("u3", "b", 1.0, 0.4),
        ("u4", "a", 2.0, 0.7),
        ("u5", "a", 1.0, 0.9), ("u5", "b", 2.0, 0.4), ("u5", "c", 3.0, 0.1)]
SCHEMA = "user_id string, item_id string, counts double, pred double"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_spearman_per_user(df):
    got = {r.user_id: r.rho for r in metrics.spearman_per_user(df).collect()}
    assert got["u1"] == pytest.approx(1.0)
    assert got["u2"] == pytest.approx(-0.5)
    assert got["u3"] is None and got["u4"] is None
    assert got["u5"] == pytest.approx(-1.0)


def test_spearman_summary(df):
    s = metrics.spearman_summary(metrics.spearman_per_user(df)).first()
    assert (s.n_defined, s.n_users) == (3, 5)
    assert s.mean_rho == pytest.approx(-0.166667, abs=1e-6)


def test_spearman_with_hot_user_split(df):
    s = metrics.spearman_summary(metrics.spearman_per_user(df, task_rows=1)).first()
    assert (s.n_defined, s.n_users) == (3, 5)
    assert s.mean_rho == pytest.approx(-0.166667, abs=1e-6)


def test_average_rank_ties(df):
    got = {(r.user_id, r.item_id): r.rk for r in metrics.average_rank(
        df.select("user_id", "item_id", "counts"), "user_id", "counts", "rk").collect()}
    assert [got[("u2", k)] for k in "abcd"] == [1.5, 1.5, 3.0, 4.0]
    got_p = {(r.user_id, r.item_id): r.rk for r in metrics.average_rank(
        df.select("user_id", "item_id", "pred"), "user_id", "pred", "rk").collect()}
    assert [got_p[("u2", k)] for k in "abcd"] == [2.0, 3.5, 3.5, 1.0]


def test_no_defined_user_gives_null_mean(spark):
    d = spark.createDataFrame([("u", "a", 1.0, 0.5)], SCHEMA)
    s = metrics.spearman_summary(metrics.spearman_per_user(d)).first()
    assert (s.n_defined, s.mean_rho, s.n_users) == (0, None, 1)


def test_rmse_empty_is_null(spark):
    d = spark.createDataFrame([], SCHEMA)
    r = metrics.rmse(d).first()
    assert r.n == 0 and r.rmse is None
