"""Hand-size matrix fixture: users A-D, items x-z (numbers from numpy)."""

import math

import pytest
from pyspark.sql import functions as F

from cofilter.operators.products import cooccurrence
from cofilter.operators import compressed, matrix, metrics, neighbourhood

TRIPLES = [("A", "x", 1.0), ("A", "y", 3.0), ("B", "y", 2.0), ("C", "x", 1.0), ("C", "z", 4.0)]
EVAL = [("A", "z", 2.0), ("B", "x", 1.0), ("C", "y", 3.0), ("D", "x", 5.0)]
SCHEMA = "user_id string, item_id string, counts double"

S_I = {("x", "x"): 1.0, ("x", "y"): 0.948683, ("x", "z"): 1.414214, ("y", "y"): 2.6,
       ("y", "z"): 0.0, ("z", "z"): 4.0}
S_U = {("A", "A"): 2.5, ("A", "B"): 2.121320, ("A", "C"): 0.223607, ("B", "B"): 2.0,
       ("B", "C"): 0.0, ("C", "C"): 3.4}
GAMMA = {  # user: (Γ_U, Γ_I, blend) for items x, y, z
    "A": ((2.723607, 11.742641, 0.894427), (3.846050, 8.748683, 1.414214), (3.284828, 10.245662, 1.154320)),
    "B": ((2.121320, 10.363961, 0.0), (1.897367, 5.2, 0.0), (2.009343, 7.781981, 0.0)),
    "C": ((3.623607, 0.670820, 13.6), (6.656854, 0.948683, 17.414214), (5.140231, 0.809752, 15.507107)),
}
RMSE = {"user": 2.868132, "item": 2.754828, "blend": 2.807630}
PREDS = {"user": [0.894427, 2.121320, 0.670820, 0.0], "item": [1.414214, 1.897367, 0.948683, 0.0],
         "blend": [1.154320, 2.009343, 0.809752, 0.0]}


@pytest.fixture(params=["tasks", "joins"], autouse=True)
def where(request, monkeypatch):
    """Every test with compressed rows in tasks and with the joins of a larger R."""
    if request.param == "joins":
        monkeypatch.setattr(compressed, "LOCAL_CELLS", 0)


@pytest.fixture(scope="module")
def R(spark):
    return spark.createDataFrame(TRIPLES, SCHEMA)


def _sym(d):
    out = dict(d)
    out.update({(b, a): v for (a, b), v in d.items()})
    return out


def test_item_similarity(R):
    got = {(r.item_i, r.item_j): r.sim for r in neighbourhood.item_similarity(R).collect()}
    for k, v in _sym(S_I).items():
        assert got.get(k, 0.0) == pytest.approx(v, abs=1e-6)


def test_user_similarity(R):
    got = {(r.user_u, r.user_v): r.sim for r in neighbourhood.user_similarity(R).collect()}
    for k, v in _sym(S_U).items():
        assert got.get(k, 0.0) == pytest.approx(v, abs=1e-6)
    assert all(v == pytest.approx(got[(b, a)]) for (a, b), v in got.items())


@pytest.mark.parametrize("association", ["items", "users"])
@pytest.mark.parametrize("task_rows", [200_000, 1])
def test_full_scores_all_models(R, association, task_rows):
    g = neighbourhood.neighbourhood_scores(R, association=association, task_rows=task_rows)
    got = {(r.user_id, r.item_id): (r.score_user, r.score_item) for r in g.collect()}
    for u, (gu, gi, gb) in GAMMA.items():
        for j, it in enumerate("xyz"):
            su, si = got.get((u, it), (0.0, 0.0))
            assert su == pytest.approx(gu[j], abs=1e-6)
            assert si == pytest.approx(gi[j], abs=1e-6)
            assert 0.5 * su + 0.5 * si == pytest.approx(gb[j], abs=1e-6)
    assert not any(u == "D" for u, _ in got)


@pytest.mark.parametrize("model", ["user", "item", "blend"])
@pytest.mark.parametrize("association", ["items", "users"])
def test_eval_pairs_and_rmse(spark, R, model, association):
    ev = spark.createDataFrame(EVAL, SCHEMA)
    sc = neighbourhood.score_pairs(R, ev, model, association=association)
    got = {(r.user_id, r.item_id): r.pred for r in sc.collect()}
    for (u, i, _), p in zip(EVAL, PREDS[model]):
        assert got[(u, i)] == pytest.approx(p, abs=1e-6)
    r = metrics.rmse(sc).first()
    assert r.n == 4 and r.rmse == pytest.approx(RMSE[model], abs=1e-6)


def test_blend_of_model_with_itself(R):
    g = neighbourhood.neighbourhood_scores(R).collect()
    for r in g:
        assert neighbourhood.model_score  # blend weight 1 gives the user model
    s1 = {(r.user_id, r.item_id): r.score for r in neighbourhood.scores(R, "blend", blend_weight=1.0).collect()}
    s2 = {(r.user_id, r.item_id): r.score for r in neighbourhood.scores(R, "user").collect()}
    assert s1.keys() == s2.keys()
    assert all(s1[k] == pytest.approx(s2[k]) for k in s1)


def test_log_scale_cells(spark):
    from cofilter.functions import log_scale
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "counts double")
    got = [round(r.counts, 6) for r in log_scale(df).orderBy("counts").collect()]
    assert got == [0.693147, 1.098612, 1.386294, 1.609438]


def test_last_write_keeps_later_value(spark):
    rows = spark.createDataFrame([("A", "x", 1.0, 0, 0), ("A", "x", 7.0, 0, 1)],
                                 "user_id string, item_id string, counts double, src_ord int, row_no long")
    m = matrix.build_matrix(rows, order=("src_ord", "row_no")).collect()
    assert [(r.user_id, r.item_id, r.counts) for r in m] == [("A", "x", 7.0)]


def test_degree_norms_zero_guard(spark):
    R = spark.createDataFrame([("A", "x", 0.0), ("A", "y", 4.0)], "user_id string, item_id string, counts double")
    got = {(r.side, r.key): r.inv_sqrt for r in matrix.degree_norms(R).collect()}
    assert got[("item", "x")] == 0.0 and got[("item", "y")] == 0.5
    assert got[("user", "A")] == pytest.approx(0.5)


def test_pivot_zero_filled(R):
    wide = {r.user_id: r for r in matrix.pivot_matrix(R).collect()}
    assert wide["A"]["x"] == 1.0 and wide["A"]["z"] == 0.0 and wide["C"]["z"] == 4.0


def test_kernel_cut_on_both_sides(spark):
    """Wanted pairs limit the co-occurrence to the items of their users and their own."""
    R = spark.createDataFrame([(u, i, float(u + i)) for u in range(6) for i in range(5) if (u + i) % 3], "user_id int, item_id int, counts double")
    a, b = spark.createDataFrame([(1,), (2,)], "item_id int"), spark.createDataFrame([(0,), (4,)], "item_id int")
    whole = {(r.a, r.b): r.c for r in cooccurrence(R, "user_id", "item_id", "counts").collect()}
    cut = {(r.a, r.b): r.c for r in cooccurrence(R, "user_id", "item_id", "counts", right_keys=b, left_keys=a).collect()}
    assert cut == {k: c for k, c in whole.items() if k[0] in (1, 2) and k[1] in (0, 4)} and cut
