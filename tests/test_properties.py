"""Properties of the models on random sparse matrices (fixed seeds)."""

import numpy as np
import pytest

from cofilter.operators import matrix, neighbourhood


def _random_R(spark, seed, users=25, items=15, density=0.3, binary=False):
    rng = np.random.default_rng(seed)
    dense = (rng.random((users, items)) < density) * (1 if binary else rng.integers(1, 9, (users, items)))
    rows = [(int(u), int(i), float(dense[u, i])) for u in range(users) for i in range(items) if dense[u, i]]
    return dense.astype(float), spark.createDataFrame(rows, "user_id long, item_id long, counts double")


def _inv_sqrt(v):
    return np.where(v == 0, 0.0, 1.0 / np.sqrt(np.where(v == 0, 1.0, v)))


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_equal_numpy_both_associations(spark, seed):
    dense, R = _random_R(spark, seed)
    p, q = _inv_sqrt(dense.sum(1)), _inv_sqrt(dense.sum(0))
    gu = np.diag(p) @ dense @ dense.T @ np.diag(p) @ dense
    gi = dense @ np.diag(q) @ dense.T @ dense @ np.diag(q)
    for assoc in ("items", "users"):
        got = neighbourhood.neighbourhood_scores(R, association=assoc).collect()
        for r in got:
            assert r.score_user == pytest.approx(gu[r.user_id, r.item_id], rel=1e-9, abs=1e-9)
            assert r.score_item == pytest.approx(gi[r.user_id, r.item_id], rel=1e-9, abs=1e-9)
        assert len(got) == int(np.count_nonzero(gi > 1e-12))


def test_similarity_symmetric(spark):
    _, R = _random_R(spark, 3)
    s = {(r.item_i, r.item_j): r.sim for r in neighbourhood.item_similarity(R).collect()}
    assert all(s[(b, a)] == v for (a, b), v in s.items())


def test_binary_item_similarity_is_spark_cosine(spark):
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    dense, R = _random_R(spark, 4, binary=True)
    rm = RowMatrix(spark.sparkContext.parallelize([Vectors.dense(row) for row in dense]))
    cos = {(e.i, e.j): e.value for e in rm.columnSimilarities().entries.collect()}
    ours = {(r.item_i, r.item_j): r.sim for r in neighbourhood.item_similarity(R).collect()}
    for (i, j), v in cos.items():
        assert ours.get((i, j), 0.0) == pytest.approx(v, abs=1e-9)
    assert {k for k, v in ours.items() if k[0] < k[1]} == {k for k, v in cos.items() if v != 0}


def test_last_write_idempotent(spark):
    rows = spark.createDataFrame(
        [(1, 1, 3.0, 0, 0), (1, 1, 5.0, 1, 0), (2, 1, 1.0, 0, 3), (2, 1, 2.0, 0, 1)],
        "user_id long, item_id long, counts double, src_ord int, row_no long")
    once = matrix.build_matrix(rows, order=("src_ord", "row_no"))
    got = {(r.user_id, r.item_id): r.counts for r in once.collect()}
    assert got == {(1, 1): 5.0, (2, 1): 1.0}
    again = matrix.build_matrix(once.withColumn("src_ord", once.counts * 0).withColumn("row_no", once.counts * 0),
                                order=("src_ord", "row_no"))
    assert {(r.user_id, r.item_id): r.counts for r in again.collect()} == got


def test_hot_user_with_third_of_rows_is_split_and_exact(spark):
    """One user holds a third of all cells: it is found as hot, split into
    buckets, and every score still equals numpy's."""
    from cofilter.operators.products import hot_keys

    rng = np.random.default_rng(11)
    users, items = 40, 60
    dense = (rng.random((users, items)) < 0.05) * rng.integers(1, 5, (users, items))
    dense[0, :] = rng.integers(1, 5, items)            # the hot user: every item
    rows = [(int(u), int(i), float(dense[u, i])) for u in range(users) for i in range(items) if dense[u, i]]
    assert sum(1 for r in rows if r[0] == 0) * 3 >= len(rows) * 0.9
    R = spark.createDataFrame(rows, "user_id long, item_id long, counts double")
    hot = hot_keys(R, "user_id", task_rows=20)
    assert [tuple(r) for r in hot.table.collect()] == [(0, 60)] and (hot.count, hot.top) == (1, 60)
    assert [tuple(r) for r in hot.blocks(20).collect()] == [(0, 3)] and hot.blocks(60) is None
    q = np.where(dense.sum(0) == 0, 0.0, 1.0 / np.sqrt(np.maximum(dense.sum(0), 1e-300)))
    gi = dense @ np.diag(q) @ dense.T @ dense @ np.diag(q)
    got = neighbourhood.neighbourhood_scores(R, association="items", task_rows=20).collect()
    assert len(got) == int(np.count_nonzero(gi > 1e-12))
    for r in got:
        assert r.score_item == pytest.approx(gi[r.user_id, r.item_id], rel=1e-9)


def test_every_hot_key_is_split(spark):
    from cofilter.operators.products import hot_keys

    df = spark.range(0, 20_000).selectExpr("id % 4000 AS k", "id AS v")
    hot = hot_keys(df, "k", task_rows=4)
    assert hot.count == 4000 and hot.blocks(4).where("_g = 2").count() == 4000


@pytest.mark.parametrize("symmetric", [False, True])
def test_pair_cells_stay_under_their_limit(spark, symmetric, monkeypatch):
    """A key of 300 rows with blocks of 40: no cell makes more than about 40 x 40
    pairs, and every pair is made once."""
    from pyspark.sql import functions as F

    from cofilter.operators import products

    monkeypatch.setattr(products, "PAIR_ROWS", 40)
    rows = spark.range(300).selectExpr("0L AS k", "id AS a").unionByName(spark.range(5).selectExpr("1L AS k", "id AS a"))
    joined = products.salted_join(rows, rows.withColumnRenamed("a", "b"), "k", "a", split_right="b", symmetric=symmetric,
                                  partitions=64)
    pairs = joined.withColumn("p", F.spark_partition_id())
    got = sorted((r.k, *(sorted((r.a, r.b)) if symmetric else (r.a, r.b))) for r in pairs.collect())
    want = sorted((k, a, b) for k, n in ((0, 300), (1, 5)) for a in range(n) for b in range(n) if not symmetric or a <= b)
    assert got == want
    # 8 x 8 blocks of the hot key: tasks hold a few cells each, none the whole key
    assert pairs.groupBy("p").count().agg(F.max("count")).first()[0] < 0.2 * len(want)


def test_salted_left_join_keeps_unmatched_rows(spark):
    from cofilter.operators.products import salted_join

    left = spark.createDataFrame([(1, j) for j in range(30)] + [(2, 0), (3, 0)], "k long, x long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, y string")
    plain = sorted(tuple(r) for r in left.join(right, "k", "left").collect())
    salted = sorted(tuple(r) for r in salted_join(left, right, "k", "x", task_rows=4,
                                                  how="left").select("k", "x", "y").collect())
    assert salted == plain and len(salted) == 62   # 30 x 2 + 1 + 1 unmatched
