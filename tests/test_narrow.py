"""Few items: kernels in tasks give what the joins give, null keys, repeated rows and all."""

import pytest
from pyspark.sql import functions as F

from cofilter.operators import compressed, narrow, neighbourhood, pruned

SCHEMA = "user_id bigint, item_id bigint, counts double"
PARTS = {"partitions": 4}  # a skew argument asks for the joins


@pytest.fixture(scope="module")
def R(spark):
    cells = spark.range(0, 4000).select((F.col("id") % 400).alias("user_id"), F.pmod(F.xxhash64("id"), F.lit(12)).alias("item_id"),
                                        (F.col("id") % 5 + 1).cast("double").alias("counts")).dropDuplicates(["user_id", "item_id"])
    odd = spark.createDataFrame([(None, 3, 2.0), (7, None, 4.0), (500, None, 1.0)], SCHEMA)
    return cells.unionByName(odd).localCheckpoint()


@pytest.fixture(autouse=True)
def no_walk(monkeypatch):
    """A walk over users would be quadratic in them."""
    for name in ("scores_walk", "score_rows_walk", "top_k_walk"):
        monkeypatch.setattr(compressed, name, lambda *a, **k: pytest.fail("walked"))
    monkeypatch.setattr(narrow, "USERS", 7)


def _rows(df, *keys):
    return {tuple(r[k] for k in keys): [x for n, x in r.asDict().items() if n not in keys] for r in df.collect()}


def _same(got, want, *keys):
    a, b = _rows(got, *keys), _rows(want, *keys)
    assert a.keys() == b.keys() and len(a) > 100
    for k, values in a.items():
        assert values == pytest.approx(b[k])


def test_scores(R):
    _same(neighbourhood.neighbourhood_scores(R), neighbourhood.neighbourhood_scores(R, association="items"), "user_id", "item_id")


@pytest.mark.parametrize("model", ["user", "item", "blend"])
def test_rows(spark, R, model):
    more = spark.createDataFrame([(None, 1, 1.0), (1, None, 1.0), (9999, 1, 1.0), (500, 1, 1.0), (1, 99, 1.0)], SCHEMA)
    rows = R.where("user_id IS NOT NULL AND item_id IS NOT NULL").unionByName(more).withColumn("part", F.lit("x"))
    rows = rows.unionByName(rows.where("user_id = 3"))
    got, want = (neighbourhood.score_pairs(R, rows, model, association=a).groupBy("user_id", "item_id").agg(
        F.count("part").alias("n"), F.max("pred").alias("pred")) for a in ("auto", "items"))
    _same(got, want, "user_id", "item_id")


@pytest.mark.parametrize("model", ["user", "item"])
def test_top_k(R, model):
    want = neighbourhood.scores(R, model, association="items")
    best = pruned.top_k(want, 3).select("user_id", "rank", "item_id", "score")
    _same(pruned.top_k_scores(R, 3, model), best, "user_id", "rank")


def test_user_similarity(R, monkeypatch):
    want = _rows(neighbourhood.item_similarity(R.select(F.col("item_id").alias("user_id"), F.col("user_id").alias("item_id"), "counts")),
                 "item_i", "item_j")
    monkeypatch.setattr(neighbourhood, "item_similarity", lambda *a, **k: pytest.fail("pairs as rows"))
    for size in (1 << 17, 60):
        monkeypatch.setattr(narrow, "PIECE_VALUES", size)
        got = _rows(neighbourhood.user_similarity(R), "user_u", "user_v")
        assert got.keys() == want.keys()
        for k, x in got.items():
            assert x == pytest.approx(want[k])
