"""A wide R by pieces: what the joins give, without a row for each pair of cells."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cofilter.operators import compressed, narrow, neighbourhood, panels, pruned, ranking

SCHEMA = "user_id bigint, item_id bigint, counts double"


@pytest.fixture(scope="module")
def R(spark):
    rng = np.random.default_rng(7)
    cells = {(int(u), int(i)): float(v) for u, i, v in zip(rng.integers(0, 90, 700), rng.integers(0, 120, 700), rng.integers(1, 9, 700), strict=True)}
    cells |= {(500, i): 2.0 for i in range(60)} | {(u, 700): 1.0 for u in range(50)}
    odd = [(None, 3, 2.0), (7, None, 4.0), (600, None, 1.0), (601, 900, 3.0)]
    return spark.createDataFrame([(*k, v) for k, v in cells.items()] + odd, SCHEMA).localCheckpoint()


@pytest.fixture
def wide(monkeypatch):
    monkeypatch.setattr(compressed, "LOCAL_CELLS", 0)
    monkeypatch.setattr(narrow, "narrow_items", lambda R: None)
    for module, name in ((pruned, "cooccurrence"), (neighbourhood, "cooccurrence"), (pruned, "salted_join"), (pruned, "item_similarity")):
        monkeypatch.setattr(module, name, lambda *a, **k: pytest.fail("pairs as rows"))


@pytest.fixture(params=[(1 << 22, 1 << 21), (60, 50)])
def sizes(request, monkeypatch):
    for name, x in zip(("PIECE_CELLS", "PRODUCTS"), request.param, strict=True):
        monkeypatch.setattr(panels, name, x)
    monkeypatch.setattr(panels, "WAITING", 40)


def _sims(df, *more):
    return sorted((r.item_i, r.item_j, *[r[c] for c in more], round(r.sim, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def sims(R):
    return neighbourhood.item_similarity(R).where("item_i <> item_j").localCheckpoint()


def test_nearest(R, sims, sizes, wide):
    want = ranking.top_k(sims, 4, "item_i", "item_j", "sim")
    assert _sims(pruned.nearest(R, 4), "rank") == _sims(want, "rank")


@pytest.mark.parametrize("threshold", [0.05, 2.0, 1e6])
def test_similar(R, sims, sizes, wide, threshold):
    want = _sims(sims.where(F.col("sim") >= threshold))
    assert _sims(pruned.similar_pairs(R, threshold)) == want
    assert threshold > 10 or want


@pytest.mark.parametrize("cheaper", ["users", "items"])
@pytest.mark.parametrize("model", ["user", "item", "blend"])
def test_score_rows(spark, R, sizes, monkeypatch, model, cheaper, request):
    more = spark.createDataFrame([(None, 1, 1.0), (1, None, 1.0), (9999, 1, 1.0), (500, 1, 1.0), (1, 99999, 1.0), (600, 1, 1.0), (7, 3, 5.0)], SCHEMA)
    rows = R.where("user_id IS NOT NULL AND item_id IS NOT NULL").unionByName(more).withColumn("part", F.lit("x"))
    rows = rows.unionByName(rows.where("user_id = 3")).unionByName(rows.crossJoin(spark.range(3)).selectExpr("user_id", "item_id + id AS item_id", "counts", "'y' AS part"))

    def cells(association):
        s = neighbourhood.score_pairs(R, rows, model, association=association)
        assert s.columns == [*rows.columns, "pred"]
        return sorted((str(r.user_id), str(r.item_id), r.part, r.counts, round(r.pred, 6)) for r in s.collect())

    want = cells("items")
    request.getfixturevalue("wide")
    monkeypatch.setattr(neighbourhood, "choose_association", lambda R: cheaper)
    assert cells("auto") == want and any(x[-1] > 0 for x in want)


@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("model", ["user", "item"])
def test_top_k_scores(R, sizes, monkeypatch, model, late, request):
    want = ranking.top_k(neighbourhood.scores(R, model, association="items"), 4)
    want = sorted((r.user_id, r["rank"], r.item_id, round(r.score, 6)) for r in want.where("score > 0 AND item_id IS NOT NULL").collect())
    request.getfixturevalue("wide")
    monkeypatch.setattr(panels, "WEIGHTS", 300)
    if late:  # items that come before the users wait
        met = panels.met
        monkeypatch.setattr(panels, "met", lambda held, streamed, *a: met(held, streamed.orderBy(F.xxhash64("m")), *a))
    out = pruned.top_k_scores(R, 4, model)
    assert sorted((r.user_id, r["rank"], r.item_id, round(r.score, 6)) for r in out.collect()) == want and len(want) > 300


def test_no_cell_with_both_keys(spark, wide):
    R = spark.createDataFrame([(None, 1, 2.0), (3, None, 1.0)], SCHEMA)
    out = neighbourhood.score_pairs(R, R, "item").collect()
    assert [r.pred for r in out] == [0.0, 0.0] and pruned.nearest(R, 3).count() == pruned.similar_pairs(R, 1.0).count() == 0
    assert pruned.top_k_scores(R, 3).count() == 0


def test_a_held_piece_comes_once(spark):
    """However many pieces pass, Python gets the held one with the first."""
    def table(n, m):
        return panels._kept(spark.range(n).selectExpr("CAST(id AS INT) AS no", f"CAST(concat('{m}', id) AS BINARY) AS m").repartition(n, "no"))

    def run(batches):
        for batch in batches:
            came = [0 if m is None else 1 for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(came, pa.int32()), batch.column(2)], names=["no", "came", "ms"])

    got = panels.met(table(3, "h"), table(5, "s"), run, "no int, came int, ms binary").collect()
    assert len(got) == len({(r.no, bytes(r.ms)) for r in got}) == 15
    assert sorted(r.no for r in got if r.came) == [0, 1, 2]


def test_rows_to_score_count_in_a_held_piece(R, monkeypatch, request):
    """A piece that a task holds is bounded by its cells and rows together."""
    rows = R.where("user_id IS NOT NULL AND item_id IS NOT NULL")
    cells = rows.count()
    want = sorted((r.user_id, r.item_id, round(r.pred, 6)) for r in neighbourhood.score_pairs(R, rows, "item", association="items").collect())
    request.getfixturevalue("wide")
    monkeypatch.setattr(panels, "HELD_ROWS", 50)
    seen, met = [], panels.met
    monkeypatch.setattr(panels, "met", lambda held, streamed, *a: seen.append(held.count()) or met(held, streamed, *a))
    got = sorted((r.user_id, r.item_id, round(r.pred, 6)) for r in neighbourhood.score_pairs(R, rows, "item").collect())
    assert got == want and len(want) == cells
    # some of so many partitions stay empty
    assert sum(seen) > cells / 50
