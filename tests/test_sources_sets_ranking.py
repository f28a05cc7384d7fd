"""File formats, set operations, ranking and profiling."""

import os

import pytest
from pyspark.sql import functions as F

from cofilter.operators import profile, ranking, sets
from cofilter.session import scratch_path
from cofilter.sources import files


def _write(path, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-00000.txt"), "w") as fh:
        fh.write(text)


def _local(p):
    return p[len("file:"):] if p.startswith("file:") else p


def test_dense_text_to_long(spark):
    p = _local(scratch_path(spark, "dense-test"))
    _write(p, "1 0 1\n0 1 0\n")
    got = sorted((r.row_idx, r.col_idx, r.value) for r in files.read_dense_matrix(spark, p).collect())
    assert got == [(0, 0, 1.0), (0, 2, 1.0), (1, 1, 1.0)]


def test_titles_trailing_newline(spark):
    p = _local(scratch_path(spark, "titles-test"))
    _write(p, "Show A\nShow B\nShow C\n")
    got = [(r.item_idx, r.title) for r in files.read_titles(spark, p).orderBy("item_idx").collect()]
    assert got == [(0, "Show A"), (1, "Show B"), (2, "Show C")]


def test_malformed_lines(spark):
    p = _local(scratch_path(spark, "bad-test"))
    _write(p, "u1\ts1\t3\nu2\ts2\nu3\ts3\tx\n\nu4\ts4\t5\n")
    ok = files.read_triples(spark, p, mode="DROPMALFORMED").collect()
    assert sorted(r.user_id for r in ok) == ["u1", "u4"]
    with pytest.raises(Exception):
        files.read_triples(spark, p, mode="FAILFAST").collect()


def test_tsv_round_trip(spark):
    df = spark.createDataFrame([("a", "s", 1), ("b", "t", 2)], "user_id string, item_id string, counts int")
    p = scratch_path(spark, "rt")
    files.write_tsv(df, p)
    assert sorted(files.read_triples(spark, p).collect()) == sorted(df.collect())


def test_head_lines_in_file_order(spark):
    p = _local(scratch_path(spark, "head-test"))
    os.makedirs(p, exist_ok=True)
    for k in range(3):
        with open(os.path.join(p, f"part-{k:05d}.txt"), "w") as fh:
            fh.write("".join(f"u{k}_{j}\ts{j}\t{j}\n" for j in range(4)))
    got = [r.user_id for r in files.head_triples(spark, p, 6).collect()]
    assert got == ["u0_0", "u0_1", "u0_2", "u0_3", "u1_0", "u1_1"]


def test_metrics_line(spark):
    df = spark.createDataFrame([(1.5, 2.5, 3)], "a double, b double, c long")
    assert files.metrics_line(df, ["a", "b", "c"]).first().value == "1.5,2.5,3"


def test_union_universe_same_keys(spark):
    a = spark.createDataFrame([(0, "A", "x"), (1, "B", "y")], "pos long, user_id string, item_id string")
    b = spark.createDataFrame([(0, "B", "x"), (1, "A", "z")], "pos long, user_id string, item_id string")
    u = sets.union_sources([a, b])
    assert u.count() == 4 and sorted({r.src_ord for r in u.collect()}) == [0, 1]
    assert sorted(r.item_id for r in sets.universe([a, b], "item_id").collect()) == ["x", "y", "z"]
    r = sets.same_keys(a, b, "user_id", "pos").first()
    assert (r.same_set, r.same_order, r.n_left, r.n_right) == (True, False, 2, 2)
    r2 = sets.same_keys(a, a, "user_id", "pos").first()
    assert r2.same_order is True


def test_top_k_tie_rule(spark):
    s = spark.createDataFrame([("u", 3, 1.0), ("u", 1, 1.0), ("u", 2, 2.0), ("u", 4, 0.5)],
                              "user_id string, item_id long, score double")
    got = [(r.rank, r.item_id) for r in ranking.top_k(s, 3).orderBy("rank").collect()]
    assert got == [(1, 2), (2, 1), (3, 3)]
    k2 = {r.item_id for r in ranking.top_k(s, 2).collect()}
    k3 = {r.item_id for r in ranking.top_k(s, 3).collect()}
    assert k2 <= k3


def test_describe_matches_pandas(spark):
    vals = [1.0, 2.0, 4.0, 10.0, 7.0]
    df = spark.createDataFrame([(v,) for v in vals], "counts double")
    r = profile.describe(df, "counts").first()
    import pandas as pd
    d = pd.Series(vals).describe()
    assert r["count"] == 5 and r["std"] == pytest.approx(d["std"])
    assert (r.p25, r.p50, r.p75) == pytest.approx((d["25%"], d["50%"], d["75%"]))
