"""Selection by counting against sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cofilter.functions.scalar import md5_order_key
from cofilter.operators import ordering, selection


def values(spark, xs, parts=5):
    return spark.createDataFrame([(x,) for x in xs], "v double").repartition(parts)


@pytest.mark.parametrize("few", [4096, 3])
@pytest.mark.parametrize("kind", ["normal", "skewed", "ties", "one", "ends", "neighbours"])
def test_kth_values(spark, monkeypatch, few, kind):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BUCKETS", 8)
    rng = np.random.default_rng(1)
    xs = {"normal": rng.normal(size=300), "skewed": rng.lognormal(0, 9, 300), "ties": rng.integers(0, 3, 300).astype(float), "one": [7.0] * 50,
          "ends": [-1e308, 1e308, 5e-324, 0.0, 1e-320, 3.0, 3.0, -math.inf, math.inf, math.inf],
          "neighbours": [1.0, math.nextafter(1, 2)] * 20 + [math.nextafter(1, 0)] * 5}[kind]
    xs = [float(x) for x in xs]
    ranks = sorted({0, 1, len(xs) // 4, len(xs) // 2, len(xs) - 2, len(xs) - 1})
    got = selection.kth_values(values(spark, xs), "v", [*ranks, len(xs), -1])
    assert got == {r: sorted(xs)[r] for r in ranks}


def test_nulls_and_nan(spark):
    got = selection.kth_values(values(spark, [None, 2.0, float("nan"), 1.0, None]), "v", [0, 1, 2, 3])
    assert got[0] == 1.0 and got[1] == 2.0 and math.isnan(got[2]) and 3 not in got
    assert selection.kth_values(values(spark, [None]), "v", [0]) == {}


@pytest.mark.parametrize("few", [4096, 5])
@pytest.mark.parametrize("frac", [0, 0.3, 0.7, 1])
def test_split_is_that_of_the_sorted_rows(spark, monkeypatch, few, frac):
    monkeypatch.setattr(selection, "FEW", few)
    df = spark.range(700).select(F.col("id").alias("user_id"), (F.col("id") % 7).alias("item_id"), F.lit(1.0).alias("counts")).repartition(6)
    a, b = ordering.split_exact(df, frac, 41, ["user_id", "item_id"])
    numbered, n = ordering.with_row_number(df.withColumn("k", md5_order_key(["user_id", "item_id"], 41)), ["k", "user_id"], "r")
    cut = ordering.exact_floor(frac, n)
    assert {r.user_id for r in a.collect()} == {r.user_id for r in numbered.where(F.col("r") < cut).collect()}
    assert a.count() == cut and a.union(b).exceptAll(df).count() == 0 and b.count() == n - cut


def test_split_of_equal_rows_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1)] * 10 + [(5, None)] * 10 + [(6, 6)] * 3, "user_id long, item_id long")
    a, b = ordering.split_exact(df, 0.5, 41, ["user_id", "item_id"])
    assert (a.count(), b.count()) == (11, 12) and a.union(b).exceptAll(df).count() == 0
    empty = ordering.split_exact(df.where("user_id = 0"), 0.5, 41, ["user_id"])
    assert [x.count() for x in empty] == [0, 0]


def test_no_range_exchange(spark, capsys):
    df = spark.range(2000).select(F.col("id").alias("user_id"))
    ordering.split_exact(df, 0.7, 41, ["user_id"])[0].explain()
    assert "rangepartitioning" not in capsys.readouterr().out
