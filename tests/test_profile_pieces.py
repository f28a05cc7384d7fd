"""Merged profiles equal the profile of all rows: exactly where they count, within the
stated bounds where they sketch."""

from pyspark.sql import functions as F

from cofilter.operators import profile_pieces as pp
from cofilter.session import scratch_path

IDS = ["user_id", "item_id"]


def rows(spark, n=40_000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), (F.col("id") % 7).alias("day"),
        (F.xxhash64("id") % 5_000).alias("user_id"), F.when(F.col("id") % 11 > 0, F.col("id") % 90).alias("item_id"),
        F.when(F.col("id") % 13 > 0, F.pmod(F.xxhash64(F.col("id") + 1), F.lit(100_000)) / 100).alias("value"))


def test_merge_equals_whole(spark):
    df = rows(spark).cache()
    pieces = pp.profile_pieces(df, ["kind", "day"], "value", IDS)
    got = {(r.kind, r.day, r.level): r for r in pp.merge_profiles(pieces, ["kind", "day"], IDS, cube=True).collect()}
    exact = df.cube("kind", "day").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.sum("value").alias("total"),
        F.min("value").alias("low"), F.max("value").alias("high"), *[F.countDistinct(c).alias(f"n_{c}") for c in IDS],
        *[F.expr(f"percentile(value, array({q} - {pp.RANK_BOUND}, {q} + {pp.RANK_BOUND}))").alias(f"q{round(q * 100)}")
          for q in (0.25, 0.5, 0.75)]).collect()
    assert len(exact) == len(got) == 3 * 8
    for e in exact:
        g = got[(e.kind, e.day, e.level)]
        assert (g.n, g.n_values, g.low, g.high) == (e.n, e.n_values, e.low, e.high) and abs(g.total - e.total) < 1e-4
        for c in IDS:
            assert abs(g[f"n_{c}"] - e[f"n_{c}"]) <= pp.DISTINCT_BOUND * e[f"n_{c}"]
        for q in ("q25", "q50", "q75"):
            assert e[q][0] <= g[q] <= e[q][1]
    df.unpersist()


def test_batches_add_up_and_a_retried_batch_replaces_itself(spark):
    df, store = rows(spark, 2_000), scratch_path(spark, "profiles")
    for batch, part in (("one", "day < 3"), ("two", "day >= 3"), ("two", "day >= 3")):
        pp.store_profiles(pp.profile_pieces(df.where(part), ["kind", "day"], "value", IDS), store, batch)
    out = pp.merge_profiles(pp.read_profiles(spark, store), ["kind"], IDS)
    assert {r.kind: r.n for r in out.collect()} == {r.kind: r["count"] for r in df.groupBy("kind").count().collect()}


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1, None, None), (None, 1, None, float("nan")), ("a", 2, 5, 3.0)],
                               "kind string, user_id int, item_id int, value double")
    out = {r.kind: r for r in pp.merge_profiles(pp.profile_pieces(df, ["kind"], "value", IDS), ["kind"], IDS).collect()}
    assert (out[None].n, out[None].n_values, out[None].total, out[None].n_item_id, out[None].q50) == (2, 0, None, 0, None)
    assert (out["a"].n_values, out["a"].low, out["a"].q50, out["a"].n_user_id) == (1, 3.0, 3.0, 1)
    assert pp.merge_profiles(pp.profile_pieces(df.limit(0), ["kind"], "value", IDS), ["kind"], IDS).count() == 0
