"""Event pieces come from the data: a type nobody named keeps its rows."""

import re

import pytest

from cofilter.plans.catalog import queries


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rows = [(i, kind, 10 + i % 3, '{"k": %d}' % (i % 4), 1.0 * i)
            for i, kind in enumerate(["click", "error", "purchase", "signup", "view", "zoom"] * 4)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, props string, value double").write.parquet(
        f"{path}/events.parquet")
    return path


def test_sixth_type_keeps_its_rows(spark, sf):
    got = queries()["union_train"](spark, sf)
    assert {r.src_ord for r in got.collect()} == set(range(6))
    assert got.agg({"counts": "sum"}).first()[0] == 24
    back = queries()["read_sources"](spark, sf)
    assert {r.src_ord for r in back.collect()} == set(range(6)) and back.agg({"counts": "sum"}).first()[0] == 24


def test_universe_reads_events_once(spark, sf):
    df = queries()["universe"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 1
    assert sorted(tuple(r) for r in df.collect()) == [("item", k) for k in range(4)] + [("user", k) for k in (10, 11, 12)]


def test_part_files_in_numeric_order(spark, tmp_path):
    from cofilter.sources import files

    for name, text in (("part-99999", "a\n"), ("part-100000", "b\n"), ("part-100001", "c\n")):
        (tmp_path / name).write_text(text)
    assert [r.title for r in files.read_titles(spark, str(tmp_path)).orderBy("item_idx").collect()] == ["a", "b", "c"]


def test_frequent_value_spreads_over_ranges(spark):
    from cofilter.operators.profile import exact_quantiles

    df = spark.range(1000).selectExpr("if(id < 900, 1, id) AS v")
    assert exact_quantiles(df, "v") == {0.25: 1.0, 0.5: 1.0, 0.75: 1.0}


def test_constant_user_is_undefined_for_any_size(spark):
    from pyspark.sql import functions as F

    from cofilter.operators.metrics import pearson_by_group

    big = spark.range(3_000_001).select(F.lit(1).alias("g"), F.lit(1500001.0).alias("x"), F.col("id").cast("double").alias("y"))
    assert pearson_by_group(big, "g", "x", "y").first().rho is None
