"""Row numbers, exact split, and the three indexing rules."""

import pytest
from pyspark.sql import functions as F

from cofilter.operators import indexing, ordering

ROWS = [(0, "A", "s1"), (1, "A", "s2"), (2, "B", "s1"), (3, "B", "s3"), (4, "C", "s2")]
SCHEMA = "pos long, user_id string, item_id string"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _map(df, key, idx):
    return {r[key]: r[idx] for r in df.collect()}


def test_index_dense(df):
    assert _map(indexing.index_dense(df, "user_id", "i"), "user_id", "i") == {"A": 0, "B": 1, "C": 2}
    assert _map(indexing.index_dense(df, "item_id", "i"), "item_id", "i") == {"s1": 0, "s2": 1, "s3": 2}


def test_index_first_seen(df):
    assert _map(indexing.index_first_seen(df, "user_id", "pos", "i"), "user_id", "i") == {"A": 0, "B": 1, "C": 2}
    assert _map(indexing.index_first_seen(df, "item_id", "pos", "i"), "item_id", "i") == {"s1": 0, "s2": 1, "s3": 2}


def test_index_first_row(df):
    assert _map(indexing.index_first_row(df, "user_id", "pos", "i"), "user_id", "i") == {"A": 0, "B": 2, "C": 4}
    assert _map(indexing.index_first_row(df, "item_id", "pos", "i"), "item_id", "i") == {"s1": 0, "s2": 1, "s3": 3}


def test_ids_stable_on_reread(df):
    a = _map(indexing.index_first_row(df, "item_id", "pos", "i"), "item_id", "i")
    b = _map(indexing.index_first_row(df, "item_id", "pos", "i"), "item_id", "i")
    assert a == b


@pytest.mark.parametrize("parts", [1, 3, 8, 50])
def test_row_number_independent_of_partitions(spark, parts):
    df = spark.range(0, 1000).withColumn("v", (F.col("id") * 7919) % 1000)
    out, n = ordering.with_row_number(df, ["v", "id"], "rn", num_partitions=parts)
    assert n == 1000
    got = {r.id: r.rn for r in out.collect()}
    expect = {i: rank for rank, i in enumerate(sorted(range(1000), key=lambda i: ((i * 7919) % 1000, i)))}
    assert got == expect


@pytest.mark.parametrize("n,first,second", [(10, 7, 3), (5, 3, 2)])
def test_split_exact_sizes(spark, n, first, second):
    df = spark.range(0, n).withColumnRenamed("id", "user_id").withColumn("item_id", F.lit(1))
    a, b = ordering.split_exact(df, 0.7, 41, ["user_id", "item_id"])
    ra, rb = {r.user_id for r in a.collect()}, {r.user_id for r in b.collect()}
    assert (len(ra), len(rb)) == (first, second)
    assert not ra & rb and ra | rb == set(range(n))


def test_head_n(df):
    assert [r.pos for r in ordering.head_n(df, 2, ["pos"]).collect()] == [0, 1]


def test_encode_drops_unknown(spark, df):
    m = spark.createDataFrame([("A", 10), ("B", 11)], "user_id string, uid long")
    out = indexing.encode(df, {"user_id": m}).collect()
    assert sorted(r.uid for r in out) == [10, 10, 11, 11]
