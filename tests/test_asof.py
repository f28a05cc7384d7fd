"""As-of rows, counts and pairs within a stretch of time against brute force, with cells
and blocks so small that keys cross many borders."""

import random

import pytest

from cofilter.operators import asof

LEFT = "id int, key int, at int"
RIGHT = "rid int, key int, at int, v double"


def sides(seed):
    rnd = random.Random(seed)
    times = [None, *range(40)]
    left = [(i, rnd.choice([None, 1, 1, 1, 2, 3]), rnd.choice(times)) for i in range(200)]
    right = [(1000 + i, rnd.choice([None, 1, 1, 1, 2]), rnd.choice(times), rnd.choice([None, 1.0, 2.0])) for i in range(150)]
    return left, right


def matching(row, right, test):
    _, key, at = row
    return [] if key is None or at is None else [r for r in right if r[1] == key and r[2] is not None and test(r[2], at)]


@pytest.mark.parametrize("strict,cell_rows", [(True, 7), (False, 7), (True, 1), (False, 10_000)])
def test_as_of(spark, strict, cell_rows):
    left, right = sides(1)
    out = asof.as_of(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "key", "at",
                     {"last": "rid", "value": "v"}, order="rid", strict=strict, count="n", cell_rows=cell_rows)
    assert out.columns == ["id", "key", "at", "last", "value", "n"]
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(left)
    for row in left:
        facts = matching(row, right, lambda r, t: r < t or (not strict and r == t))
        best = max(facts, key=lambda r: (r[2], r[0]), default=(None, None, None, None))
        r = got[row[0]]
        assert (r.key, r.at, r.last, r.value, r.n) == (*row[1:], best[0], best[3], len(facts))


def test_count_and_pairs_within(spark):
    left, right = sides(2)
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    want = {row[0]: [r[0] for r in matching(row, right, lambda r, t: t - 5 <= r < t)] for row in left}
    got = {r.id: r.n for r in asof.count_within(a, b, "key", "at", 5, "id", cell_rows=7).collect()}
    assert got == {i: len(r) for i, r in want.items()}
    pairs = sorted((i, r) for i, rs in want.items() for r in rs)
    for task_rows in (3, 10_000):
        out = asof.range_pairs(a, b, "key", "at", 5, "id", "rid", task_rows=task_rows)
        assert sorted(map(tuple, out.collect())) == pairs


def test_empty_sides_repeated_rows_and_clashing_names(spark):
    left = spark.createDataFrame([(1, 1, 5, 0.5), (1, 1, 5, 0.5)], "id int, key int, at int, v double")
    right = spark.createDataFrame([(9, 1, 4, 2.0), (9, 1, 4, 2.0)], RIGHT)
    out = asof.as_of(left, right, "key", "at", {"last": "v"}, count="n").collect()
    assert [tuple(r) for r in out] == [(1, 1, 5, 0.5, 2.0, 2)] * 2
    none = asof.as_of(left, right.limit(0), "key", "at", {"last": "v"}, count="n").collect()
    assert [tuple(r) for r in none] == [(1, 1, 5, 0.5, None, 0)] * 2
    assert asof.as_of(left.limit(0), right, "key", "at", {"last": "v"}).count() == 0
    assert asof.range_pairs(left, right.limit(0), "key", "at", 5, "id", "rid").count() == 0


def test_one_key_fills_many_cells(spark):
    """A key with nearly all rows: no window holds more of them than a cell."""
    n = 3_000
    left = spark.range(n).selectExpr("id", "0 AS key", "2 * id AS at")
    right = spark.range(n).where("id % 100 = 0").selectExpr("id AS rid", "0 AS key", "2 * id - 1 AS at", "1.0D AS v")
    out = asof.as_of(left, right, "key", "at", {"last": "rid"}, count="n", cell_rows=50).collect()
    assert all(r["last"] == r.id // 100 * 100 and r.n == r.id // 100 + 1 for r in out) and len(out) == n
