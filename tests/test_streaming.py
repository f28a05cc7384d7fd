"""The streamed matrix against the batch one; the growing dictionary."""

import os

from pyspark.sql import functions as F

from cofilter.operators import dictionary, matrix
from cofilter.streaming import matrix as stream

SCHEMA = "event_id long, user_id long, item_id long, value double"


def test_batches_late_and_repeated_rows(spark, tmp_path):
    rows = [(i, i % 5, (i * 7) % 4, float((i * 31) % 50) - 10) for i in range(120)]
    landings = [rows[40:80], rows[:40] + rows[45:60], rows[80:] + rows[:10], rows[:5], []]
    source, store = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for landing in landings:
        df = spark.createDataFrame(landing, SCHEMA)
        df.coalesce(1).write.mode("append").parquet(source)
        stream.update_matrix(spark, source, df.schema, store)
        seen += landing
        whole = matrix.last_write(spark.createDataFrame(seen, SCHEMA), ("user_id", "item_id"), "value", ("event_id",))
        want = {(r.user_id, r.item_id): r.value for r in whole.collect()}
        assert {(r.user_id, r.item_id): r.value for r in stream.read_matrix(spark, store).collect()} == want
        sums = {("user", u): 0.0 for u, _ in want} | {("item", i): 0.0 for _, i in want}
        for (u, i), v in want.items():
            sums["user", u] += v
            sums["item", i] += v
        got = {(r.side, r.key): round(r.total, 9) for r in stream.read_sums(spark, store).collect()}
        assert got == {k: round(v, 9) for k, v in sums.items()}


def test_a_batch_tried_again_changes_nothing(spark, tmp_path):
    store = str(tmp_path)
    write = stream._upsert(store)
    cells = "user_id long, item_id long, value double, order long"
    write(spark.createDataFrame([(1, 1, 2.0, 1), (1, 2, 3.0, 2)], cells), 0)
    second = spark.createDataFrame([(1, 1, 5.0, 9), (2, 2, 1.0, 8)], cells)
    for _ in range(2):
        write(second, 1)
        assert {(r.user_id, r.item_id): r.value for r in stream.read_matrix(spark, store).collect()} == {(1, 1): 5.0, (1, 2): 3.0, (2, 2): 1.0}
        assert {(r.side, r.key): r.total for r in stream.read_sums(spark, store).collect()} == {
            ("user", 1): 8.0, ("user", 2): 1.0, ("item", 1): 5.0, ("item", 2): 4.0}


def test_dictionary_only_grows(spark, tmp_path):
    path = str(tmp_path / "ids")
    keys = [["b", "d", None, "b"], ["a", "d"], [], ["e", "c", "a", "b"]]
    before: dict = {}
    for part in keys:
        got = {r.key: r.id for r in dictionary.extend_dictionary(spark.createDataFrame([(k,) for k in part], "k string"), "k", path).collect()}
        assert all(got[k] == i for k, i in before.items())
        assert sorted(got.values()) == list(range(len(got)))
        before = got
    assert set(before) == set("abcde") and before["b"] == 0 and before["a"] == 2
    assert sorted(d for d in os.listdir(path) if d.startswith("part")) == ["part=0", "part=1", "part=2"]
    empty = dictionary.extend_dictionary(spark.range(0).select(F.col("id")), "id", str(tmp_path / "none"))
    assert empty.count() == 0
