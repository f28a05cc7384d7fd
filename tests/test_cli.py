"""The command line on the FIXTURES hand matrix, in the reference's formats."""

import os

import pytest

from cofilter import cli
from cofilter.session import scratch_path


def _local(p):
    return p[len("file:"):] if p.startswith("file:") else p


def _file(spark, name, text):
    d = _local(scratch_path(spark, name))
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "part-00000.txt"), "w") as fh:
        fh.write(text)
    return d


def test_evaluate_item_model(spark):
    a = _file(spark, "cli-a", "A\tx\t1\nA\ty\t3\n")
    b = _file(spark, "cli-b", "B\ty\t2\nC\tx\t1\nC\tz\t4\n")
    t = _file(spark, "cli-t", "A\tz\t2\nB\tx\t1\nC\ty\t3\nD\tx\t5\n")
    out = {(r.part, r.metric): r.value for r in
           cli.run(spark, ["evaluate", "--train", a, b, "--test", t, "--model", "item"]).collect()}
    assert out[("test", "rmse")] == pytest.approx(2.754828, abs=1e-6)
    assert out[("test", "n")] == 4 and out[("train", "n")] == 5


def test_evaluate_head_and_last_write(spark):
    a = _file(spark, "cli-h", "A\tx\t1\nA\tx\t7\nB\tx\t2\n")
    t = _file(spark, "cli-ht", "B\tx\t1\n")
    out = {(r.part, r.metric): r.value for r in
           cli.run(spark, ["evaluate", "--train", a, "--test", t, "--head", "2"]).collect()}
    assert out[("train", "n")] == 2          # head keeps the first two lines
    assert out[("test", "rmse")] == pytest.approx(1.0)   # B has no training row: 0 predicted


def test_recommend_user_model(spark):
    m = _file(spark, "cli-m", "1 3 0\n0 2 0\n1 0 4\n0 0 0\n")
    t = _file(spark, "cli-ti", "Show X\nShow Y\nShow Z\n")
    rows = cli.run(spark, ["recommend", "--matrix", m, "--titles", t, "--user", "0",
                           "--candidates", "3", "--model", "user"]).collect()
    assert [r.title for r in rows] == ["Show Y", "Show X", "Show Z"]
    assert [round(r.score, 6) for r in rows] == [11.742641, 2.723607, 0.894427]


def test_recommend_svd(spark):
    m = _file(spark, "cli-ms", "1 3 0\n0 2 0\n1 0 4\n0 0 0\n")
    t = _file(spark, "cli-ts", "Show X\nShow Y\nShow Z\n")
    rows = cli.run(spark, ["recommend", "--matrix", m, "--titles", t, "--user", "0",
                           "--candidates", "3", "--model", "svd", "--k", "2"]).collect()
    assert [round(r.score, 6) for r in rows] == [3.061601, 0.738712, 0.066465]


def test_export_split_sizes(spark):
    text = "".join(f"u{j % 3}\ts{j % 4}\t{j + 1}\n" for j in range(10))
    src = _file(spark, "cli-x", text)
    tr, te = scratch_path(spark, "cli-xtr"), scratch_path(spark, "cli-xte")
    cli.run(spark, ["export", "--input", src, "--out-train", tr, "--out-test", te])
    assert spark.read.csv(tr, sep="\t").count() == 7
    assert spark.read.csv(te, sep="\t").count() == 3


def test_als_writes_result_line(spark):
    rows = "".join(f"u{u}\ts{i}\t{1 + (u * i) % 5}\n" for u in range(12) for i in range(8) if (u + i) % 3)
    a = _file(spark, "cli-als", rows)
    t = _file(spark, "cli-alst", "u1\ts1\t2\nu2\ts3\t1\nzz\ts1\t4\n")
    out = scratch_path(spark, "cli-als-out")
    r = cli.run(spark, ["als", "--train", a, "--test", t, "--out", out, "--rank", "3",
                        "--iters", "5"]).first()
    assert r.test_count == 2
    line = spark.read.text(out).first().value.split(",")
    assert len(line) == 3 and int(line[2]) == 2
