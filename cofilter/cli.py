"""Command line for the reference's own file layouts.

  python -m cofilter.cli evaluate  --train A.txt B.txt --test C.txt [--model item|user|blend]
                                   [--head 10000 10000 2000] [--test-head 2000] [--log]
  python -m cofilter.cli als       --train A.txt B.txt --test C.txt --out result
                                   [--rank 10 --iters 10 --reg 0.01] [--head ...] [--log]
  python -m cofilter.cli recommend --matrix user-shows.txt --titles shows.txt --user 499
                                   [--candidates 100] [--model user|item|svd] [--k 320]
  python -m cofilter.cli export    --input triples.txt --out-train T --out-test E
                                   [--head 1000] [--frac 0.7] [--seed 41]

Inputs are headerless TSV triples (user, item, count), the dense
whitespace matrix and the title list; every step runs as Spark jobs on the
session's cluster. ``--head`` keeps the first n lines of each file in file
order, as the reference's row caps do."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofilter.functions.scalar import log_scale_col
from cofilter.operators import factor, indexing, neighbourhood, ordering, ranking
from cofilter.plans import evaluation
from cofilter.sources import files

U, I, V = "user_id", "item_id", "counts"


def ordered_triples(spark: SparkSession, path: str, head: int | None = None) -> DataFrame:
    """Triples with their 0-based line position (row_no) in file order."""
    raw = files.read_triples(spark, path).select(
        U, I, F.col(V).cast("double").alias(V),
        F.length("_metadata.file_path").alias("_n"),
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"))
    order = ["_n", "_f", "_b", "_m"]
    if head is not None:  # the first lines only, before anything is sorted in full
        raw = raw.orderBy(*order).limit(head)
    numbered, _ = ordering.with_row_number(raw, order, "row_no")
    return numbered.drop(*order)


def training_set(spark: SparkSession, paths: list[str], heads: list[int] | None) -> DataFrame:
    """Bag union of the training files tagged (src_ord, row_no)."""
    out = None
    for j, p in enumerate(paths):
        h = heads[j] if heads and j < len(heads) else None
        t = ordered_triples(spark, p, h).withColumn("src_ord", F.lit(j).cast("int"))
        out = t if out is None else out.unionByName(t)
    return out


def _maybe_log(df: DataFrame, log: bool) -> DataFrame:
    return df.withColumn(V, log_scale_col(V)) if log else df


def cmd_evaluate(spark: SparkSession, a) -> DataFrame:
    train = _maybe_log(training_set(spark, a.train, a.head), a.log)
    test = _maybe_log(ordered_triples(spark, a.test, a.test_head), a.log)
    scored = evaluation.scored_parts(train, test.select(U, I, V), a.model, order=("src_ord", "row_no"))
    return evaluation.metrics_long(scored)


def cmd_als(spark: SparkSession, a) -> DataFrame:
    train = training_set(spark, a.train, a.head).select(U, I, V)
    test = ordered_triples(spark, a.test, a.test_head).select(U, I, V)
    res, m = evaluation.als_evaluate(train, test, rank=a.rank, max_iter=a.iters, reg=a.reg,
                                     seed=a.seed, log_scale=a.log)
    wide = m.groupBy().pivot("part", ["train", "test"]).agg(F.first("rmse"))
    row = wide.select(F.col("train").alias("train_rmse"), F.col("test").alias("test_rmse"),
                      F.lit(res.test_count).cast("bigint").alias("test_count"))
    if a.out:
        files.write_metrics_line(row, ["train_rmse", "test_rmse", "test_count"], a.out)
    return row


def cmd_recommend(spark: SparkSession, a) -> DataFrame:
    R = (files.read_dense_matrix(spark, a.matrix)
         .select(F.col("row_idx").alias(U), F.col("col_idx").alias(I), F.col("value").alias(V)))
    titles = files.read_titles(spark, a.titles).select(F.col("item_idx").alias(I), "title")
    cands = (spark.range(a.candidates).select(F.col("id").alias(I))
             .join(R.select(I).distinct(), I, "left_semi") if a.only_seen_items
             else spark.range(a.candidates).select(F.col("id").alias(I)))
    pairs = cands.withColumn(U, F.lit(a.user).cast("bigint"))
    if a.model == "svd":
        s = factor.svd_scores(R, factor.svd_fit(R), a.k, pairs)
    else:
        s = neighbourhood.scores(R, a.model, pairs)
    scored = pairs.join(s, [U, I], "left").select(I, F.coalesce("score", F.lit(0.0)).alias("score"))
    ranked = ranking.ranked_list(scored.withColumn("model", F.lit(a.model)), group="model")
    return ranking.with_titles(ranked, titles).select("rank", "score", I, "title").orderBy("rank")


def cmd_export(spark: SparkSession, a) -> DataFrame:
    rows = ordered_triples(spark, a.input, a.head).withColumn("log_target", log_scale_col(V))
    uid = indexing.index_first_row(rows, U, "row_no", "user_idx")
    iid = indexing.index_first_row(rows, I, "row_no", "item_idx")
    enc = indexing.encode(rows.select("row_no", U, I, "log_target"), {U: uid, I: iid})
    train, test = ordering.split_exact(enc, a.frac, a.seed, ["row_no"])
    cols = ["user_idx", "item_idx", "log_target"]
    files.write_tsv(train.select(*cols), a.out_train)
    files.write_tsv(test.select(*cols), a.out_test)
    return train.select(*cols)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cofilter")
    sub = p.add_subparsers(dest="cmd", required=True)
    e = sub.add_parser("evaluate")
    e.add_argument("--train", nargs="+", required=True)
    e.add_argument("--test", required=True)
    e.add_argument("--model", default="item", choices=["item", "user", "blend"])
    e.add_argument("--head", nargs="*", type=int)
    e.add_argument("--test-head", type=int)
    e.add_argument("--log", action="store_true")
    s = sub.add_parser("als")
    s.add_argument("--train", nargs="+", required=True)
    s.add_argument("--test", required=True)
    s.add_argument("--out")
    s.add_argument("--rank", type=int, default=10)
    s.add_argument("--iters", type=int, default=10)
    s.add_argument("--reg", type=float, default=0.01)
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--head", nargs="*", type=int)
    s.add_argument("--test-head", type=int)
    s.add_argument("--log", action="store_true")
    r = sub.add_parser("recommend")
    r.add_argument("--matrix", required=True)
    r.add_argument("--titles", required=True)
    r.add_argument("--user", type=int, required=True)
    r.add_argument("--candidates", type=int, default=100)
    r.add_argument("--model", default="user", choices=["user", "item", "svd"])
    r.add_argument("--k", type=int, default=320)
    r.add_argument("--only-seen-items", action="store_true")
    x = sub.add_parser("export")
    x.add_argument("--input", required=True)
    x.add_argument("--out-train", required=True)
    x.add_argument("--out-test", required=True)
    x.add_argument("--head", type=int)
    x.add_argument("--frac", type=float, default=0.7)
    x.add_argument("--seed", type=int, default=41)
    return p


COMMANDS = {"evaluate": cmd_evaluate, "als": cmd_als, "recommend": cmd_recommend,
            "export": cmd_export}


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    a = parser().parse_args(argv)
    return COMMANDS[a.cmd](spark, a)


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("cofilter").getOrCreate()
    out = run(spark, sys.argv[1:] if argv is None else argv)
    print(*out.columns, sep="\t")
    for row in out.toLocalIterator():
        print(*row, sep="\t")


if __name__ == "__main__":
    main()
