"""Sparse matrix products as joins, safe against hot keys.

A product over a shared index k joins the two sides on k and sums the
products per output cell. Catalyst pipelines join -> partial aggregate in
one stage, so the products of a task are combined before any shuffle; how much
that saves depends on how often a task meets the same output cell.

A hot key (one user holding a large share of all rows) would put its whole
group into one task. Keys are split by their degree. In a lookup (the right side
has a row for each key) the left rows of a key with more than ``TASK_ROWS`` rows are
spread over buckets by a hash of another column and the right row is copied to
each. In a pair-generating join a key with d rows is cut into
g = ceil(d / ``PAIR_ROWS``) blocks on *both* sides, and block i of the left meets
block j of the right in cell (i, j), which makes at most about
``PAIRS_PER_TASK`` products; a symmetric product only makes the cells i <= j. The
number of keys split is at most Σ d² / PAIRS_PER_TASK; their table is
broadcast if it is small by count and joined by a shuffle if not. No row is
dropped or sampled: the result is exact.

Exactness has a price the data sets: a co-occurrence needs Σ deg² products
(a user with d items contributes d² pairs)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.session import scratch_path

TASK_ROWS = 200_000
PAIRS_PER_TASK = 20_000_000   # pair products one task sums in a few seconds
PAIR_ROWS = math.isqrt(PAIRS_PER_TASK)
BROADCAST_KEYS = 100_000


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def default_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pair_partitions(spark, pair_count: float | None) -> int:
    """Partitions for a pair-generating join: enough that each task makes
    about PAIRS_PER_TASK products, and at least one task per core of the
    cluster (``defaultParallelism``). The pair count is Σ deg² of the join
    key (one aggregate)."""
    base = max(1, spark.sparkContext.defaultParallelism)
    return max(base, math.ceil((pair_count or 0) / PAIRS_PER_TASK))


@dataclass
class HotKeys:
    """Keys with more rows than a threshold: a table (keys, _deg), their number
    and the largest degree. No table where no key is above it."""

    table: DataFrame | None
    count: int
    top: int

    def on(self, *names: str) -> HotKeys:
        """The same keys under other column names."""
        return self if self.table is None else HotKeys(self.table.toDF(*names, "_deg"), self.count, self.top)

    def blocks(self, limit: int) -> DataFrame | None:
        """(keys, _g): the keys above ``limit`` rows, in blocks of at most that many."""
        if self.table is None or self.top <= limit:
            return None
        g = self.table.where(F.col("_deg") > limit).withColumn("_g", F.ceil(F.col("_deg") / limit).cast("int")).drop("_deg")
        return F.broadcast(g) if self.count <= BROADCAST_KEYS else g


def _stored_hot(deg: DataFrame, keys: list[str], threshold: int) -> HotKeys:
    hot = deg.where(F.col("_deg") > int(threshold)).select(*keys, "_deg")
    size = hot.agg(F.count(F.lit(1)).alias("n"), F.max("_deg").alias("top")).first()
    if not size["n"]:
        return HotKeys(None, 0, 0)
    path = scratch_path(deg.sparkSession, "hot")
    hot.write.parquet(path)
    return HotKeys(deg.sparkSession.read.schema(hot.schema).parquet(path), size["n"], size["top"])


def hot_keys(df: DataFrame, key, task_rows: int = TASK_ROWS) -> HotKeys:
    """The keys that hold more than ``task_rows`` rows, from one grouped aggregate."""
    keys = _keys(key)
    return _stored_hot(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_deg")), keys, task_rows)


def degree_stats(df: DataFrame, key: str, task_rows: int = TASK_ROWS) -> tuple[float, HotKeys]:
    """(Σ deg², keys hot in a lookup or in a pair join) of ``key`` from one pass over
    ``df``: the per-key degrees are aggregated once and kept for the small reads."""
    deg = df.groupBy(key).agg(F.count(F.lit(1)).alias("_deg")).persist()
    try:
        d = F.col("_deg").cast("double")
        cost = deg.agg(F.coalesce(F.sum(d * d), F.lit(0.0)).alias("c")).first()["c"]
        return float(cost), _stored_hot(deg, [key], min(task_rows, PAIR_ROWS))
    finally:
        deg.unpersist()


def salted_join(left: DataFrame, right: DataFrame, key, split_col: str, task_rows: int = TASK_ROWS,
                how: str = "inner", hot: HotKeys | None = None, partitions: int | None = None,
                split_right: str | None = None, symmetric: bool = False) -> DataFrame:
    """Equi-join on ``key`` (a column or list) where the rows of hot keys of ``left``
    are spread over buckets by a hash of ``split_col``. ``how`` may be inner or left.

    Without ``split_right`` the matching right rows are copied to every bucket. With
    it the join makes pairs: the right rows of a hot key are spread by a hash of
    ``split_right``, and every block of one side meets every block of the other;
    ``symmetric`` makes each unordered pair of rows once, in any order, with its
    ends compared by ``split_col`` and ``split_right``.

    ``partitions``: for joins whose output is much larger than their input
    (pair generation), both sides are hash-partitioned into this many
    partitions explicitly; otherwise AQE would coalesce the small input
    shuffle into a few tasks that then produce all the pairs."""
    keys = _keys(key)
    pairs = split_right is not None
    limit = min(task_rows, PAIR_ROWS) if pairs else task_rows
    if hot is None:
        hot = hot_keys(left, keys, limit)
    salts = hot.blocks(limit)
    ordered = F.col(split_col) <= F.col(split_right) if symmetric else F.lit(True)
    if salts is None:
        if partitions:
            left = left.repartition(partitions, *keys)
            right = right.repartition(partitions, *keys)
        return left.join(right, keys, how).where(ordered)
    last = F.coalesce(F.col("_g"), F.lit(1)) - 1

    def bucket(c):
        return F.when(F.col("_g").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.col(c)), F.col("_g")).cast("int"))

    lft, rgt = left.join(salts, keys, "left"), right.join(salts, keys, "left")
    cell = ["_i"]
    if pairs:
        cell.append("_j")
        lft = lft.withColumn("_i", bucket(split_col))
        lft = lft.withColumn("_j", F.explode(F.sequence(F.col("_i") if symmetric else F.lit(0), last)))
        rgt = rgt.withColumn("_j", bucket(split_right))
        rgt = rgt.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_j") if symmetric else last)))
    else:
        lft = lft.withColumn("_i", bucket(split_col))
        rgt = rgt.withColumn("_i", F.explode(F.sequence(F.lit(0), last)))
    n_parts = partitions or default_partitions(left.sparkSession)
    lft = lft.drop("_g").repartition(n_parts, *keys, *cell)
    rgt = rgt.drop("_g").repartition(n_parts, *keys, *cell)
    both = lft.join(rgt, [*keys, *cell], how)
    if symmetric:  # off the diagonal every pair of rows meets once, in either order
        both = both.where((F.col("_i") < F.col("_j")) | ordered)
    return both.drop(*cell)


def cooccurrence(R: DataFrame, by: str, col: str, val: str, weight: str | None = None,
                 right_keys: DataFrame | None = None, norm: str | None = None,
                 left_keys: DataFrame | None = None, **skew) -> DataFrame:
    """K(a, b) = sum over rows sharing ``by`` of v_a * v_b (and, with
    ``weight``, cw = sum of v_a * v_b * w). Self pairs are kept.

    ``norm``: a per-``col`` column carried on the rows (e.g. the column sum
    of the item); it comes out as ``na``/``nb`` through the aggregate (one
    value per key), so no join of the much larger K with the norms is needed.
    ``right_keys`` (one column named like ``col``): only b in that set is
    produced, which is all a pair-restricted score needs; ``left_keys`` then does the
    same for a. Without ``right_keys`` K is symmetric: only a <= b is built and the
    rest mirrored, halving the pair products."""
    lcols = [F.col(by), F.col(col).alias("a"), F.col(val).alias("va")]
    rcols = [F.col(by), F.col(col).alias("b"), F.col(val).alias("vb")]
    if weight:
        lcols.append(F.col(weight).alias("w"))
    if norm:
        lcols.append(F.col(norm).alias("_na"))
        rcols.append(F.col(norm).alias("_nb"))
    left = R.select(*lcols)
    right = R.select(*rcols)
    if right_keys is not None:
        right = right.join(right_keys.select(F.col(col).alias("b")).distinct(), "b", "left_semi")
        if left_keys is not None:
            left = left.join(left_keys.select(F.col(col).alias("a")).distinct(), "a", "left_semi")
    if "partitions" not in skew:
        cost = square_degree_cost(R, by).first()["cost"]
        skew["partitions"] = pair_partitions(R.sparkSession, cost)
    symmetric = right_keys is None
    pairs = salted_join(left, right, by, "a", split_right="b", symmetric=symmetric, **skew)
    if symmetric:  # the smaller end first
        turn = F.col("a") > F.col("b")
        ends = {"a": F.least("a", "b"), "b": F.greatest("a", "b")}
        if norm:
            ends |= {"_na": F.when(turn, F.col("_nb")).otherwise(F.col("_na")),
                     "_nb": F.when(turn, F.col("_na")).otherwise(F.col("_nb"))}
        pairs = pairs.withColumns(ends)
    prod = F.col("va") * F.col("vb")
    aggs = [F.sum(prod).alias("c")]
    if weight:
        aggs.append(F.sum(prod * F.col("w")).alias("cw"))
    if norm:
        aggs += [F.max("_na").alias("na"), F.max("_nb").alias("nb")]
    k = pairs.groupBy("a", "b").agg(*aggs)
    if not symmetric:
        return k
    # mirror in one pass over the aggregate (a union would rebuild the pairs)
    vals = [c for c in k.columns if c not in ("a", "b", "na", "nb")]
    extra_same = [F.col("na"), F.col("nb")] if norm else []
    extra_swap = [F.col("nb").alias("na"), F.col("na").alias("nb")] if norm else []
    same = F.struct(F.col("a").alias("a"), F.col("b").alias("b"), *[F.col(v) for v in vals], *extra_same)
    swap = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), *[F.col(v) for v in vals], *extra_swap)
    both = F.when(F.col("a") < F.col("b"), F.array(same, swap)).otherwise(F.array(same))
    return k.select(F.explode(both).alias("_e")).select("_e.*")


def square_degree_cost(R: DataFrame, key: str) -> DataFrame:
    """sum over keys of deg(key)^2: the number of pair products a self-join
    on ``key`` makes (one aggregate, combined map-side)."""
    deg = R.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("d"))
    # double: a bigint sum of squares could overflow (an error under ANSI)
    return deg.agg(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0)).alias("cost"))
