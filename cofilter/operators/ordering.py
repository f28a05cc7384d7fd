"""Global order without a one-task sort: row numbers, first-n, exact splits.

``with_row_number`` is the building block (I4). A window ``row_number()``
without ``partitionBy`` moves every row into one task; instead the rows are
range-partitioned on the order key and sorted inside each partition (one
shuffle, many tasks), the result is checkpointed to the shared folder so
that partition membership and order cannot move between jobs, and the
per-partition row counts (one number per partition, a bounded list) become
offsets added to the position inside the partition."""

from __future__ import annotations

from fractions import Fraction
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cofilter.functions.scalar import md5_order_key
from cofilter.operators.selection import first_by_key
from cofilter.session import checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | position


def _order_exprs(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_row_number(df: DataFrame, order, name: str = "row_no",
                    num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """Add a 0-based global row number in ``order`` (a total order is the
    caller's duty: add tie-breaking columns). Returns (frame, row count).

    Without ``num_partitions`` the range exchange starts from the session's
    shuffle partitions and AQE may merge adjacent small ranges (which keeps
    the order), so small inputs do not become hundreds of tiny files."""
    spark = df.sparkSession
    exprs = _order_exprs(order)
    checkpoint_dir(spark)
    ranged = (df.repartitionByRange(num_partitions, *exprs) if num_partitions
              else df.repartitionByRange(*exprs)).sortWithinPartitions(*exprs)
    fixed = ranged.checkpoint(eager=True)
    mid = F.monotonically_increasing_id()
    tagged = fixed.withColumn("_rn_mid", mid)
    pid = F.shiftright(F.col("_rn_mid"), _LOCAL_BITS)
    # one row per non-empty partition: a list bounded by the partition count
    counts = {r["pid"]: r["n"] for r in
              tagged.groupBy(pid.alias("pid")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = int(sum(counts.values()))
    offsets, run = [], 0
    for p in sorted(counts):
        offsets.append((p, run))
        run += counts[p]
    # one row per partition: the same bound
    starts = F.broadcast(spark.createDataFrame(offsets, "_rn_pid bigint, _rn_start bigint"))
    local = F.col("_rn_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    out = (tagged.withColumn("_rn_pid", pid).join(starts, "_rn_pid")
           .withColumn(name, F.col("_rn_start") + local)
           .drop("_rn_mid", "_rn_pid", "_rn_start"))
    return out, total


def head_n(df: DataFrame, n: int, order) -> DataFrame:
    """First ``n`` rows in ``order`` (L1). Catalyst plans ORDER BY + LIMIT as
    TakeOrderedAndProject: each task keeps its own top n, no full sort."""
    return df.orderBy(*_order_exprs(order)).limit(n)


def head_fraction(df: DataFrame, frac, order, name: str = "row_no") -> DataFrame:
    """Rows whose global position is below floor(frac * n) (size study)."""
    numbered, n = with_row_number(df, order, name)
    cut = exact_floor(frac, n)
    return numbered.filter(F.col(name) < cut)


def exact_floor(frac, n: int) -> int:
    """floor(frac * n) in decimal arithmetic, as SQL engines compute it."""
    return int(math.floor(Fraction(str(frac)) * n))


def split_exact(df: DataFrame, frac, seed, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Exact-size seeded split (L3): rows ordered by md5(keys|seed); the first
    floor(frac * n) form the first part, the rest the second. Deterministic
    across engines and partition counts; row choice is not sklearn's. The row at the
    cut is found by counting (``selection``), so nothing is sorted globally."""
    checkpoint_dir(df.sparkSession)
    # the rows in place once: which of several equal ones comes first is fixed by that; their
    # keys are made when read, as they are longer than most rows
    keyed = df.checkpoint(eager=True).withColumn("_split_key", md5_order_key(keys, seed)).withColumn("_split_at", F.monotonically_increasing_id())
    cut = exact_floor(frac, keyed.count())
    before = first_by_key(keyed, "_split_key", [*keys, "_split_at"], cut)
    inside = F.lit(True) if before is None else before
    return tuple(keyed.where(c).drop("_split_key", "_split_at") for c in (inside, ~inside))


def random_split(df: DataFrame, frac: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Approximate variant: Spark's Bernoulli ``randomSplit`` (no global order)."""
    a, b = df.randomSplit([frac, 1.0 - frac], seed)
    return a, b
