"""Order statistics by counting (L3, A1): no global sort, no range exchange.

The value at a rank is found by counting rows in buckets of an interval that is known
to hold it, and going on with its bucket: a few passes over the rows, each with a
bounded number of counts for the driver. A last pass reads the at most ``FEW`` rows
that are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
FEW = 4096
HEX = 3  # digits of a key that one pass counts: 4,096 counts


def kth_values(df: DataFrame, col: str, ranks: list[int]) -> dict[int, float]:
    """The values of ``col`` at 0-based ranks of its ascending order; nulls take no part,
    NaN comes last. A rank that doesn't exist is left out."""
    v = F.col(col).cast("double")
    inf = float("inf")
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(inf))
    rows = df.select(v.alias("v")).where(fine)
    size = df.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (
        ("low", v == -inf), ("fine", fine), ("high", v == inf), ("nan", F.isnan(v)))],
        F.min(F.when(fine, v)).alias("a"), F.max(F.when(fine, v)).alias("b")).first()
    found: dict[int, float] = {}
    for n, offset, value in ((size["low"], 0, -inf), (size["high"], size["low"] + size["fine"], inf),
                             (size["nan"], size["low"] + size["fine"] + size["high"], float("nan"))):
        found |= {r: value for r in ranks if offset <= r < offset + n}
    wanted = sorted({r for r in ranks if size["low"] <= r < size["low"] + size["fine"]})
    # (lowest and highest value of an interval, rows below it, rows in it, ranks in it)
    open_ = [(size["a"], size["b"], size["low"], size["fine"], wanted)] if wanted else []
    while open_:
        found |= {r: a for a, b, _, _, rs in open_ if a == b for r in rs}
        open_ = [x for x in open_ if x[0] != x[1]]
        wide = [x for x in open_ if x[3] > FEW]
        if not wide:
            break
        places = [F.when((F.col("v") >= a) & (F.col("v") <= b), F.struct(F.lit(j).alias("j"), _bucket(a, b).alias("k")))
                  for j, (a, b, *_) in enumerate(wide)]
        counts = (rows.withColumn("p", F.coalesce(*places)).where("p IS NOT NULL").groupBy("p.j", "p.k")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("j", "k").collect())
        after = [x for x in open_ if x[3] <= FEW]
        for j, (a, b, below, n, rs) in enumerate(wide):
            for c in (c for c in counts if c["j"] == j):
                inside = [r for r in rs if below <= r < below + c["n"]]
                if inside and (c["a"], c["b"]) == (a, b) and c["n"] == n:  # neighbouring numbers: nothing between them
                    found |= {r: x for r, x in _few(rows, a, b, below).items() if r in inside}
                elif inside:
                    after.append((c["a"], c["b"], below, c["n"], inside))
                below += c["n"]
        open_ = after
    for a, b, below, _, rs in open_:
        found |= {r: x for r, x in _few(rows, a, b, below, max(rs)).items() if r in rs}
    return found


def _bucket(a: float, b: float) -> Column:
    span = b / 2 - a / 2
    share = (F.col("v") / 2 - a / 2) / span if span > 0 else F.lit(0.0)
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def _few(rows: DataFrame, a: float, b: float, below: int, last: int | None = None) -> dict[int, float]:
    """Rank -> value within an interval of few distinct values."""
    out: dict[int, float] = {}
    for r in rows.where((F.col("v") >= a) & (F.col("v") <= b)).groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect():
        stop = below + r["n"] if last is None else min(below + r["n"], last + 1)
        out |= dict.fromkeys(range(below, stop), r["v"])
        below += r["n"]
    return out


def first_by_key(keyed: DataFrame, key: str, more: list[str], count: int) -> Column | None:
    """The condition that holds for the first ``count`` rows by a hexadecimal ``key`` and
    the columns ``more``, which together tell rows apart; None where that is every row."""
    prefix, below = "", 0
    while True:
        own = keyed.where(F.col(key).startswith(prefix)) if prefix else keyed
        part = own.groupBy(F.substring(key, len(prefix) + 1, HEX).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
        for c in part:
            if below + c["n"] > count:
                prefix, size = prefix + c["p"], c["n"]
                break
            below += c["n"]
        else:
            return None
        if size <= FEW or not c["p"]:
            break
    columns = [key, *more]
    rows = sorted((tuple(r) for r in keyed.where(F.col(key).startswith(prefix)).select(*columns).collect()),
                  key=lambda r: [(x is not None, x) for x in r])
    pivot = rows[count - below]
    kinds = dict(keyed.dtypes)
    return F.struct(*columns) < F.struct(*[F.lit(x).cast(kinds[c]).alias(c) for c, x in zip(columns, pivot, strict=True)])
