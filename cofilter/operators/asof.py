"""As-of and range joins: what held for a key just before a row.

Both sides become one table in global order (I4) of (key, time, side). Its rows are cut
by position into cells of ``CELL_ROWS``, so a key with a third of all rows fills many cells,
whatever its times are. Within a cell a window carries the last fact of each key forward. A
second pass goes over the borders: each cell hands on what it ended with, one row a
cell, and a running window over these rows gives the next cell of the same key its start.

Counts within a stretch of time are the difference of two running numbers, so no pair of
rows is made for them. ``range_pairs`` makes the pairs where they are the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from cofilter.operators.ordering import with_row_number
from cofilter.operators.products import PAIR_ROWS, hot_keys, salted_join

CELL_ROWS = 200_000


def _fingerprint(df: DataFrame):
    """Spreads and orders rows that tie in everything else."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, MapType)])


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: dict[str, str], order: str | None = None,
          strict: bool = True, count: str | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every row of ``left`` with the last row of ``right`` of its ``key`` before its ``at``
    (``strict``; else before or at it). ``values``: {output column: column of right};
    ``count`` names a column for the number of such rows.

    Of several right rows at one time the largest ``order`` wins. Left rows without a
    fact before them, or with a null key or time, stay with nulls and count 0; right rows
    with a null key or time never match. A null value of the last fact is given as null."""
    facts = right.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    fact = F.struct(F.lit(1).alias("_there"), *[F.col(c).alias(out) for out, c in values.items()])
    tie = F.col(order) if order else F.lit(0)
    r = facts.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(int(strict)).alias("_s"), tie.alias("_o"),
                     _fingerprint(facts).alias("_h"), F.lit(None).cast(left.schema).alias("_l"), fact.alias("_f"))
    types = {f.name: f.dataType for f in r.schema}
    rows = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1 - int(strict)).alias("_s"),
                       F.lit(None).cast(types["_o"]).alias("_o"), _fingerprint(left).alias("_h"),
                       F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"), F.lit(None).cast(types["_f"]).alias("_f"))
    numbered, _ = with_row_number(rows.unionByName(r), ["_k", "_t", "_s", "_o", "_h"], "_pos")
    numbered = numbered.withColumn("_c", F.floor(F.col("_pos") / cell_rows))

    here = Window.partitionBy("_c", "_k").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = numbered.withColumn("_last", F.last("_f", ignorenulls=True).over(here)).withColumn("_n", F.count("_f").over(here))

    # what each cell ends with: its last key, and that key's facts in the cell
    by_key = numbered.groupBy("_c", "_k").agg(
        F.max("_pos").alias("_end"), F.count("_f").alias("n"),
        F.max_by("_f", F.when(F.col("_f").isNotNull(), F.col("_pos"))).alias("last"))
    ends = by_key.groupBy("_c").agg(F.max_by(F.struct("_k", "n", "last"), "_end").alias("e")).select("_c", "e.*")
    so_far = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    borders = ends.select((F.col("_c") + 1).alias("_c"), "_k", F.sum("n").over(so_far).alias("_n0"),
                          F.last("last", ignorenulls=True).over(so_far).alias("_last0"))

    # left rows are those without a fact
    out = run.where(F.col("_f").isNull()).join(borders, ["_c", "_k"], "left")
    last = F.coalesce("_last", "_last0")
    number = [(F.col("_n") + F.coalesce("_n0", F.lit(0))).alias(count)] if count else []
    return out.select("_l.*", *[last[name].alias(name) for name in values], *number)


def count_within(left: DataFrame, right: DataFrame, key: str, at: str, width, id: str, out: str = "n",
                 cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, out): for every row of ``left``, told apart by ``id``, the rows of ``right`` of its
    key with at - width <= their ``at`` < at. ``at`` is a number. Null keys and times: 0."""
    stops = F.array(F.struct(F.lit(1).alias("_sign"), F.col(at).alias("_stop")),
                    F.struct(F.lit(-1).alias("_sign"), (F.col(at) - F.lit(width)).alias("_stop")))
    probes = left.select(id, key, F.explode(stops).alias("_p")).select(id, key, "_p._sign", F.col("_p._stop").alias(at))
    seen = as_of(probes, right.select(key, at), key, at, {}, count="_n", cell_rows=cell_rows)
    return seen.groupBy(id).agg(F.sum(F.col("_sign") * F.col("_n")).alias(out))


def range_pairs(left: DataFrame, right: DataFrame, key: str, at: str, width, left_id: str, right_id: str,
                task_rows: int = PAIR_ROWS) -> DataFrame:
    """(left_id, right_id): all pairs of one key with left.at - width <= right.at < left.at;
    ``at`` is a number. Null keys and times are in no pair.

    An equi-join on (key, stretch of ``width``): a left row meets its own stretch and the
    one before. A stretch with many rows on either side is dealt in blocks of both."""
    stretch = F.floor(F.col(at) / F.lit(width))
    lft = left.select(F.col(key).alias("_k"), F.col(at).alias("_lt"), F.col(left_id).alias("_left"),
                      F.explode(F.array(stretch - 1, stretch)).alias("_b"))
    rgt = right.select(F.col(key).alias("_k"), F.col(at).alias("_rt"), F.col(right_id).alias("_right"), stretch.alias("_b"))
    both = lft.select("_k", "_b").unionByName(rgt.select("_k", "_b"))
    pairs = salted_join(lft, rgt, ["_k", "_b"], "_left", split_right="_right", task_rows=task_rows,
                        hot=hot_keys(both, ["_k", "_b"], task_rows))
    return (pairs.where((F.col("_rt") < F.col("_lt")) & (F.col("_rt") >= F.col("_lt") - F.lit(width)))
            .select(F.col("_left").alias(left_id), F.col("_right").alias(right_id)))
