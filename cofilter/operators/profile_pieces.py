"""Profiles that add up (A1, A3): one row a piece of the data, merged without a rescan.

A piece (a day, a file, a type) is profiled once: exact count, sum, smallest and largest
value, a HyperLogLog sketch of each id column and a KLL sketch of the values. Profiles of
any pieces merge to the profile of all their rows, so a new day costs one scan of that
day, and every cell of a cube over the pieces comes from the stored rows alone.

Counts, sums and limits are exact. Distinct numbers have a relative standard error of
1.04 / sqrt(2^LOG_BUCKETS) (1.6 %); quantiles have a rank error of about 0.7 % at
``KLL_K`` = 400. ``DISTINCT_BOUND`` and ``RANK_BOUND`` are over four times as wide as the
standard errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_BUCKETS = 12
KLL_K = 400
DISTINCT_BOUND = 0.065
RANK_BOUND = 0.02


def profile_pieces(df: DataFrame, by: list[str], value: str, ids: list[str]) -> DataFrame:
    """One row for each combination of ``by``: n (rows), n_values, total, low, high, a sketch
    ``values`` and a sketch ``distinct_<id>`` for each id. Null values and ids are in no sketch;
    not-a-number counts as no value."""
    number = F.col(value).cast("double")
    v = F.when(~F.isnan(number), number)
    sketches = [F.hll_sketch_agg(F.col(c), F.lit(LOG_BUCKETS)).alias(f"distinct_{c}") for c in ids]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("n_values"), F.sum(v).alias("total"),
                               F.min(v).alias("low"), F.max(v).alias("high"),
                               F.kll_sketch_agg_double(v, F.lit(KLL_K)).alias("values"), *sketches)


def store_profiles(pieces: DataFrame, store: str, batch: str) -> None:
    """Add pieces to the store as ``batch``; the same batch again replaces itself."""
    pieces.write.mode("overwrite").parquet(f"{store}/batch={batch}")


def read_profiles(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store)


def merge_profiles(pieces: DataFrame, by: list[str], ids: list[str], quantiles=(0.25, 0.5, 0.75), cube: bool = False) -> DataFrame:
    """Profiles of the unions of pieces with equal ``by``, or of every cell of the cube over
    ``by`` (``level`` has a bit for each column that is summed over, the first column's
    highest): n, n_values, total, low, high, ``n_<id>`` and ``q<percent>``."""
    groups = pieces.cube(*by) if cube else pieces.groupBy(*by)
    level = [F.grouping_id().alias("level")] if cube else []
    merged = groups.agg(*level, F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"),
                        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("values").alias("_values"),
                        *[F.hll_sketch_estimate(F.hll_union_agg(f"distinct_{c}")).alias(f"n_{c}") for c in ids])
    at = [F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double("_values", F.lit(float(q)))).alias(f"q{round(100 * q)}") for q in quantiles]
    return merged.select(*by, *(["level"] if cube else []), "n", "n_values", "total", "low", "high", *[f"n_{c}" for c in ids], *at)
