"""How the driver's tables stand in for the reference's inputs.

* R_events: events grouped by (user_id, props.k), counts = number of rows.
  Small and half full: used for the models and most operators.
* R_orders: orders join lineitem by (o_custkey, l_partkey), counts = sum of
  quantities. Large and sparse: used for profiling and the heavy bench.
* Train / test: the exact md5 split of R at 0.7 with seed 41.
* Raw ``events`` rows give duplicate cells and a source order (event_id).
* Titles: ``part.p_name`` by partkey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofilter.operators.indexing import index_dense
from cofilter.operators.matrix import materialize, row_sums
from cofilter.operators.ordering import split_exact
from cofilter.sources.tables import event_rows, events_triples, orders_triples

SPLIT_FRAC = 0.7
SPLIT_SEED = 41
TOP_K = 10
N_CANDIDATES = 100
SVD_RANK = 10
HEAD_N = 2000
SAMPLE_FRAC = 0.05
SIMILAR = 6.0
RELEVANT = 2.0
FACT, LEAD = "purchase", "click"   # event types of the as-of and range joins
HOUR_MICROS = 3_600_000_000
DAY_MICROS = 24 * HOUR_MICROS

def r_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_triples(spark, sf_dir)


def r_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_triples(spark, sf_dir)


def split(R: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_exact(R, SPLIT_FRAC, SPLIT_SEED, ["user_id", "item_id"])


def events_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return split(r_events(spark, sf_dir))


def event_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_ord, event_type, user_id, item_id, counts): one piece per event type that
    occurs, each standing in for one triple file, numbered in the order of the
    types. One scan of the events; the types are numbered from the counted rows."""
    by_type = event_rows(spark, sf_dir).groupBy("event_type", "user_id", "item_id").agg(
        F.count(F.lit(1)).cast("double").alias("counts"))
    by_type = materialize(by_type, ("event_type", "user_id", "item_id", "counts"))
    order = index_dense(by_type, "event_type", "src_ord")
    return (by_type.join(order, "event_type")
            .select(F.col("src_ord").cast("int").alias("src_ord"), "event_type", "user_id", "item_id", "counts"))


def target_user(R: DataFrame) -> int:
    """The user with the largest row sum, ties to the smallest id: one
    scalar from a grouped aggregate and a top-1."""
    p = row_sums(R)
    return p.orderBy(F.col("p").desc(), F.col("user_id").asc()).select("user_id").first()[0]


def candidate_items(R: DataFrame, n: int = N_CANDIDATES) -> DataFrame:
    """The first n items of the item universe in key order (top-n, not a full sort)."""
    return R.select("item_id").distinct().orderBy("item_id").limit(n)


# Held-out piece for the multi-file evaluation: trained on the other pieces.
HELD_OUT_PIECE = "view"


def piece_train_test(spark: SparkSession, sf_dir: str, held_out: str = HELD_OUT_PIECE) -> tuple[DataFrame, DataFrame]:
    """(train rows tagged src_ord, held-out rows): the reference's layout of
    several training files plus one evaluation file. Train rows keep their
    duplicates across pieces."""
    pieces = event_pieces(spark, sf_dir)
    train = pieces.where(F.col("event_type") != held_out).select("user_id", "item_id", "counts", "src_ord")
    return train, pieces.where(F.col("event_type") == held_out).select("user_id", "item_id", "counts")
