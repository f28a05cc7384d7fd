"""Interaction triples derived from the driver's parquet tables.

* ``events_triples``: R_events = events grouped by (user_id, props.k), counts = rows.
* ``orders_triples``: R_orders = orders join lineitem grouped by (o_custkey,
  l_partkey), counts = sum(l_quantity).

Both read only the columns they need (the parquet scan shows a pruned
ReadSchema) and pre-aggregate map-side before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_item(col: str = "props"):
    """Item key of an event: the integer ``k`` of its JSON props."""
    return F.get_json_object(F.col(col), "$.k").cast("bigint")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw event rows as interactions, with their source order."""
    return (table(spark, sf_dir, "events")
            .select("event_id", "event_type", "user_id",
                    event_item().alias("item_id"), "value"))


def events_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R_events: (user_id, item_id, counts double)."""
    ev = table(spark, sf_dir, "events").select("user_id", event_item().alias("item_id"))
    return ev.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).cast("double").alias("counts"))


def orders_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R_orders: (user_id = o_custkey, item_id = l_partkey, counts = sum(l_quantity))."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    # pre-aggregate lineitem per (order, part) before the join shuffle
    li = li.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return (j.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
            .agg(F.sum("q").cast("double").alias("counts")))


def item_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, title) from part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"),
                                               F.col("p_name").alias("title"))
