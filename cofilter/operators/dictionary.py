"""A dense id for every key, for good (I1): new keys are appended, old ids never move.

The table lies in numbered parts; a key's part is the update that brought it. An update
anti-joins its distinct keys with the table, numbers the new ones in key order behind
the largest id, and writes one part, the same one if it is tried again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofilter.operators.ordering import with_row_number


def read_dictionary(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, id, part), or nothing where no update has been made."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path)


def extend_dictionary(keys: DataFrame, col: str, path: str) -> DataFrame:
    """(key, id) of all keys so far, those of column ``col`` included; nulls have no id."""
    spark = keys.sparkSession
    new = keys.select(F.col(col).alias("key")).where("key IS NOT NULL").distinct()
    known, base, part = read_dictionary(spark, path), 0, 0
    if known is not None:
        new = new.join(known.select("key"), "key", "left_anti")
        last = known.agg(F.max("id").alias("id"), F.max("part").alias("part")).first()
        if last["part"] is not None:
            base, part = last["id"] + 1, last["part"] + 1
    numbered, n = with_row_number(new, ["key"], "pos")
    if n or known is None:
        numbered.select("key", (F.col("pos") + base).alias("id")).write.mode("overwrite").parquet(f"{path}/part={part}")
    return read_dictionary(spark, path).select("key", "id")
