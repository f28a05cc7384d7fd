"""The last-write matrix as a stream (W2, A6): R, P and Q kept up to date.

Files of interaction rows land in a folder. Each run takes what is new (available-now
trigger), keeps the last value of every cell in the state of a streaming aggregation,
and upserts the cells that changed: each batch writes its own folder, again and again
the same if it is tried again, so a lost driver or executor costs nothing but time. A
repeated row changes nothing, and neither does a late one, however late: a cell's last
write is the one with the largest order, not the one that came last. The state holds one
entry a cell, as the matrix itself does.

Row and column sums are kept as changes: a batch's new values less the old ones, summed
by user and by item before they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U, I = "user_id", "item_id"


def _cells(spark: SparkSession, store: str) -> DataFrame | None:
    """All changes of cells so far: (user, item, value, order, batch)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/cells")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{store}/cells")


def _last(cells: DataFrame) -> DataFrame:
    return cells.groupBy(U, I).agg(F.max_by("value", "batch").alias("value"))


def _upsert(store: str):
    def write(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # written, and joined with the values before
        batch.write.mode("overwrite").parquet(f"{store}/cells/batch={no}")
        known = _cells(spark, store).where(F.col("batch") < no)
        touched = _last(known.join(batch.select(U, I), [U, I], "left_semi")).withColumnRenamed("value", "old")
        change = batch.join(touched, [U, I], "left").select(U, I, (F.col("value") - F.coalesce("old", F.lit(0.0))).alias("d"))
        sides = (change.groupBy(F.col(U).alias("key")).agg(F.sum("d").alias("d")).withColumn("side", F.lit("user"))
                 .unionByName(change.groupBy(F.col(I).alias("key")).agg(F.sum("d").alias("d")).withColumn("side", F.lit("item"))))
        sides.write.mode("overwrite").parquet(f"{store}/sums/batch={no}")
        batch.unpersist()

    return write


def update_matrix(spark: SparkSession, source: str, schema: StructType, store: str, value: str = "value", order: str = "event_id") -> None:
    """Take the files of ``source`` that no run has taken yet into the matrix at ``store``."""
    rows = spark.readStream.schema(schema).parquet(source)
    cells = rows.groupBy(U, I).agg(F.max_by(F.col(value).cast("double"), order).alias("value"), F.max(order).alias("order"))
    query = (cells.writeStream.outputMode("update").foreachBatch(_upsert(store))
             .option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start())
    query.awaitTermination()


def read_matrix(spark: SparkSession, store: str) -> DataFrame:
    """R as it is now: (user_id, item_id, value)."""
    return _last(_cells(spark, store))


def read_sums(spark: SparkSession, store: str) -> DataFrame:
    """P and Q as they are now: (side, key, total)."""
    return spark.read.parquet(f"{store}/sums").groupBy("side", "key").agg(F.sum("d").alias("total"))
