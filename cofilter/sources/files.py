"""File sources and sinks.

Headerless text formats are read with an explicit schema (no inference);
the default mode FAILFAST keeps the fail-loud behaviour on a malformed
line, DROPMALFORMED and PERMISSIVE are options. Positions of lines (row
number in a dense matrix file, title index) come from the file order:
(length and text of the file path, so that part-100000 follows part-99999;
split start; position inside the split), numbered globally with ``with_row_number``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cofilter.operators.ordering import with_row_number

TRIPLE_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("counts", T.IntegerType()),
])
ITEM_DIM_SCHEMA = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("item_index", T.IntegerType()),
])
USER_DIM_SCHEMA = T.StructType([T.StructField("user_id", T.StringType())])


def read_triples(spark: SparkSession, path, schema: T.StructType = TRIPLE_SCHEMA,
                 mode: str = "FAILFAST", sep: str = "\t") -> DataFrame:
    """Headerless TSV triples."""
    return spark.read.csv(path, schema=schema, sep=sep, header=False, mode=mode)


def read_item_dimension(spark: SparkSession, path, mode: str = "FAILFAST") -> DataFrame:
    """Space-separated (item_id, item_index) (S3)."""
    return spark.read.csv(path, schema=ITEM_DIM_SCHEMA, sep=" ", header=False, mode=mode)


def read_user_dimension(spark: SparkSession, path, mode: str = "FAILFAST") -> DataFrame:
    """One user id per line (S3)."""
    return spark.read.csv(path, schema=USER_DIM_SCHEMA, header=False, mode=mode)


def read_sources(spark: SparkSession, paths: list[str], tag: str = "src_ord", **kw) -> DataFrame:
    """Several triple files as one training set, tagged by position."""
    out = None
    for i, p in enumerate(paths):
        d = read_triples(spark, p, **kw).withColumn(tag, F.lit(i).cast("int"))
        out = d if out is None else out.unionByName(d)
    return out


def numbered_lines(spark: SparkSession, path, name: str = "line_no") -> DataFrame:
    """(line_no, value): text lines with their 0-based position in file order."""
    numbered, _ = with_row_number(_file_order(spark, path), ["_n", "_f", "_b", "_m"], name)
    return numbered.select(name, "value")


def _file_order(spark: SparkSession, path):
    return spark.read.text(path).select(
        "value",
        F.length("_metadata.file_path").alias("_n"),
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"))


def head_lines(spark: SparkSession, path, n: int) -> DataFrame:
    """First n lines of a text source in file order (L1 on files): ORDER BY
    (file, split start, position) + LIMIT is a TakeOrdered, no full sort."""
    return _file_order(spark, path).orderBy("_n", "_f", "_b", "_m").limit(n).select("value")


def head_triples(spark: SparkSession, path, n: int, sep: str = "\t") -> DataFrame:
    """First n triples of a headerless TSV in file order, typed like S1."""
    parts = F.split(F.col("value"), sep)
    return head_lines(spark, path, n).select(
        parts.getItem(0).alias("user_id"), parts.getItem(1).alias("item_id"),
        parts.getItem(2).cast("int").alias("counts"))


def read_dense_matrix(spark: SparkSession, path, sep: str = " ") -> DataFrame:
    """Dense whitespace matrix -> (row_idx, col_idx, value), zero cells dropped."""
    lines = numbered_lines(spark, path, "row_idx")
    cells = lines.select("row_idx", F.posexplode(F.split(F.trim("value"), sep + "+")).alias("col_idx", "tok"))
    return (cells.select("row_idx", F.col("col_idx").cast("bigint").alias("col_idx"),
                         F.col("tok").cast("double").alias("value"))
            .filter(F.col("value") != 0))


def read_titles(spark: SparkSession, path) -> DataFrame:
    """(item_idx, title): line position is the item index (S5). A trailing
    newline does not make an empty last title."""
    lines = numbered_lines(spark, path, "item_idx")
    return lines.select("item_idx", F.col("value").alias("title"))


# --- sinks ------------------------------------------------------------------

def write_tsv(df: DataFrame, path: str, sep: str = "\t", mode: str = "overwrite") -> None:
    """TSV without header or index."""
    df.write.mode(mode).csv(path, sep=sep, header=False)


def write_lines_in_order(df: DataFrame, text_col: str, order, path: str) -> None:
    """Text file whose line order follows ``order``: range-partitioned and
    sorted, so part files are in order and each is sorted."""
    order = [order] if isinstance(order, str) else list(order)
    df.orderBy(*order).select(text_col).write.mode("overwrite").text(path)


def write_dense_matrix(R: DataFrame, path: str, row_idx: str = "row_idx",
                       col_idx: str = "col_idx", value: str = "value", n_cols: int | None = None) -> None:
    """One line per row, n_cols space-separated values, zero-filled. A row's
    width is the number of columns, fixed by the format."""
    if n_cols is None:
        n_cols = int(R.agg(F.max(col_idx)).first()[0]) + 1
    cell = F.struct(F.col(col_idx).cast("bigint").alias("c"), F.col(value).cast("double").alias("v"))
    per_row = R.groupBy(row_idx).agg(F.array_sort(F.collect_list(cell)).alias("_cells"))

    def gap(start, stop):
        """Zeros for the columns from start to before stop."""
        return F.array_repeat(F.lit("0.0"), (stop - start).cast("int"))

    # a row's cells in order: each with the zeros between it and the one before
    here = F.transform("_cells", lambda x, i: F.concat(
        gap(F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("_cells", i - 1)["c"] + 1), x["c"]), F.array(x["v"].cast("string"))))
    last = F.element_at("_cells", -1)["c"] + 1
    dense = per_row.select(row_idx, F.concat_ws(" ", F.concat(F.flatten(here), gap(last, F.lit(n_cols)))).alias("line"))
    write_lines_in_order(dense, "line", row_idx, path)


def metrics_line(df: DataFrame, cols: list[str]) -> DataFrame:
    """One-line metric file content 'a,b,c' (S8)."""
    return df.select(F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("value"))


def write_metrics_line(df: DataFrame, cols: list[str], path: str) -> None:
    metrics_line(df, cols).coalesce(1).write.mode("overwrite").text(path)
