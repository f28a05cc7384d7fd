"""The corpus pipeline: language ID, near duplicates, decontamination, secrets, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes to the shared scratch folder and reads back as the next stage's docs. All
but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofilter.llm import decontaminate, language_id, near_dup, pieces, secrets
from cofilter.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MARK = "[secret]"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models, trained on all labelled rows, don't
    reject: texts without a letter go, and those unlike every language."""
    model = language_id.train(docs)
    return language_id.identify(docs, model, keep=COLUMNS).where("NOT rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id, null
    ids last. Rows are told apart by a key of their own: ids can repeat or be null."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "rows")
    groups = near_dup.near_duplicates(rows, "row").select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "row")
    kept = (groups.join(rows.select("row", order.alias("o")), "row")
            .groupBy("component_id").agg(F.min("o").alias("o")).select("o.row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no benchmark item, within its error budget. Each row
    goes or stays by its own text: null and repeated ids too; null and empty texts stay."""
    return decontaminate.without_matches(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted anew where one was."""
    clean = secrets.scan(docs, keep=COLUMNS, mark=MARK)
    changed = F.size("spans") > 0
    return clean.select("doc_id", F.col("redacted").alias("text"), "lang", "source",
                        F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, piece ids and their number."""
    coded = pieces.encode(docs, pieces.Pieces.load(), keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_pieces"))


STAGES = [("language_id", language), ("near_dup", near_duplicates), ("decontaminate", decontaminated),
          ("secrets", without_secrets), ("pieces", encoded)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
