"""Every stage of the pipeline on null, repeated and clashing ids, and on empty tables."""

import pytest

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS)


def test_decontaminate_by_row(spark, whole):
    """A leaking row goes whatever its id; a clean one that shares the id stays."""
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text and len(r.text) > 60)
    leak, clean = f"before {item} after", "river stone light paper"
    rows = [(None, leak), (None, clean), (7, leak), (7, clean), (7, clean), (8, item[:20]), (9, None), (10, ""), (11, leak[:-9] + "x after")]
    docs = spark.createDataFrame([(i, t, None, "web", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in pipeline.decontaminated(spark, docs, SF).collect()), key=str)
    assert got == sorted([(None, clean), (7, clean), (7, clean), (8, item[:20]), (9, None), (10, "")], key=str)


def test_language_by_row(spark, whole):
    """Rows with null and repeated ids go or stay by their texts."""
    text = whole.where("length(text) > 500 AND lang = 'en'").first().text
    rows = [(None, text), (7, text), (7, "12345 !!"), (8, None), (9, "")]
    docs = whole.union(spark.createDataFrame([(i, t, None, "odd", 1) for i, t in rows], SCHEMA))
    got = pipeline.language(spark, docs, SF).where("source = 'odd'").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, text), (7, text)], key=str)


def test_secrets_and_pieces_by_row(spark):
    key = "password = hunter2hunter2"
    rows = [(None, key), (7, key), (7, "plain words"), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", 99) for i, t in rows], SCHEMA)
    got = pipeline.without_secrets(spark, docs, SF)
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=str) == sorted(
        [(None, pipeline.MARK, 8), (7, pipeline.MARK, 8), (7, "plain words", 99), (8, None, 99), (9, "", 99)], key=str)
    coded = pipeline.encoded(spark, docs, SF).collect()
    assert sorted((str(r.doc_id) for r in coded)) == ["7", "7", "8", "9", "None"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, SF), name)
        assert docs.count() == 0
