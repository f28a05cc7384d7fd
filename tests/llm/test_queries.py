"""The registered queries with SQL against DuckDB; the pipeline against its parts."""

import os

import pytest

from cofilter.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries()[name](spark, SF)
    res = con.execute(oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == sorted(res.fetchall(), key=key)


def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from cofilter.llm import decontaminate, near_dup, pieces, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, SF), name)
        steps[name] = docs
    rows = {k: {r.doc_id: r for r in v.collect()} for k, v in steps.items()}
    for name in list(steps)[:-1]:
        assert steps[name].columns == pipeline.COLUMNS
    whole = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows["language_id"]) >= 0.97 * len(whole)
    kept = {r.doc_id for r in near_dup.near_duplicates(steps["language_id"]).where("kept").collect()}
    assert set(rows["near_dup"]) == kept
    leaks = {r.doc_id for r in decontaminate.matches(steps["near_dup"], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(rows["decontaminate"]) == kept - leaks and leaks
    for i, r in rows["secrets"].items():
        spans = secrets.find_spans(rows["decontaminate"][i].text, [secrets.re.compile(a) for a in secrets.ALLOW])
        assert r.text == secrets.redact(rows["decontaminate"][i].text, spans, pipeline.MARK)
        assert r.n_chars == (len(r.text) if spans else rows["decontaminate"][i].n_chars)
    decoded = pieces.decode(steps["pieces"], pieces.Pieces.load()).collect()
    assert {r.doc_id: r.decoded for r in decoded} == {i: r.text for i, r in rows["secrets"].items()}
    assert os.path.basename(pipeline.__file__) == "corpus_pipeline.py"
