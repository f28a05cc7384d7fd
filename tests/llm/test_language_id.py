"""Kneser-Ney models against a direct evaluation of the formula; edge cases."""

import math
from collections import Counter

import numpy as np
import pytest

from cofilter.llm import language_id as L

TEXTS = {"aa": ["abab ba", "Abba, bab", "ba ab"], "bb": ["cdc dcd!", "dd cc", "cab"]}


def reference_logp(texts, order, alphabet):
    """log P of each gram by the textbook recursion over plain dictionaries."""
    grams = Counter()
    for t in texts:
        s = " " * (order - 1) + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        grams.update(s[i: i + order] for i in range(len(s) - order + 1))
    tables = {order: grams}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])

    def discount(c):
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return one / (one + 2 * two) if one and two else 0.5

    def prob(gram):
        k = len(gram)
        if k == 0:
            return 1 / (alphabet + 1)
        c, d = tables[k], discount(tables[k])
        own = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        if not own:
            return prob(gram[1:])
        total = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * prob(gram[1:])

    return prob


def test_matches_formula(spark):
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in TEXTS.items() for t in ts)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), order=3)
    assert model.langs == ["aa", "bb"]
    alphabet = len(set("abcd "))
    for text in ["ab", "abc dd", "xyz", "a"]:
        ce, size, letters = model.cross_entropy([text])
        s = "  " + text + " "
        for j, k in enumerate(model.langs):
            prob = reference_logp(TEXTS[k], 3, alphabet)
            want = -np.mean([math.log(prob(s[i: i + 3])) for i in range(len(s) - 2)])
            assert ce[0, j] == pytest.approx(want, rel=1e-9)
        assert size[0] == len(text) + 1 and letters[0] == sum(c.isalpha() for c in text)


def test_symbols():
    sym, starts, letters = L.symbols(["Ab  c!", "", "12", "z"], 3)
    assert sym.tolist() == [32, 32, 97, 98, 32, 99, 32, 32, 32, 32, 32, 32, 32, 122, 32]
    assert starts.tolist() == [0, 7, 9, 11] and letters.tolist() == [3, 0, 0, 1]


def test_edges(spark):
    rows = [(1, "abab ba", "aa"), (2, "cdc dcd", "bb"), (3, None, "aa"), (4, "", None), (5, "123 -- \n", "bb"),
            (None, "ba" * 40_000, None), (7, "cdc dcd", "bb"), (8, "cdc dcd", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", L.F.lit("x"))
    out = {r.doc_id: r for r in L.identify(docs, L.train(docs)).collect()}
    assert out[1].lang_pred == "aa" and out[7].lang_pred == out[8].lang_pred == "bb" and out[None].lang_pred == "aa"
    for i in (3, 4, 5):
        assert (out[i].lang_pred, out[i].lang_score, out[i].rejected) == ("und", 0.0, True)
    assert out[7][2:] != out[1][2:] and 0.5 <= out[1].lang_score <= 1
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.identify(empty, L.train(empty)).count() == 0
    assert L.identify(docs, L.train(empty), keep=["doc_id"]).where("rejected AND lang_pred = 'und'").count() == 8


def test_held_out_accuracy(spark):
    from cofilter.llm.queries import op2_language
    got = op2_language(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").selectExpr("avg(int(lang = lang_pred)) a", "avg(int(rejected)) r").first()
    assert r.a > 0.98 and r.r < 0.02


def test_tables_give_what_arrays_give(spark, monkeypatch):
    """The model as Spark tables, above the broadcast limit, scores and decides the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "12 !!", None), (-4, "日本語 𐐨𐐩", None), (-4, "qqq zzz", None),
                                 (None, "the of and", None)], "doc_id long, text string, lang string")
    docs = docs.union(odd)
    small, wide = L.train(docs), L.train(docs, broadcast_grams=0)
    assert isinstance(small, L.Model) and isinstance(wide, L.WideModel) and small.langs == wide.langs
    assert wide.limit == pytest.approx(small.limit) and wide.heat == small.heat and np.allclose(wide.spread, small.spread)
    a, b = (sorted(L.identify(docs, m, keep=["doc_id", "text"]).collect(), key=str) for m in (small, wide))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert (x.doc_id, x.text, x.lang_pred, x.rejected) == (y.doc_id, y.text, y.lang_pred, y.rejected)
        assert x.lang_score == pytest.approx(y.lang_score, abs=1e-6) and x.cross_entropy == pytest.approx(y.cross_entropy, abs=1e-9)


def test_no_gram_is_dropped_and_no_window(spark, capsys):
    """Any number of grams: all counted ones are in the model."""
    rows = [(i, "".join(chr(0x4E00 + (i * 37 + j * j) % 4000) for j in range(60)), "zh" if i % 3 else "ja") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counted = L.count_grams(docs, "text", "lang", L.ORDER)
    model = L.train(docs)
    assert len(model.grams[-1].hashes) - 1 == counted.select("gram").distinct().count()
    counted.explain()
    assert "Window" not in capsys.readouterr().out


@pytest.mark.parametrize("grams", [None, 0])
def test_calibration_reads_every_row(spark, monkeypatch, grams):
    monkeypatch.setattr(L, "CALIBRATION_ROWS", 5, raising=False)
    rows = [(i % 7, " ".join([TEXTS["aa" if i % 3 else "bb"][i % 2]] * (1 + i % 5)) + "xyzab"[: i % 6], "aa" if i % 3 else "bb") for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, "12", "aa"), (1, None, "bb"), (2, "abab", None)], "doc_id long, text string, lang string")
    model, plain = L.train(docs, broadcast_grams=grams), L.train(docs)
    ce, size, _ = plain.cross_entropy([t for _, t, _ in rows])
    size = size.astype(float)
    true = np.array([plain.langs.index(k) for *_, k in rows])
    own = ce[np.arange(len(ce)), true]
    assert model.mean == pytest.approx([own[true == j].mean() for j in range(2)])
    off = ce.min(axis=1) - model.mean[ce.argmin(axis=1)]
    x = np.stack((np.ones_like(size), 1 / size), 1)
    spread = np.maximum(np.linalg.lstsq(x * size[:, None] ** 0.5, off ** 2 * size ** 0.5, rcond=None)[0], [1e-4, 0.25])
    assert model.spread == pytest.approx(spread)
    assert model.limit == pytest.approx(L.SLACK * max(1.0, np.quantile(off / np.sqrt(x @ spread), 1 - L.REJECT_RATE)))
    loss = [L._log_share(ce, size, g)[np.arange(len(ce)), true].mean() for g in np.geomspace(0.25, 64, 25)]
    assert model.heat == pytest.approx(np.geomspace(0.25, 64, 25)[int(np.argmax(loss))])
