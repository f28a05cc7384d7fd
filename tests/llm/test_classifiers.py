"""Quality and toxicity: the chain against brute force, the kernel against its
definition, edge cases, held-out accuracy."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from cofilter.llm import quality as Q
from cofilter.llm import toxicity as X


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    t = rng.normal(size=(2, 2))
    lines = np.array([3, 1, 5, 2])
    e = rng.normal(size=lines.sum())
    f, b = Q._messages(e, lines, t)
    at = 0
    for n in lines:
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[at + i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            total, good = total + w, good + w * np.array(y)
        assert np.allclose(Q._logistic(f[at: at + n] + b[at: at + n]), good / total)
        at += n


def test_line_features():
    own, seen, lines = Q.line_features([b"Ab 1!\n\nAb 1!", b"", b"a|a a"])
    assert lines.tolist() == [3, 1, 1] and seen.tolist() == [4, 0, 4, 0, 4]
    assert own[:, 9].tolist() == [0, 0, 1, 0, 0]  # repeated line
    assert own[4, 6] == 1 and own[4, 8] == 1.0 and own[0, 10] == 1


def test_kernel_matches_definition():
    words, marks = ["loxser", "toast", "a", "scum!"], ["loser", "scum", "tost"]
    k = X.Kernel.build(marks)

    def subsequences(w):
        s = "^" + "".join(c for c in w if c.isalpha())
        out = {}
        for i, j in X.GAPS:
            for p in range(len(s) - j):
                key = s[p] + s[p + i] + s[p + j]
                out.setdefault(key, []).append(X.DECAY ** (j + 1))
        return out

    def norm(f):
        return max(1e-12, sum(v * v for vs in f.values() for v in vs)) ** 0.5

    for w, row in zip(words, k.against(words), strict=True):
        a = subsequences(w)
        for m, got in zip(marks, row, strict=True):
            b = subsequences(m)
            want = sum(sum(v) * sum(b[u]) for u, v in a.items() if u in b) / norm(a) / norm(b)
            assert got == pytest.approx(want ** X.POWER, abs=1e-5)


def test_words_and_sentences():
    w = X.Words.of(pa.array(["A b. C d\ne", None, "", "i d i o t"]))
    assert [w.distinct[c] for c in w.code if w.distinct[c] != "."] == ["a", "b.", "c", "d", "e", "i", "d", "i", "o", "t", "idiot"]
    assert w.first.tolist() == [0, 3, 4, 5, 6]


def docs_of(spark):
    rnd = np.random.default_rng(3)
    good = [" ".join(rnd.choice(["river", "stone", "light", "garden", "window", "paper"], 12)) + "." for _ in range(60)]
    rows, labels = [], []
    for i, g in enumerate(good):
        toxic, bad = i % 3 == 0, i % 2 == 0
        text = g + (f"\nyou total {rnd.choice(['moron', 'scumbag'])} here." if toxic else "")
        text = "\n".join(f"{x} ### %%% | {x}" for x in text.split("\n")) if bad else text
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(100, None), (101, ""), (102, " \n"), (None, "river stone."), (104, "you morxon\n" * 20_000), (105, "river stone."),
             (106, "you m o r o n there"), (107, "you moron there"), (108, "river stone.\n" * 20_000),
             (109, "river stone.\n" * 20_000 + "you moron there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "t", "y", "score", "quality"):
        docs = docs.withColumn(c, docs.text)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_edges(spark):
    docs, labels = docs_of(spark)
    out = {r.doc_id: r.score for r in Q.score(docs, Q.train(docs, labels)).collect()}
    assert len(out) == 70 and all(0 <= s <= 1 for s in out.values())
    assert out[100] == out[101] == out[102] == pytest.approx(0.5)
    assert out[None] == out[105] > 0.7 and out[0] < 0.5 < out[1]
    empty = labels.where("doc_id < 0")
    assert {r.score for r in Q.score(docs, Q.train(docs, empty)).collect()} == {0.5}
    assert Q.score(docs.where("doc_id < 0"), Q.train(docs, labels)).count() == 0


def test_toxicity_edges(spark):
    docs, labels = docs_of(spark)
    m = X.train(docs, labels)
    out = {r.doc_id: r for r in X.score(docs, m).collect()}
    assert len(out) == 70 and all(0 <= r.score <= 1 for r in out.values())
    assert out[0].score > 0.5 > out[1].score and out[0].worst_sentence >= 1
    assert out[104].score > 0.5 and out[106].score > 0.5  # an inserted letter, a spaced-out word
    # one sentence is enough, and harmless ones only lower a score
    assert out[107].score > 0.5 > out[105].score >= out[108].score and out[109].score <= out[107].score
    assert out[100].score == out[101].score == out[102].score < 0.5 and out[None].score == out[105].score
    empty = labels.where("doc_id < 0")
    assert {r.score for r in X.score(docs, X.train(docs, empty)).collect()} == {0.5}
    assert X.score(docs.where("doc_id < 0"), m).count() == 0


def test_landmarks_cover_every_document():
    """A rare language gets landmarks too; near copies count for their documents but are none."""
    words = ["moron", "morons", "scum", "achlich", "achlichen", "réeux", "idiot"]
    holders = [[0, 1, 2], [2, 3], [0, 1, 2, 3], [4], [4, 5], [6], [0]]
    assert X.choose_landmarks(words, holders, 1) == ["moron", "achlich", "réeux"]
    assert X.choose_landmarks(words, holders, 2) == ["moron", "scum", "achlich", "réeux", "idiot"][:4]
    assert X.choose_landmarks(words, holders, 2, at_once=2) == X.choose_landmarks(words, holders, 2)
    assert X.choose_landmarks([], []) == []


def test_kernel_of_many_letters():
    """Over the table's size subsequences are searched; the kernel is the same."""
    marks = ["".join(chr(0x4E00 + 5 * i + j) for j in range(5)) for i in range(60)] + ["loser", "𐐨𐐩𐐪𐐫"]
    k = X.Kernel.build(marks)
    assert k.index is None and k.against(marks).diagonal() == pytest.approx(X.Kernel.build(marks[-2:]).against(marks[-2:]).diagonal()[0], rel=.2)
    few = X.Kernel.build(["loser"])
    assert few.index is not None
    want = few.against(["loxser", "x"])
    few.index = None
    assert np.allclose(few.against(["loxser", "x"]), want)
    assert X.Kernel.build(["a" * 3000]).against(["a" * 3000, "a" * 2000]).shape == (2, 1)


def test_machine_against_plain_training(spark):
    """The stored, summed training against the same machine with the whole matrix in memory."""
    rng = np.random.default_rng(8)
    marks = ["moron", "scum", "idiot"]
    kernel = X.Kernel.build(marks)
    docs = [(d, int(d % 3 == 0), 1.0 + d % 2, rng.random((int(rng.integers(1, 9)), 3)).astype(np.float32) * (1 + (d % 3 == 0)))
            for d in range(40)]
    rows = [(d, y, w, len(part), part.ravel().tolist()) for d, y, w, f in docs for part in (f[:4], f[4:]) if len(part)]
    df = spark.createDataFrame(rows, "doc long, y int, weight double, n long, f array<float>")
    got = X.fit(kernel, df, 0.3)

    gram = kernel.against(marks).astype(float)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T  # Nystroem: the root's square inverts the kernel
    assert np.allclose(root @ root @ (gram + gram.T) / 2, np.eye(3), atol=1e-6)
    x = np.concatenate([f for *_, f in docs]).astype(float) @ root
    x = np.column_stack((x, np.ones(len(x))))
    own = np.repeat(np.arange(len(docs)), [len(f) for *_, f in docs])
    toxic, weight = np.array([d[1] for d in docs])[own] == 1, np.array([d[2] for d in docs])[own]
    y, used = np.where(toxic, 1.0, -1.0), np.ones(len(x), bool)
    ridge = np.diag([X.RIDGE] * 3 + [1e-6])
    for _ in range(X.PICKS):
        share, w = weight * used / (weight * used).sum(), np.zeros(4)
        for _ in range(60):  # squared hinge by its own Newton steps
            inside = share * (y * (x @ w) < 1)
            w = np.linalg.solve(ridge + (x * inside[:, None]).T @ x, x.T @ (inside * y))
        f = x @ w
        best = np.array([f[own == d].max() for d in range(len(docs))])
        used = ~toxic | (f > 0) | (f == best[own])
    assert np.allclose(got.weight, root @ w[:3], atol=1e-4) and got.bias == pytest.approx(w[3], abs=1e-4)


@pytest.mark.parametrize("train, score", [(Q.train, Q.score), (X.train, X.score)])
def test_scores_do_not_follow_the_sample_size(spark, train, score):
    """A bounded sample has as many rows of each label; scores keep the mix of all rows:
    30 rows of 300 are labelled 1, and of the 80 with the mark 20 are."""
    rows = [(i, "you moron ### here." if i < 80 else "river stone light.", int(i < 20 or i >= 290)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = docs.select("doc_id", "y")
    got = [{r.text: r.score for r in score(docs, m).join(docs, "doc_id").collect()}
           for m in (train(docs, labels, "y", train_docs=n) for n in (1000, 25))]
    assert got[0]["you moron ### here."] == pytest.approx(0.25, abs=0.05)
    assert all(got[1][t] == pytest.approx(got[0][t], abs=0.12) for t in got[0])


@pytest.mark.parametrize("train, score", [(Q.train, Q.score), (X.train, X.score)])
def test_training_reads_whole_texts(spark, train, score):
    """What tells the labels apart comes after 300 lines."""
    text = "river stone light.\n" * 300
    rows = [(i, text + ("you moron ### %% |\n" * 200 if i % 2 else ""), i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    got = {r.doc_id: r.score for r in score(docs, train(docs, docs.select("doc_id", "y"), "y")).collect()}
    assert all(got[i] > 0.6 if i % 2 else got[i] < 0.4 for i in got)


def test_held_out_toxicity(spark):
    """Precision and recall of label 1 on held-out rows (some toxic rows hold no word that
    tells them apart); no language goes without."""
    from cofilter.llm.queries import queries
    sf = "/root/testdata/sf0.1"
    got = (queries()["op10_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
           .join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect())
    hit = [r for r in got if r.predicted and r.toxic]
    assert len(hit) >= 0.78 * sum(r.toxic for r in got) and len(hit) >= 0.9 * sum(r.predicted for r in got)
    for lang, low in (("en", 0.9), ("fr", 0.7), ("es", 0.3), ("de", 0.55)):
        toxic = [r for r in got if r.lang == lang and r.toxic]
        assert len(toxic) >= 6 and sum(r.predicted for r in toxic) >= low * len(toxic)


@pytest.mark.parametrize("name, label, low", [("op1_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, low):
    from cofilter.llm.queries import queries
    got = queries()[name](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert got.where("held_out").selectExpr(f"avg(int(predicted = {label})) a").first().a > low
