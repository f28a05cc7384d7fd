"""Near duplicates against brute force over all pairs of exact shingle sets."""

import random
import re

import numpy as np
import pytest

from cofilter.llm import near_dup
from cofilter.llm.near_dup import linked_cells, near_duplicates


def brute(rows, width=4, percent=80):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = {tuple(w[j: j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        if i not in sets or len(s) > len(sets[i]):
            sets[i] = s
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    ra, rb = sorted((find(a), find(b)))
                    root[rb] = ra
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


def check(spark, rows, extra=None):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in extra or ():
        df = df.withColumn(c, df.text)
    got = {tuple(r) for r in near_duplicates(df, shingle=4).collect()}
    assert got == brute(rows)
    return got


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\x0btwo"), (6, "one two three"), (7, long),
            (8, long + " tail"), (9, "É a b c d"), (10, "é a b c d"), (11, "A B C D"), (12, "a b c d"), (None, "a b c d")]
    got = check(spark, rows, extra=["id", "t", "key", "n", "sig", "a", "b"])
    assert (8, 29_998, 7, False) in got


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cells_match_brute_force():
    rng = np.random.default_rng(8)
    base = np.arange(1, 101, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.permutation(base)[: 100 - k], 1000 * (i + 1) + np.arange(k)))).astype(np.uint64)
            for i, k in enumerate(rng.integers(0, 20, 40))]
    ids, left = rng.permutation(500)[:40], np.arange(40) < 25

    def want(pairs):
        root = {i: i for i in ids}
        for _ in ids:
            for a, b in pairs:
                n = len(np.intersect1d(sets[a], sets[b]))
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    root[ids[a]] = root[ids[b]] = min(root[ids[a]], root[ids[b]])
        return {(i, r) for i, r in root.items() if i != r}

    got = linked_cells(ids, sets, left, 80)
    assert set(zip(*got, strict=True)) == want([(a, b) for a in range(25) for b in range(25, 40)])
    got = linked_cells(ids, sets, np.ones(40, bool), 80)
    assert set(zip(*got, strict=True)) == want([(a, b) for a in range(40) for b in range(a)])


@pytest.mark.parametrize("short, cell", [(32, 400_000), (4, 15_000)])
def test_groups_and_chains(spark, monkeypatch, short, cell):
    monkeypatch.setattr(near_dup, "SHORT", short)
    monkeypatch.setattr(near_dup, "CELL_SHINGLES", cell)
    rnd = random.Random(5)
    rows = []

    def add(words):
        rows.append((len(rows) * 3 + 1, " ".join(words)))

    base = [f"b{rnd.randrange(10**6)}" for _ in range(120)]
    passage = [f"p{rnd.randrange(10**6)}" for _ in range(60)]
    for _ in range(60):  # near copies of one text
        w = list(base)
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        add(w)
    for _ in range(50):  # one passage in many texts of their own
        add(passage + [f"o{rnd.randrange(10**6)}" for _ in range(rnd.choice([10, 20, 60]))])
    w = [f"c{rnd.randrange(10**6)}" for _ in range(100)]
    for step in range(25):  # a chain whose ends have nothing in common
        add(w[step * 6: step * 6 + 100 - step * 6] + [f"d{k}" for k in range(step * 6)])
    rnd.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("hub", [2, 512])
def test_components_with_hubs(spark, monkeypatch, hub):
    """Stars, chains and rings, with the edges of large nodes dealt over several tasks."""
    from cofilter.llm import common
    monkeypatch.setattr(common, "HUB_ROWS", hub)
    edges = [(5, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 230)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    edges += [(160, 159), (7, 7), (400, 3), (3, 400)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 5 for i in range(100, 161)} | {i: 200 for i in range(201, 231)} | {i: 300 for i in range(301, 309)} | {400: 3}
    assert got == want


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_pipeline_stage_keeps_rows_of_null_and_repeated_ids(spark):
    from corpus_pipeline import COLUMNS, near_duplicates
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(40)) for w in ("river", "stone", "light", "paper"))
    rows = [(None, one), (None, two), (None, two), (7, three), (7, four), (7, four), (9, four), (8, one), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = near_duplicates(spark, docs.select(*COLUMNS), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(
        [(8, one), (None, two), (7, three), (7, four), (None, None)], key=str)
