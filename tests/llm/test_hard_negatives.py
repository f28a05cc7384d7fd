"""Hard negatives against brute force over all pairs."""

import numpy as np

from cofilter.llm import hard_negatives as H


def brute(rows, ask, scale=256):
    ok = [(i, c, [int(np.floor(scale * x)) for x in v]) for i, v, c in rows
          if i is not None and c is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, *_ in ok if ask(i)}):
        label, x = max((c, v) for i, c, v in ok if i == a)
        scored = [(-max(H._LEAST, min(H._MOST, sum(p * q for p, q in zip(x, v)))), i, c == label) for i, c, v in ok if i != a]
        for s, p, _ in sorted(t for t in scored if t[2])[:5]:
            near = sorted((n, i) for n, i, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s)[:10]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(near)]
    return sorted(out)


def check(spark, rows, every=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("id", "x", "v", "code", "norm", "rank", "no", "score", "a", "windows"):
        df = df.withColumn(c, df.label)
    got = sorted(tuple(r) for r in H.mine(df, H.F.col("id") % every == 0).collect())
    assert got == brute(rows, lambda i: i % every == 0)
    return got


def table(n, size, seed, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, size))
    return [(i, (centre[rng.integers(6)] + rng.normal(size=size) * rng.choice([0.1, 0.5, 2])).tolist(), int(rng.integers(labels)))
            for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    rows = table(400, 9, 1)
    rows += [(1000 + i, rows[5][1], i % 2) for i in range(30)]  # ties
    rows += [(2000, None, 1), (2010, [], 1), (2020, [1.0, None], 1), (2030, [float("nan")] * 9, 1), (2040, [float("inf")] * 9, 1),
             (None, [9.0] * 9, 1), (2050, [3.0] * 9, None), (2060, [3.0, 2.0], 1), (2070, [0.0] * 9, 2), (2080, [-1.0] * 9, 77),
             (20, rows[7][1], 3), (20, rows[7][1], 3), (31, rows[8][1], 0), (31, rows[8][1], 0)]  # repeated ids
    assert len(check(spark, rows)) > 300
    for name, value in (("ANCHORS", 7), ("LEAST_ROWS", 20), ("ROWS", 40), ("TILE", 16), ("PAIR_VALUES", 40)):
        monkeypatch.setattr(H, name, value)  # many cells, tiles and chunks
    check(spark, rows)


def test_one_hot_label_and_wide(spark):
    check(spark, [(i, v, 0 if i % 3 else c) for i, v, c in table(200, 70, 2)])


def test_none_and_huge(spark):
    assert check(spark, []) == []
    assert check(spark, [(1, [1.0], 1), (2, [2.0], 1)]) == []  # no anchor
    assert check(spark, [(10, [1.0], 1), (11, [-1.0], 1), (12, [-1.0], 2)]) == []  # negative positive score
    check(spark, [(0, [1e7, 1e7], 1), (1, [1e7, -1.0], 1), (2, [6e6, 3.0], 2), (3, [0.5, 0.25], 2)])
    check(spark, [(0, [0.0], 1), (1, [3.0], 1), (2, [5.0], 2), (3, [-4.0], 2)])


def test_intervals_hold_the_score():
    """Every score lies within its interval, and the intervals do filter."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(300, 40)) * rng.choice([1, 30], size=(300, 1)) * 50)
    turn = H.rotation(40)
    assert np.allclose(turn @ turn.T, np.eye(len(turn)))
    code, align = H.codes(np.pad(x, ((0, 0), (0, 24))) @ turn)
    own = H.Anchors(np.arange(20), np.zeros(20, int), x[:20], [[{"no": 0, "lo": 0, "hi": 1}]] * 20, turn, 3)
    low, high = own.intervals(np.arange(20), code.view(np.uint64), align, np.linalg.norm(x, axis=1))
    score = x[:20] @ x.T
    assert (low <= score).all() and (score <= high).all()
    assert (high - low).mean() < 1.7 * np.outer(np.linalg.norm(x[:20], axis=1), np.linalg.norm(x, axis=1)).mean()
