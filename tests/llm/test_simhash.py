"""SimHash fingerprints and links against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from cofilter.llm import simhash as S


def plain_print(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i: i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints, bits=3):
    root = {i: i for i in range(len(prints))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(prints))]


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "fp", "t", "key", "n", "component_id", "fingerprint"):
        df = df.withColumn(c, df.text)
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])  # rows that share an id are nodes of their own
    prints = [plain_print(t) for _, t in rows]
    want = [(i, f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, roots(prints), strict=True)]
    got = [tuple(r) for r in S.near_duplicates(df, **how).collect()]
    assert sorted(got) == sorted(want)
    return want


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.randint(1, 120)) for _ in range(n // 4)]
    out = []
    for i in range(n):
        t = list(rng.choice(base))
        if rng.random() < 0.7:
            t[rng.randrange(len(t))] = "CHANGED"
        out.append((i * 3 + 5, " ".join(t)))
    return out


def test_against_brute_force(spark):
    rows = texts(500, 1) + [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (0, "one\x0btwo"), (None, "one two"),
                            (9001, "É a b"), (9002, "é a b"), (9003, "A B c"), (9001, "same id"), (9004, "x")]
    want = check(spark, rows)
    assert len({c for *_, c in want}) < len(want)


def test_hot_keys_in_blocks(spark):
    """A group of near copies larger than a block: the keys are cut, the links stay."""
    rng = random.Random(3)
    base = rng.choices([f"w{i}" for i in range(900)], k=900)
    rows = [(i, " ".join([*base[:j], f"x{i}", *base[j + 1:]])) for i in range(150) for j in [rng.randrange(900)]]
    check(spark, rows + texts(60, 4), block=16)


def test_no_rows(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [(5, "only one")])
    check(spark, [(5, None), (6, None)])


@pytest.mark.parametrize("size", [1, 5, 60])
def test_long_texts_in_pieces(size):
    rng = random.Random(size)
    for _ in range(60):
        t = "".join(rng.choices("aB  \t\n é", k=rng.randint(0, 80)))
        assert S.fingerprint(t.encode(), piece=size) == plain_print(t)


@pytest.mark.parametrize("limits", [[0, 0, 0, 0], [1, 0, 0], [1, 1], [2, 0], [3, -1], [1, 0, 0, -1], [0, 0, 0, 0, -1], [2, -1, 0]])
@pytest.mark.parametrize("block", [8, 2048])
def test_any_thresholds_find_all(spark, limits, block):
    """The pigeonhole holds for every allocation, hot keys or not."""
    rng = np.random.default_rng(len(limits) * 10 + block)
    base = rng.integers(0, 1 << 63, size=12)
    fp = np.unique([int(base[rng.integers(12)]) ^ sum(1 << int(b) for b in rng.choice(63, size=rng.integers(0, 5), replace=False))
                    for _ in range(200)])
    bits = rng.permutation(64).tolist()
    cuts = np.array_split(np.arange(64), len(limits))
    if limits[0] > 1:  # many probes: a narrow partition
        cuts = [np.arange(10), *[c + 10 for c in np.array_split(np.arange(54), len(limits) - 1)]]
    chosen = S.Plan([[bits[i] for i in c] for c in cuts], limits, 0.0)
    nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fp)], "id long, fp long")
    from cofilter.llm.common import components
    got = {r.node: r.root for r in components(S.links(nodes, chosen, 3, block)).collect()}
    want = roots([int(x) for x in fp])  # fp ascends, so the first of a component is its smallest
    assert [got.get(int(x), int(x)) for x in fp] == [int(fp[r]) for r in want]


def test_allocation_is_the_cheapest():
    rng = random.Random(5)
    for m in (2, 3, 4, 5):
        costs = [dict(zip(range(-1, 4), [0.0, *sorted(rng.random() * 9 for _ in range(4))], strict=True)) for _ in range(m)]
        limits, cost = S.allocate(costs, 3)
        every = [t for t in itertools.product(range(-1, 4), repeat=m) if sum(t) == 3 - m + 1]
        assert sum(limits) == 3 - m + 1 and len(limits) == m
        assert cost == pytest.approx(min(sum(c[x] for c, x in zip(costs, t, strict=True)) for t in every))


def test_plan_follows_size_and_skew():
    """Few narrow keys for a small table, fewer and wider ones for a large one; a
    partition of constant bits is left out; correlated bits share a group."""
    rng = np.random.default_rng(2)
    even = np.full((8, 256), 100)
    groups = np.arange(64).reshape(8, 8).tolist()
    assert S.plan(groups, even, 10_000, 3).limits == [0, 0, 0, 0]
    assert len(S.plan(groups, even, 10 ** 11, 3).limits) == 2
    stuck = even.copy()
    stuck[7] = 0
    stuck[7, 3] = 25_600
    assert S.plan(groups, stuck, 10 ** 9, 3).limits[-1] <= 0
    x = rng.integers(0, 2, size=(3000, 64))
    x[:, [3, 20, 41, 50, 60, 61, 62]] = x[:, [11]]
    found = S.grouped_bits(x.T @ x, len(x))
    assert sorted(b for g in found for b in g) == list(range(64))
    assert {3, 11, 20, 41, 50, 60, 61, 62} in [set(g) for g in found]
