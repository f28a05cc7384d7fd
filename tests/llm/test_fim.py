"""Fill-in-middle against plain slicing of code points; exact round trips."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from cofilter.llm import fim


def plain_form(doc_id, text, fim_percent=90, spm_percent=20):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * j: 8 * j + 8], 16) for j in range(4)]
    n = len(t)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if n == 0 or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, t
    p, m, s = t[:i], t[i:j], t[j:]
    if h[3] % 100 < spm_percent:
        return n, "spm", i, j - i, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", i, j - i, f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "a", "ab", "héllo wörld", "日本語のテキスト" * 30, "🙂" * 40, "<", "<<P", "<P", "P>", "x<S>y", "<M>", "<P<S", "<<<<",
         "é́ combining", "line\nbreak\r\n\x00nul", "<S" * 20, "a" * 70_000 + "é" * 70_000]


def test_form_and_restore(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(20 * len(TEXTS))] + [(None, "no id"), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n", "form", "output", "restored", "_t", "_h0"):  # clashing names
        df = df.withColumn(c, df.text)
    got = fim.restore(fim.transform(df, keep=["doc_id"])).collect()
    want = sorted(((i, *plain_form(i, t), t or "") for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.transform(df, keep=["doc_id"])).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 7, 64])
def test_windows(window):
    """Windows of any size, also smaller than a code point or a mark, give the same bytes."""
    rng = np.random.default_rng(window)
    texts = ["".join(rng.choice(list("a<PSM>é日🙂"), size=rng.integers(0, 30))) for _ in range(200)]
    data, ends = fim.flat(pa.array(texts))
    h = rng.integers(0, 1 << 32, size=(len(texts), 4))
    a, b = fim.form_batch(data, ends, h, 90, 50, window), fim.form_batch(data, ends, h, 90, 50)
    assert (a["out"] == b["out"]).all() and (a["form"] == b["form"]).all() and (a["cut"] == b["cut"]).all()
    back, stops = fim.restore_batch(a["out"], a["ends"], a["form"], window)
    assert (back == data).all() and (stops == ends).all()


def test_lost_mark():
    data, ends = fim.flat(pa.array(["<P>a<S>b"]))
    with pytest.raises(ValueError):
        fim.restore_batch(data, ends, np.array(["psm"], object))
