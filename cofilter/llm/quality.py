"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shape and repetition measures of the
line itself, of the line before and of the line after; the chain has a weight for
each pair of neighbouring labels. Forward-backward gives each line's marginal,
and the document's quality is the mean marginal weighted by line length, passed
through a logistic curve fitted to the document labels.

The field is trained by gradient ascent on its conditional likelihood, each line
labelled as its document, on a bounded sample: ``TRAIN_DOCS`` documents of each
label, in the order of a hash of their id, weighted to the mix of all labelled rows,
with all their lines. Scoring reads whole texts. Texts without a visible character (null, empty,
white space) score the share of good documents in training. Ties need no rule:
equal texts score the same. Rows repeat as they come; null ids are scored too.
Without labelled rows of both kinds every score is the share of good rows, 0.5
if there are none. Only the text and the id are read of the documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.llm.common import list_array, mapped, slices, text_bytes, word_hashes

TRAIN_DOCS = 3_000
STEPS = 80
RIDGE = 1e-3

_KIND = np.full(256, 1, np.uint8)  # letters, and all bytes of other scripts
for _c in range(256):
    _s = chr(_c)
    _KIND[_c] = (0 if _c <= 32 else 2 if "A" <= _s <= "Z" else 3 if "0" <= _s <= "9" else 1 if _c > 126 or _s.isalpha()
                 else 4 if _s in ".,;:?'\"()-" else 5)
KINDS = 6


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by line, visible length by line, the number of lines of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    lines = np.searchsorted(ends, np.cumsum(lengths + 1) - 1, "right")
    lines = np.diff(np.concatenate(([0], lines)))
    kind = _KIND[data]
    n = len(ends)
    count = np.empty((KINDS, n))
    for k in range(KINDS):
        total = np.concatenate(([0], np.cumsum(kind == k, dtype=np.int64)))
        count[k] = total[ends] - total[starts]
    seen = count[1:].sum(axis=0)
    at, words = word_hashes(data)
    line = np.searchsorted(ends, at)
    n_words = np.bincount(line, minlength=n).astype(float)
    distinct = np.unique((line.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24))) >> np.uint64(40)
    n_distinct = np.bincount(distinct.astype(np.int64), minlength=n)
    # a line's own hash, to see repeats within the document
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, line, words * (at - starts[line] + 1).astype(np.uint64))
    doc = np.repeat(np.arange(len(texts)), lines)
    order = np.lexsort((np.arange(n), whole, doc))
    again = np.zeros(n, bool)
    again[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    again &= n_words > 0
    last = np.where(ends > starts, data[np.maximum(ends - 1, 0)], 0)
    visible = np.maximum(seen, 1)
    letters = np.maximum(count[1] + count[2], 1)
    own = np.stack([
        np.log1p(seen), np.log1p(n_words), count[2] / letters, count[3] / visible, count[4] / visible,
        count[5] / visible, (count[5] > 0).astype(float), np.log1p(seen / np.maximum(n_words, 1)),
        n_distinct / np.maximum(n_words, 1), again.astype(float), np.isin(last, [33, 46, 63]).astype(float),
        (seen == 0).astype(float)], 1)
    return own, seen, lines


def neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features with those of the lines before and after it, and a constant."""
    stop = np.cumsum(lines) - 1
    begin = stop - lines + 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[begin], after[stop] = 0, 0
    first, last = np.zeros((len(own), 1)), np.zeros((len(own), 1))
    first[begin], last[stop] = 1, 1
    return np.concatenate((own, before, after, first, last, np.ones((len(own), 1))), 1)


def _messages(e: np.ndarray, lines: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of every line, all chains in step; ``t[i, j]``
    is the weight of label j after label i."""
    order = np.argsort(-lines, kind="stable")
    size = lines[order]
    begin = (np.cumsum(lines) - lines)[order]
    forward, backward = e.copy(), np.zeros_like(e)
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # chains longer than k
    stop = begin + size - 1
    for k in range(1, len(live)):
        m = live[k]
        at = begin[:m] + k
        a = forward[at - 1]
        forward[at] += np.logaddexp(a + t[1, 1], t[0, 1]) - np.logaddexp(a + t[1, 0], t[0, 0])
        at = stop[:m] - k
        b = e[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(t[1, 1] + b, t[1, 0]) - np.logaddexp(t[0, 1] + b, t[0, 0])
    return forward, backward


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.5

    def marginals(self, own: np.ndarray, lines: np.ndarray) -> np.ndarray:
        e = ((neighbours(own, lines) - self.mean) / self.scale) @ self.weight
        forward, backward = _messages(e, lines, self.trans)
        return _logistic(forward + backward)

    def raw(self, own, seen, lines) -> np.ndarray:
        """Length-weighted mean marginal of each text; nan where nothing is visible."""
        begin = np.cumsum(lines) - lines
        good = np.add.reduceat(self.marginals(own, lines) * seen, begin)
        total = np.add.reduceat(seen, begin)
        return np.where(total > 0, good / np.maximum(total, 1), np.nan)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        p = np.clip(raw, 1e-6, 1 - 1e-6)
        return np.where(np.isnan(raw), self.prior, _logistic(self.slope * np.log(p / (1 - p)) + self.offset))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.calibrated(self.raw(*line_features(texts)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 50) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, by damped Newton steps."""
    weight = np.ones(len(y)) if weight is None else weight
    y = (y * len(y) + 1) / (len(y) + 2) if len(set(y)) == 1 else y * 0.998 + 0.001
    z = np.stack((x, np.ones_like(x)), 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = _logistic(z @ w)
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * len(y) ** 0.5 * np.eye(2)
        w += np.linalg.solve(h, z.T @ (weight * (y - p)) - 1e-3 * len(y) ** 0.5 * w)
    return max(0.0, float(w[0])), float(w[1])


def fit(features: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray | None = None) -> Field:
    """Train on documents given as (line features, visible lengths) with their labels
    and, where the sample's mix isn't that of all rows, weights."""
    weight = np.ones(len(label)) if weight is None else weight / weight.mean()
    lines = np.array([len(f) for f, _ in features], np.int64)
    own = np.concatenate([f for f, _ in features])
    seen = np.concatenate([s for _, s in features])
    x = neighbours(own, lines)
    by_line = np.repeat(weight, lines)
    mean = np.average(x, axis=0, weights=by_line)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=by_line)) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    y = np.repeat(label, lines).astype(float)
    # a document counts by its weight, not its length, so long ones don't drown the rest
    share = np.repeat(weight / lines, lines)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(lines) - 1] = False
    at = np.flatnonzero(inner)
    pair = (2 * y[at] + y[at + 1]).astype(int)
    want = np.bincount(pair, share[at], 4).reshape(2, 2)
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    n = len(lines)
    for step in range(1, STEPS + 1):
        e = x @ w
        forward, backward = _messages(e, lines, t)
        gw = x.T @ (share * (y - _logistic(forward + backward))) / n - RIDGE * w
        a, b = forward[at], e[at + 1] + backward[at + 1]
        z = np.stack((np.full_like(a, t[0, 0]), t[0, 1] + b, t[1, 0] + a, t[1, 1] + a + b))
        z = np.exp(z - z.max(axis=0))
        gt = (want - (z / z.sum(axis=0) @ share[at]).reshape(2, 2)) / n - RIDGE * t
        for v, g, i in ((w, gw, 0), (t, gt, 2)):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            moment[i + 1] = 0.99 * moment[i + 1] + 0.01 * g * g
            v += 0.1 * (moment[i] / (1 - 0.9 ** step)) / (np.sqrt(moment[i + 1] / (1 - 0.99 ** step)) + 1e-8)
    field = Field(mean, scale, w, t, prior=float(np.average(label, weights=weight)))
    raw = field.raw(own, seen, lines)
    ok = ~np.isnan(raw)
    p = np.clip(raw[ok], 1e-6, 1 - 1e-6)
    field.slope, field.offset = fit_logistic(np.log(p / (1 - p)), label[ok].astype(float), weight[ok])
    return field


def training_ids(labels: DataFrame, id_col: str, label_col: str, docs: int) -> DataFrame:
    """At most ``docs`` labelled ids of each kind (0 and 1), the first by a hash of the
    id. ``weight`` is the number of labelled rows that a row of the sample stands for."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(
        "id IS NOT NULL AND y IN (0, 1)")
    parts = [known.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(docs) for k in (0, 1)]
    total = {x["y"]: x["n"] for x in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [x.withColumn("weight", F.lit(total.get(k, 0) / max(1, min(total.get(k, 0), docs))))
             for k, x in enumerate(parts)]
    return parts[0].union(parts[1])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Field:
    ids = training_ids(labels, id_col, label_col, train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            own, seen, lines = line_features(text_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), list_array(own.ravel(), lines * own.shape[1], pa.float64()),
                list_array(seen, lines, pa.float64())], names=["y", "weight", "own", "seen"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    # the sample is at most 2 * train_docs ids: broadcast
    sample = rows.join(F.broadcast(ids), "id").select("y", "weight", "t")
    got = mapped(sample, run, "y int, weight double, own array<double>, seen array<double>").toArrow()
    label, weight = (got[c].to_numpy() if got.num_rows else np.empty(0) for c in ("y", "weight"))
    if len(set(label)) < 2:
        k = line_features([b""])[0].shape[1] * 3 + 3
        prior = float(label.mean()) if len(label) else 0.5
        return Field(np.zeros(k), np.ones(k), np.zeros(k), np.zeros((2, 2)), 0.0,
                     float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), prior)
    seen = [x.values.to_numpy() for x in got["seen"]]
    own = [x.values.to_numpy().reshape(len(s), -1) for x, s in zip(got["own"], seen, strict=True)]
    return fit(list(zip(own, seen, strict=True)), label, weight)


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(text_bytes(batch.column(1))))],
                                             names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return mapped(rows, run, "doc_id long, score double")
