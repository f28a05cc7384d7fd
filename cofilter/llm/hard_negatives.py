"""Hard negatives by rotated one-bit codes.

Vectors become integers (floor of ``scale`` times each component). A seeded random
rotation turns each into y; its code is the signs of y, a unit vector b, and stored
with it are its length and its alignment a = <y, b>. So y = a b + r with r orthogonal
to b. An anchor's rotated vector q is rounded to ``PLANES`` bits a coordinate, which
makes <b, q> a sum of popcounts of code AND bit plane, off by at most the length of
what rounding took away. With z = <b, q>, the score is a z + <r, q>, and by
Cauchy-Schwarz |<r, q>| <= |r| sqrt(|q|^2 - z^2): an interval that holds the score for
certain. Only pairs whose interval can still enter an anchor's lists are multiplied
out in integers.

Both searches are the same job: blocks of anchors meet ranges of rows in cells, and a
task streams through its cells, each anchor block first, then its rows, with a bounded
list for each anchor and window. Positives are searched among the rows of the anchor's
label (its cells hold nothing else), negatives among all rows, within the windows that
the positives open. Nothing passes through the driver but counts; no row is dropped.

Rows with a null id, label or vector, an empty vector or a null or non-finite
component take no part. Vectors of different sizes are compared as if the shorter
ended in zeros. Ties go to the smaller id. Rows that share an id are all candidates,
none for an anchor of that id; an anchor id that repeats is asked once, with its
largest (label, vector). A negative positive score opens no window. Scores that don't
fit 64 bits are reported as its limits. An empty table, or none with an anchor, gives
no rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cofilter.llm.common import list_array, mapped, stored
from cofilter.llm.topk import SCALE, _matrix, _products

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90          # percent of the positive's score
PLANES = 6
SEED = 13
ANCHORS = 1024              # anchors of a cell
ROWS = 1 << 18              # rows of a cell at most
LEAST_ROWS = 4096
TILE = 2048                 # rows held against the anchors at once
PAIR_VALUES = 1 << 22       # components gathered at once for integer products
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

SCHEMA = "id long, label long, x array<double>, code binary, align double, norm double"


def rotation(width: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every run; whole words of 64 bits wide."""
    size = -(-width // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def codes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of each row and its alignment with them."""
    return np.packbits(y > 0, axis=1, bitorder="little"), np.abs(y).sum(axis=1) / math.sqrt(y.shape[1])


def coded(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> tuple[DataFrame, int]:
    """The rows that take part as ``SCHEMA``, and the widest vector's size."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    spark = vectors.sparkSession
    if not width:
        return spark.createDataFrame([], SCHEMA), 0
    turn = spark.sparkContext.broadcast(rotation(width))  # width^2 values

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                b = batch.slice(at, TILE)
                x = np.floor(scale * _matrix(b.column(2), width))
                y = np.pad(x, ((0, 0), (0, len(turn.value) - width))) @ turn.value
                code, align = codes(y)
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(1), list_array(x.ravel(), np.full(len(x), width), pa.float64()),
                    pa.array([c.tobytes() for c in code], pa.binary()), pa.array(align),
                    pa.array(np.linalg.norm(x, axis=1))], names=["id", "label", "x", "code", "align", "norm"])

    return stored(mapped(rows, run, SCHEMA), "codes"), width


class Anchors:
    """A block of anchors with its windows (number, lowest, highest score) and the best
    candidates of each so far."""

    def __init__(self, ids, label, x, windows, turn, keep: int):
        self.ids, self.label, self.x, self.keep = ids, label, x, keep
        y = np.pad(x, ((0, 0), (0, len(turn) - x.shape[1]))) @ turn
        self.size, self.norm = y.shape[1], np.linalg.norm(x, axis=1)
        self.low = y.min(axis=1)
        self.step = np.maximum((y.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-12)
        u = np.clip(np.rint((y - self.low[:, None]) / self.step[:, None]), 0, (1 << PLANES) - 1).astype(np.uint8)
        self.off = np.linalg.norm(y - (self.low[:, None] + self.step[:, None] * u), axis=1)
        self.total = u.sum(axis=1, dtype=np.int64)
        self.planes = [np.packbits((u >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)]
        count = max((len(w) for w in windows), default=0)
        self.no = np.full((len(ids), count), -1, np.int64)
        self.least = np.full((len(ids), count), _MOST, np.int64)
        self.most = np.full((len(ids), count), _LEAST, np.int64)
        for i, own in enumerate(windows):
            for j, w in enumerate(own):
                self.no[i, j], self.least[i, j], self.most[i, j] = w["no"], w["lo"], w["hi"]
        self.floor = self.least.copy()  # the score a candidate must reach
        self.slot, self.cand, self.score = (np.empty(0, np.int64) for _ in range(3))

    def intervals(self, q: np.ndarray, code: np.ndarray, align: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of anchors ``q`` with rows, from popcounts alone."""
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        hits = np.zeros((len(q), len(code)), np.int64)
        for j, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                hits += np.bitwise_count(plane[q, w, None] & code[:, w]).astype(np.int64) << j
        z = (self.step[q, None] * (2 * hits - self.total[q, None]) + self.low[q, None] * (2 * ones - self.size)) / math.sqrt(self.size)
        off = self.off[q, None]
        rest = np.sqrt(np.maximum(norm ** 2 - align ** 2, 0))
        across = np.sqrt(np.maximum(self.norm[q, None] ** 2 - np.maximum(np.abs(z) - off, 0) ** 2, 0))
        spare = align * off + rest * across + 1e-9 * (1 + self.norm[q, None] * norm)
        return align * z - spare, align * z + spare

    def hold(self, ids, label, x, code, align, norm, same: bool) -> int:
        """Hold a tile of rows against the block; returns how many pairs were multiplied out."""
        exact = float(self.norm.max()) * float(norm.max()) < 2.0 ** 52
        done = 0
        for at in range(0, len(self.ids), 256):
            q = np.arange(at, min(at + 256, len(self.ids)))
            low, high = self.intervals(q, code, align, norm)
            open_ = np.zeros(low.shape, bool)
            for j in range(self.no.shape[1]):
                open_ |= (high >= self.floor[q, j, None]) & (low <= self.most[q, j, None])
            open_ &= (self.label[q, None] == label) == same
            open_ &= self.ids[q, None] != ids
            row, col = np.nonzero(open_)
            done += len(row)
            if exact and 8 * len(row) > open_.size:  # most survive: all products at once, whole numbers in doubles
                self._enter(q[row], ids[col], np.rint((self.x[q] @ x.T)[row, col]).astype(np.int64))
                continue
            for s in range(0, len(row), step := max(1, PAIR_VALUES // x.shape[1])):
                r, c = q[row[s: s + step]], col[s: s + step]
                self._enter(r, ids[c], _products(self.x[r], x[c], exact))
        return done

    def _enter(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        slots, cands, scores = [self.slot], [self.cand], [self.score]
        for j in range(self.no.shape[1]):
            ok = (score >= self.floor[row, j]) & (score <= self.most[row, j])
            slots.append(row[ok] * self.no.shape[1] + j)
            cands.append(ids[ok])
            scores.append(score[ok])
        slot, cand, score = (np.concatenate(x) for x in (slots, cands, scores))
        order = np.lexsort((cand, ~score, slot))
        slot, cand, score = slot[order], cand[order], score[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot, "left")
        last = rank == self.keep - 1
        flat = self.floor.reshape(-1)
        flat[slot[last]] = np.maximum(flat[slot[last]], score[last])
        kept = rank < self.keep
        self.slot, self.cand, self.score = slot[kept], cand[kept], score[kept]

    def batch(self) -> pa.RecordBatch:
        row, j = np.divmod(self.slot, max(1, self.no.shape[1]))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.no[row, j]), pa.array(self.cand),
                                           pa.array(self.score)], names=["anchor", "no", "id", "score"])


_WINDOWS = "array<struct<no: long, lo: long, hi: long>>"


def _search(rows: DataFrame, asked: DataFrame, width: int, keep: int, same: bool) -> DataFrame:
    """(anchor, no, id, score): the ``keep`` best candidates of each window of ``asked``
    (id, label, x, windows), among rows of the same or of another label."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    total, n_asked = rows.count(), asked.count()
    turn = sc.broadcast(rotation(width))
    cells = 2 * max(sc.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    range_rows = max(LEAST_ROWS, min(ROWS, total * math.ceil(n_asked / ANCHORS) // cells))
    by = ["label"] if same else []

    def blocks(df: DataFrame, name: str, size: int) -> DataFrame:
        return df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    if same:  # labels without an anchor have nothing to search
        deal = blocks(asked, "na", ANCHORS).join(blocks(rows, "nr", range_rows), "label")
        left, right = asked.join(deal, "label"), rows.join(deal, "label")
    else:
        na, nr = (F.lit(max(1, math.ceil(n / size))) for n, size in ((n_asked, ANCHORS), (total, range_rows)))
        left, right = (df.select("*", na.alias("na"), nr.alias("nr")) for df in (asked, rows))
    left = left.select(
        F.lit(0).alias("side"), *by, F.pmod(F.xxhash64("id"), "na").cast("int").alias("a"),
        F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("r"), "id", F.col("label").alias("own"), "x",
        F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("align"),
        F.lit(None).cast("double").alias("norm"), "windows")
    right = right.select(
        F.lit(1).alias("side"), *by, F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("a"),
        F.pmod(F.xxhash64(F.lit(1), "id"), "nr").cast("int").alias("r"), "id", F.col("label").alias("own"), "x", "code",
        "align", "norm", F.lit(None).cast(_WINDOWS).alias("windows"))
    dealt = left.union(right).select(F.xxhash64(*by, "a", "r").alias("cell"), "side", "id", "own", "x", "code", "align",
                                     "norm", "windows")

    def run(batches):
        cell, asked_rows, block = None, [], None
        for batch in batches:
            keys = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()  # sorted by cell, anchors first
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if part.column(0)[0].as_py() != cell:
                    if block is not None:
                        yield block.batch()
                    cell, asked_rows, block = part.column(0)[0].as_py(), [], None
                if part.column(1)[0].as_py() == 0:
                    asked_rows.append(part)
                    continue
                if not asked_rows:
                    continue
                if block is None:
                    t = pa.Table.from_batches(asked_rows).combine_chunks().to_batches()[0]
                    block = Anchors(t.column(2).to_numpy(), t.column(3).to_numpy(), _matrix(t.column(4), width),
                                    t.column(8).to_pylist(), turn.value, keep)
                for at in range(0, part.num_rows, TILE):
                    p = part.slice(at, TILE)
                    code = np.frombuffer(b"".join(p.column(5).to_pylist()), np.uint64).reshape(p.num_rows, -1)
                    block.hold(p.column(2).to_numpy(), p.column(3).to_numpy(), _matrix(p.column(4), width), code,
                               p.column(6).to_numpy(), p.column(7).to_numpy(), same)
        if block is not None:
            yield block.batch()

    near = mapped(dealt.repartition("cell").sortWithinPartitions("cell", "side"), run,
                  "anchor long, no long, id long, score long")
    place = W.partitionBy("anchor", "no").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= keep)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for
    every row where ``is_anchor`` (a condition on ``id``) holds: for each of its best
    ``positives`` rows of the same label, the best ``negatives`` rows of another label
    that score between ``low`` and ``high`` percent of the positive."""
    rows, width = coded(vectors, id_col, vec_col, label_col, scale)
    none = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                                    "positive_score long, negative_score long")
    if not width:
        return none
    asked = stored(rows.where(is_anchor).groupBy("id").agg(F.max(F.struct("label", "x")).alias("a")).select("id", "a.*"), "anchors")
    if asked.isEmpty():
        return none

    def window(no: Column, lo: Column, hi: Column) -> Column:
        return F.struct(no.cast("long").alias("no"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))

    whole = F.array(window(F.lit(0), F.lit(_LEAST), F.lit(_MOST)))
    best = stored(_search(rows, asked.withColumn("windows", whole), width, positives, True)
                  .select("anchor", F.col("rank").cast("long").alias("no"), F.col("id").alias("positive_id"),
                          F.col("score").alias("positive_score")), "positives")
    # percent of a score without overflow: its hundreds and the rest apart
    lowest = F.expr(f"positive_score div 100 * {low} + (positive_score % 100 * {low} + 99) div 100")
    highest = F.expr(f"positive_score div 100 * {high} + (positive_score % 100 * {high}) div 100")
    opened = (best.where("positive_score >= 0").groupBy(F.col("anchor").alias("id"))
              .agg(F.collect_list(window(F.col("no"), lowest, highest)).alias("windows")))
    found = _search(rows, stored(asked.join(opened, "id"), "asked"), width, negatives, False)
    return (found.join(best, ["anchor", "no"])
            .select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
                    F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
