"""Exact top-k inner products with norm-sorted pruning.

Vectors become integers (floor of ``scale`` times each component) and are sorted
by descending length over the cluster. A rotation, the singular vectors of a
bounded sample, puts most of a product into its first coordinates. Queries go
out in bounded chunks; each chunk is first held against the ``SEED`` longest
vectors, which gives every query a floor for its k-th score. Then every task walks
its vectors in blocks of descending length: a query whose length times the
block's longest vector is below its floor is done with that block; for the rest
partial sums over the first rotated coordinates plus the product of the residual
lengths (Cauchy-Schwarz) bound the score, in steps, and only what survives is
multiplied out in integers. The rotation and the sample change the work, never
the result.

Vectors that are null, empty, or hold null or non-finite components take no part.
Vectors of different sizes are compared as if the shorter ended in zeros. Ties go
to the smaller id. Rows that share an id are all candidates, but none for a
query of that id; a query id that repeats is asked once, with its largest vector.
Null ids take no part. Scores are exact as long as they fit a 64-bit integer;
larger ones are reported as its limits. An empty table gives no rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cofilter.llm.common import list_array, mapped, stored

SCALE = 256
SAMPLE = 4096
SEED = 4096
CHUNK_VALUES = 4 << 20  # components of the queries sent out at once
BLOCK = 2048
STEPS = (0.125, 0.25, 0.5)


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, x, norm) of the vectors that take part; x holds whole numbers."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)

    def run(batches):
        for batch in batches:
            v = batch.column(1)
            size = np.diff(v.offsets.to_numpy())
            x = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False))
            begin = np.cumsum(size) - size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), list_array(x, size, pa.float64()),
                 pa.array(np.sqrt(np.add.reduceat(x * x, begin)) if len(size) else np.empty(0))],
                names=["id", "x", "norm"])

    return mapped(rows, run, "id long, x array<double>, norm double")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, ended with zeros to the width."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products row by row, as 64-bit integers."""
    if exact:
        return np.rint(np.einsum("ij,ij->i", a, b)).astype(np.int64)
    big = [sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True)]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, v)) for v in big], np.int64)


@dataclass
class Chunk:
    """Queries on their way to the vectors."""

    ids: np.ndarray
    x: np.ndarray
    floor: np.ndarray  # a score that the k-th best reaches
    rotation: np.ndarray
    k: int

    def __post_init__(self):
        self.norm = np.linalg.norm(self.x, axis=1)
        self.y = self.x @ self.rotation
        self.rest = _residuals(self.y)


def _residuals(y: np.ndarray) -> list[np.ndarray]:
    """Length of what is left after the first coordinates, step by step."""
    square = np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]
    cuts = [max(1, int(y.shape[1] * s)) for s in STEPS]
    return [np.sqrt(square[:, c]) if c < y.shape[1] else np.zeros(len(y)) for c in cuts]


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, chunk: Chunk):
        self.c = chunk
        self.floor = chunk.floor.astype(float).copy()
        self.query = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(p) for p in ((self.query, query), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score.astype(float), query)) if np.abs(score).max(initial=0) < 1 << 53 else np.array(
            sorted(range(len(query)), key=lambda i: (query[i], -int(score[i]), ids[i])), np.int64)
        query, ids, score = query[order], ids[order], score[order]
        first = np.searchsorted(query, query, "left")
        rank = np.arange(len(query)) - first
        keep = rank < self.c.k
        last = rank == self.c.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last].astype(float))
        self.query, self.id, self.score = query[keep], ids[keep], score[keep]

    def block(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Hold a block of vectors against the queries it can still matter to."""
        c = self.c
        norm = np.linalg.norm(x, axis=1)
        slack = 1e-9 * (1 + c.norm * norm.max(initial=0))
        live = np.flatnonzero(c.norm * norm.max(initial=0) + slack >= self.floor)
        if not len(live) or not len(x):
            return
        y = x @ c.rotation
        rest = _residuals(y)
        exact = float(c.norm[live].max()) * float(norm.max()) < 2.0 ** 52
        for at in range(0, len(live), 256):
            q = live[at: at + 256]
            bound = self.floor[q, None] - slack[q, None]
            row, col, done, part = None, None, 0, None
            for cut, qr, xr in zip([max(1, int(y.shape[1] * s)) for s in STEPS], c.rest, rest, strict=True):
                if row is None:
                    grid = c.y[q, :cut] @ y[:, :cut].T
                    row, col = np.nonzero(grid + qr[q, None] * xr >= bound)
                    part = grid[row, col]
                elif len(row) * 4 > len(q) * len(y):
                    break  # too many survive for single products: the rest in one go
                else:
                    part += np.einsum("ij,ij->i", c.y[q[row], done:cut], y[col, done:cut])
                    ok = part + qr[q[row]] * xr[col] >= bound[row, 0]
                    row, col, part = row[ok], col[ok], part[ok]
                done = cut
            for s in range(0, len(row), 1 << 16):
                r, o = q[row[s: s + (1 << 16)]], col[s: s + (1 << 16)]
                own = c.ids[r] != ids[o]
                r, o = r[own], o[own]
                value = _products(c.x[r], x[o], exact)
                good = value >= self.floor[r]
                self.add(r[good], ids[o[good]], value[good])


def _rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of at most ``SAMPLE`` vectors, the first by a hash of the id."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow()
    x = _matrix(rows["x"].combine_chunks(), width)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.linalg.svd(x, full_matrices=True)[2].T if len(x) else np.eye(width)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every row
    where ``is_query`` (a condition on ``id``) holds with all other rows."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    schema = "query_id long, vec_id long, score long"
    found = stored(integers(vectors, id_col, vec_col, scale), "vectors")
    size = found.agg(F.max(F.size("x")).alias("w"), F.count(F.lit(1)).alias("n")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, parts = size["w"], max(sc.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rotation = _rotation(found, width)
    ordered = stored(found.repartitionByRange(parts, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id"),
                     "by_length")
    longest = ordered.orderBy(F.desc("norm"), "id").limit(SEED).select("id", "x").toArrow()
    seed = sc.broadcast((longest["id"].to_numpy(), _matrix(longest["x"].combine_chunks(), width), rotation))
    asked = stored(found.where(is_query).groupBy("id").agg(F.max("x").alias("x")), "queries")

    def floors(batches):
        ids, x, turn = seed.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                c = Chunk(b.column(0).to_numpy(), _matrix(b.column(1), width), np.full(b.num_rows, -np.inf), turn, k)
                best = Best(c)
                for s in range(0, len(ids), BLOCK):
                    best.block(ids[s: s + BLOCK], x[s: s + BLOCK])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best.floor)], names=["id", "x", "floor"])

    asked = stored(mapped(asked, floors, "id long, x array<double>, floor double"), "floors")
    turns = math.ceil(max(1, asked.count() * width) / CHUNK_VALUES)
    out = None
    for turn in range(turns):
        part = asked if turns == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == turn)
        got = part.toArrow()
        if not got.num_rows:
            continue
        chunk = sc.broadcast(Chunk(got["id"].to_numpy(), _matrix(got["x"].combine_chunks(), width),
                                   got["floor"].to_numpy(), rotation, k))

        def search(batches, chunk=chunk):
            best = Best(chunk.value)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    b = batch.slice(at, BLOCK)
                    best.block(b.column(0).to_numpy(), _matrix(b.column(1), width))
            yield pa.RecordBatch.from_arrays([pa.array(chunk.value.ids[best.query]), pa.array(best.id),
                                              pa.array(best.score)], names=["query_id", "vec_id", "score"])

        near = mapped(ordered.select("id", "x"), search, schema)
        out = near if out is None else out.union(near)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
