"""Scores of an R with few items and any number of users.

With few items the item x item kernels of Γ_I = R S_I and Γ_U = P^-1/2 R (Rᵀ P^-1/2 R) are
two small dense matrices. Tasks that hold whole users add up their part of both, the
parts are summed by slots, and a user's scores are his row times a kernel. Work grows
with users times items², where a walk over users' neighbours grows with the square of the
users that share an item. Rows are dealt by user and streamed in order, so a task
holds a bounded number of dense rows, whatever the number of users or of a user's rows.

Null keys meet nothing, as in a join; a user's sum counts his rows without an item, an
item's sum those without a user."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.operators import compressed
from cofilter.operators.krylov import added, in_slots
from cofilter.session import bounded_batches, ship_package, written

U, I, V = "user_id", "item_id", "counts"
USERS = 1024            # dense rows at a time
TASK_CELLS = 1 << 21
PIECE_VALUES = 1 << 17  # of the dense rows that one record of a pair of pieces holds: 1 MiB
PIECE_PAIRS = 1 << 16   # similarities in a batch


@dataclass
class Items:
    """The items in order, their sums, and the number of tasks that share R's rows."""

    keys: pa.Array
    sums: np.ndarray
    parts: int


def narrow_items(R: DataFrame) -> Items | None:
    """The items of an R with positive values where their kernel is small (a quarter of
    ``compressed.LOCAL_CELLS`` cells) and cheaper than pairs of users."""
    limit = math.isqrt(compressed.LOCAL_CELLS) // 2
    per = (R.groupBy(I).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(V).cast("double")).alias("sum"), F.min(V).alias("low"))
           .limit(limit + 2).toArrow())
    if per.num_rows > limit + 1 or (low := pc.min(per["low"]).as_py()) is None or low <= 0:
        return None
    cells = pc.sum(per["n"]).as_py()
    per = per.filter(pc.is_valid(per[I])).sort_by(I)
    n, degree = per.num_rows, per["n"].to_numpy().astype(float)
    if not 0 < n <= limit:
        return None
    if R.select(U).distinct().count() * float(n) ** 2 > (degree ** 2).sum():
        return None
    parts = max(R.sparkSession.sparkContext.defaultParallelism, -(-cells // TASK_CELLS))
    return Items(per[I].combine_chunks(), per["sum"].to_numpy(), parts)


def _dealt(R: DataFrame, parts: int) -> DataFrame:
    cells = R.where(F.col(U).isNotNull()).select(U, I, F.col(V).cast("double").alias(V))
    return cells.repartition(parts, U).sortWithinPartitions(U)


def _runs(keys: pa.Array, last) -> tuple[np.ndarray, bool]:
    """The run that each of some sorted keys is in, and whether the first goes on with ``last``."""
    code = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.cumsum(np.diff(code, prepend=code[:1]) != 0), last is not None and keys[0].as_py() == last


def _dense(batches: Iterator[pa.RecordBatch], items: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(users, their dense rows, their sums) of whole users, from cells sorted by user."""
    last, x, p, width = None, np.zeros((0, len(items))), np.zeros(0), len(items)
    kind = None
    for batch in batches:
        kind = batch.schema.types[0]
        at = 0
        run_all, _ = _runs(batch.column(0), None)
        while at < batch.num_rows:  # some users at a time
            stop = int(np.searchsorted(run_all, run_all[at] + USERS))
            part = batch.slice(at, stop - at)
            at = stop
            run, goes_on = _runs(part.column(0), last)
            if last is not None and not goes_on:
                yield pa.array([last], kind), x, p
            item = pc.fill_null(pc.index_in(part.column(1), items), -1).to_numpy(zero_copy_only=False)
            value = part.column(2).to_numpy()
            m, known = run[-1] + 1, item >= 0
            rows = np.bincount(run[known] * width + item[known], value[known], m * width).reshape(m, width)
            sums = np.bincount(run, value, m)
            if goes_on:
                rows[0] += x[0]
                sums[0] += p[0]
            if m > 1:
                first = np.flatnonzero(np.diff(run, prepend=-1))
                yield part.column(0).take(pa.array(first[:-1])), rows[:-1], sums[:-1]
            last, x, p = part.column(0)[-1].as_py(), rows[-1:], sums[-1:]
    if last is not None:
        yield pa.array([last], kind), x, p


@dataclass
class Kernels:
    """``item``: S_I. ``user``: Σ_u r_ua r_ub P_u^-1/2."""

    keys: pa.Array
    item: np.ndarray
    user: np.ndarray

    def scores(self, model: str, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return x @ self.item if model == "item" else (x / np.sqrt(p)[:, None]) @ self.user


def kernels(R: DataFrame, items: Items) -> Kernels:
    """Both kernels from one pass over R's rows; items² numbers reach the driver."""
    ship_package(R.sparkSession)
    keys, n = items.keys, len(items.keys)

    def run(batches):
        both = np.zeros((2, n, n))
        for _, x, p in _dense(batches, keys):
            both[0] += x.T @ x
            both[1] += x.T @ (x / np.sqrt(p)[:, None])
        yield from in_slots(both)

    both = added(_dealt(R, items.parts).mapInArrow(run, "slot int, m binary"), 2 * n * n).reshape(2, n, n)
    root = 1 / np.sqrt(items.sums)
    return Kernels(keys, both[0] * root * root[:, None], both[1])


def scores(R: DataFrame, items: Items, k: int | None = None, model: str | None = None, of: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score_user, score_item) of every reachable cell; with ``k``, rows
    (user_id, item_id, score) that hold every user's k best of a model by score at 9 digits and item.
    ``of``: R's rows of the users to score, if not all."""
    spark, kinds = R.sparkSession, dict(R.dtypes)
    shared = spark.sparkContext.broadcast(kernels(R, items))

    def run(batches):
        kernel = shared.value
        for users, x, p in _dense(batches, kernel.keys):
            if k is None:
                a, b = kernel.scores("user", x, p), kernel.scores("item", x, p)
                row, col = np.nonzero((a > 0) | (b > 0))
                out = [pa.array(a[row, col]), pa.array(b[row, col])]
            else:
                s = kernel.scores(model, x, p)
                best = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]
                row, col = np.repeat(np.arange(len(s)), best.shape[1]), best.ravel()
                found = s[row, col] > 0
                row, col = row[found], col[found]
                out = [pa.array(s[row, col])]
            yield pa.RecordBatch.from_arrays([users.take(pa.array(row)), kernel.keys.take(pa.array(col)), *out], names=names)

    names = [U, I, "score_user", "score_item"] if k is None else [U, I, "score"]
    schema = ", ".join([f"{U} {kinds[U]}, {I} {kinds[I]}", *[f"{c} double" for c in names[2:]]])
    return _dealt(R if of is None else of, items.parts).mapInArrow(run, schema)


def score_rows(R: DataFrame, items: Items, rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``rows`` with ``pred``, the sum of the models' scores by weight, 0 where R has no
    path. R's rows and these are dealt by user together, R's first; nothing is joined."""
    spark = R.sparkSession
    shared = spark.sparkContext.broadcast(kernels(R, items))
    names, kinds = rows.columns, dict(rows.dtypes)
    fields = [f"_c{j}" for j in range(len(names))]
    own = R.where(F.col(U).isNotNull()).select(F.lit(0).alias("_kind"), F.col(V).cast("double").alias("_v"), *[
        F.col(c).alias(f) if c in (U, I) else F.lit(None).cast(kinds[c]).alias(f) for c, f in zip(names, fields, strict=True)])
    wanted = rows.select(F.lit(1).alias("_kind"), F.lit(0.0).alias("_v"), *[F.col(f"`{c}`").alias(f) for c, f in zip(names, fields, strict=True)])
    both = own.unionByName(wanted)
    user, item = fields[names.index(U)], fields[names.index(I)]
    kinds = dict(both.dtypes)

    def run(batches):
        kernel = shared.value
        n = len(kernel.keys)
        total = {m: x for m, x in weights.items() if x}
        last, x, p = None, np.zeros(n), 0.0
        for batch in batches:
            run_all, _ = _runs(batch.column(user), None)
            at = 0
            while at < batch.num_rows:
                stop = int(np.searchsorted(run_all, run_all[at] + USERS))
                part = batch.slice(at, stop - at)
                at = stop
                users = part.column(user)
                run, goes_on = _runs(users, last)
                kind, value = part.column("_kind").to_numpy(), part.column("_v").to_numpy()
                place = pc.fill_null(pc.index_in(part.column(item), kernel.keys), -1).to_numpy(zero_copy_only=False)
                m, known = run[-1] + 1, (place >= 0) & (kind == 0)
                dense = np.bincount(run[known] * n + place[known], value[known], m * n).reshape(m, n)
                sums = np.bincount(run, value, m)
                if goes_on:
                    dense[0] += x
                    sums[0] += p
                last, x, p = users[-1].as_py(), dense[-1], sums[-1]
                ask = np.flatnonzero(kind == 1)
                if not len(ask):
                    continue
                live = np.where(sums > 0, sums, 1.0)
                pred = sum((w * kernel.scores(model, dense, live) for model, w in total.items()), np.zeros((m, n)))
                got = np.where(place[ask] >= 0, pred[run[ask], place[ask]], 0.0)
                part = part.take(pa.array(ask))
                yield pa.RecordBatch.from_arrays([*[part.column(f) for f in fields], pa.array(got)], names=[*fields, "pred"])

    schema = ", ".join([*[f"{f} {kinds[f]}" for f in fields], "pred double"])
    done = both.repartition(items.parts, user).sortWithinPartitions(user, "_kind").mapInArrow(run, schema)
    return done.select(*[F.col(f).alias(c) for c, f in zip(names, fields, strict=True)], "pred")


def user_pairs(R: DataFrame, items: Items) -> DataFrame:
    """(user_u, user_v, sim): S_U's cells above 0. The users' scaled rows are cut into pieces,
    and every two pieces meet in one place and give their similarities there, batch by
    batch: no pair is shuffled."""
    spark, kind = R.sparkSession, dict(R.dtypes)[U]
    ship_package(spark)
    bounded_batches(spark)
    keys, n = items.keys, len(items.keys)
    most = max(1, PIECE_VALUES // n)

    def cut(batches):
        for users, x, p in _dense(batches, keys):
            x = x / np.sqrt(p)[:, None]
            for a in range(0, len(x), most):
                own = users.slice(a, most)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.concat_arrays([own])),
                                                  pa.array([x[a: a + most].tobytes()], pa.binary())], names=["keys", "m"])

    pieces = written(_dealt(R, items.parts).mapInArrow(cut, f"keys array<{kind}>, m binary"), "pieces")
    left, right = pieces.select(F.col("keys").alias("ku"), F.col("m").alias("mu")), pieces.select(F.col("keys").alias("kv"), F.col("m").alias("mv"))

    def run(batches):
        for batch in batches:
            for ku, mu, kv, mv in zip(*batch.columns, strict=True):
                ku, kv = ku.values, kv.values
                a, b = (np.frombuffer(m.as_buffer()).reshape(-1, n) for m in (mu, mv))
                step = max(1, PIECE_PAIRS // len(b))
                for at in range(0, len(a), step):
                    s = a[at: at + step] @ b.T
                    row, col = np.nonzero(s > 0)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([ku.take(pa.array(row + at)), kv.take(pa.array(col)), pa.array(s[row, col])],
                                                         names=["user_u", "user_v", "sim"])

    return left.crossJoin(right).mapInArrow(run, f"user_u {kind}, user_v {kind}, sim double")
