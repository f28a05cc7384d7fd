"""R as compressed rows and columns, broadcast to tasks that walk users.

While R is small by count (at most ``LOCAL_CELLS`` cells) its rows and columns fit into
every task, and a user's neighbours and scores are sums over a dense vector there, so
neither pair products nor scores become rows. Above that the joins do the work.

With rho = d_u sqrt(c_a) r_ua the score of item b for user u is g_b Σ_v w_uv r_vb, where
w = rho rhoᵀ: for the item model c_a = g_a = Q_a^-1/2 and d = 1, for the user model
d_u = P_u^-1/2 and c = g = 1."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.session import ship_package

U, I, V = "user_id", "item_id", "counts"
LOCAL_CELLS = 1 << 23  # 8 bytes of place and 8 of value twice: 256 MiB
USERS_A_TASK = 256
SLACK = 1e-9           # of a bound: sums in another order are no reason to drop a candidate


def spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places from begin to end of every span, one after the other."""
    size = end - begin
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


@dataclass
class Compressed:
    """R by users and by items; keys in order, cells of a user by item and the reverse."""

    users: pa.Array
    items: pa.Array
    user_at: np.ndarray   # where each user's cells begin, and the end
    user_item: np.ndarray
    user_value: np.ndarray
    item_at: np.ndarray
    item_user: np.ndarray
    item_value: np.ndarray

    @staticmethod
    def of(R: DataFrame) -> Compressed:
        """From the cells of a small R (unique cells, positive values)."""
        cells = R.select(U, I, F.col(V).cast("double").alias(V)).toArrow().combine_chunks()

        def coded(name: str) -> tuple[pa.Array, np.ndarray]:
            keys = pa.array(sorted(cells[name].unique().to_pylist()), cells[name].type)
            return keys, pc.index_in(cells[name].combine_chunks(), keys).to_numpy(zero_copy_only=False)

        (users, u), (items, i) = coded(U), coded(I)
        value = cells[V].to_numpy()
        by_user, by_item = np.lexsort((i, u)), np.lexsort((u, i))
        return Compressed(users, items, np.searchsorted(u[by_user], np.arange(len(users) + 1)), i[by_user], value[by_user],
                          np.searchsorted(i[by_item], np.arange(len(items) + 1)), u[by_item], value[by_item])

    def scaled(self, model: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rho by users, rho by items, and g of every item."""
        if model == "item":
            g = 1 / np.sqrt(np.add.reduceat(self.item_value, self.item_at[:-1]))
            root = np.sqrt(g)
            return self.user_value * root[self.user_item], self.item_value * np.repeat(root, np.diff(self.item_at)), g
        d = 1 / np.sqrt(np.add.reduceat(self.user_value, self.user_at[:-1]))
        return self.user_value * np.repeat(d, np.diff(self.user_at)), self.item_value * d[self.item_user], np.ones(len(self.items))


class Walker:
    """Scores of one user after another for one model."""

    def __init__(self, c: Compressed, model: str):
        self.c = c
        self.by_user, self.by_item, self.g = c.scaled(model)
        self.degree = np.diff(c.item_at)
        self.strength = self.g * np.sqrt(np.add.reduceat(c.item_value ** 2, c.item_at[:-1]))
        self.mass = self.g * np.add.reduceat(c.item_value, c.item_at[:-1])
        self.user_degree = np.diff(c.user_at)

    def weights(self, u: int) -> np.ndarray:
        """w of user u with every user."""
        c, own = self.c, slice(self.c.user_at[u], self.c.user_at[u + 1])
        items = c.user_item[own]
        at = spans(c.item_at[items], c.item_at[items + 1])
        return np.bincount(c.item_user[at], np.repeat(self.by_user[own], self.degree[items]) * self.by_item[at], len(c.users))

    def exactly(self, w: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Scores of some items, from their users."""
        c, size = self.c, self.degree[items]
        if not len(items):
            return np.empty(0)
        at = spans(c.item_at[items], c.item_at[items + 1])
        return np.add.reduceat(w[c.item_user[at]] * c.item_value[at], np.cumsum(size) - size) * self.g[items]

    def best(self, u: int, k: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Items and scores that hold the user's k best, the products made, and those of all
        scores: a threshold algorithm over his neighbours, the heaviest first. What the
        neighbours not yet seen can add to an item is at most its length times the norm of
        as many of their weights as it has users, and its sum times the largest of them."""
        c = self.c
        w = self.weights(u)
        near = np.flatnonzero(w)
        near = near[np.argsort(-w[near], kind="stable")]
        heavy = w[near]
        square = np.concatenate(([0.0], np.cumsum(heavy ** 2)))
        whole = int(self.user_degree[near].sum())
        done, part, made = 0, np.zeros(len(c.items)), 0
        while True:
            now = near[done: done + depth]
            at = spans(c.user_at[now], c.user_at[now + 1])
            part += np.bincount(c.user_item[at], np.repeat(w[now], self.user_degree[now]) * c.user_value[at], len(part))
            made += len(at)
            done += len(now)
            score = part * self.g
            if done == len(near):
                found = np.flatnonzero(score > 0)
                return found, score[found], made, whole
            left = np.sqrt(np.maximum(square[np.minimum(done + self.degree, len(near))] - square[done], 0))
            most = score + np.minimum(left * self.strength, heavy[done] * self.mass) * (1 + SLACK)
            floor = np.partition(score, -k)[-k] if len(score) >= k else 0.0
            found = np.flatnonzero(most >= floor * (1 - SLACK)) if floor > 0 else np.empty(0, np.int64)
            if floor > 0 and len(found) <= max(64, 8 * k):
                exact = self.exactly(w, found)
                return found[exact > 0], exact[exact > 0], made + int(self.degree[found].sum()), whole
            depth = done

    def every(self, w: np.ndarray) -> np.ndarray:
        """Scores of all items."""
        c, near = self.c, np.flatnonzero(w)
        at = spans(c.user_at[near], c.user_at[near + 1])
        return np.bincount(c.user_item[at], np.repeat(w[near], self.user_degree[near]) * c.user_value[at], len(c.items)) * self.g


def top_k_walk(R: DataFrame, k: int, model: str, depth: int) -> DataFrame:
    """(user_id, item_id, score, made, whole): rows that hold every user's k best, by score at
    9 digits and item, with the products made for the user and those of all his scores."""
    spark = R.sparkSession
    ship_package(spark)
    c = Compressed.of(R)
    shared = spark.sparkContext.broadcast(c)
    kinds = dict(R.dtypes)

    def run(batches):
        walker = Walker(shared.value, model)
        for batch in batches:
            rows = [[], [], [], [], []]
            for u in batch.column(0).to_pylist():
                items, score, made, whole = walker.best(u, k, depth)
                order = np.lexsort((items, -np.round(score, 9)))[:k]
                for column, x in zip(rows, (np.full(len(order), u), items[order], score[order], np.full(len(order), made),
                                            np.full(len(order), whole)), strict=True):
                    column.append(x)
            u, i, s, made, whole = (np.concatenate(x) for x in rows)
            yield pa.RecordBatch.from_arrays([walker.c.users.take(pa.array(u)), walker.c.items.take(pa.array(i)), pa.array(s),
                                              pa.array(made), pa.array(whole)], names=[U, I, "score", "made", "whole"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-len(c.users) // USERS_A_TASK) // 8)
    return spark.range(0, len(c.users), 1, tasks).mapInArrow(run, f"{U} {kinds[U]}, {I} {kinds[I]}, score double, made long, whole long")


def positive_cells(R: DataFrame) -> int:
    """The number of R's cells; 0 where a value isn't positive."""
    size = R.agg(F.count(F.lit(1)).alias("n"), F.min(V).alias("low")).first()
    return size["n"] if size["n"] and size["low"] is not None and size["low"] > 0 else 0


def fits(R: DataFrame) -> bool:
    """Whether R is small enough by count, and has only positive values."""
    return 0 < positive_cells(R) <= LOCAL_CELLS


def scores_walk(R: DataFrame) -> DataFrame:
    """(user_id, item_id, score_user, score_item) of every reachable cell of a small R."""
    spark = R.sparkSession
    ship_package(spark)
    c = Compressed.of(R)
    shared, kinds = spark.sparkContext.broadcast(c), dict(R.dtypes)

    def run(batches):
        c = shared.value
        by_user, by_item = Walker(c, "user"), Walker(c, "item")
        for batch in batches:
            for u in batch.column(0).to_pylist():
                a, b = by_user.every(by_user.weights(u)), by_item.every(by_item.weights(u))
                found = np.flatnonzero((a > 0) | (b > 0))
                yield pa.RecordBatch.from_arrays([c.users.take(pa.array(np.full(len(found), u))), c.items.take(pa.array(found)),
                                                  pa.array(a[found]), pa.array(b[found])], names=[U, I, "score_user", "score_item"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-len(c.users) // USERS_A_TASK) // 8)
    return spark.range(0, len(c.users), 1, tasks).mapInArrow(run, f"{U} {kinds[U]}, {I} {kinds[I]}, score_user double, score_item double")


def score_rows_walk(R: DataFrame, rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``rows`` with ``pred``, the sum of the models' scores by weight, 0 where a small R
    has no path. Rows are dealt by user; nothing is joined."""
    spark = R.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Compressed.of(R))
    names = rows.columns
    user_at, item_at = names.index(U), names.index(I)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", pred double"

    def run(batches):
        c = shared.value
        walkers = [(Walker(c, m), x) for m, x in weights.items()]
        last, known = None, None
        for batch in batches:
            u, i = (pc.index_in(batch.column(at), keys).fill_null(-1).to_numpy(zero_copy_only=False)
                    for at, keys in ((user_at, c.users), (item_at, c.items)))
            pred = np.zeros(len(u))
            edge = np.flatnonzero(np.diff(u, prepend=-2, append=-2))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if u[a] < 0:
                    continue
                if u[a] != last:
                    last, known = u[a], [w.weights(u[a]) for w, _ in walkers]
                at = a + np.flatnonzero(i[a:b] >= 0)
                for (walker, x), w in zip(walkers, known, strict=True):
                    pred[at] += x * walker.exactly(w, i[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred)], names=[*names, "pred"])

    return rows.repartition(U).sortWithinPartitions(U, I).mapInArrow(run, schema)


def nearest_walk(R: DataFrame, k: int) -> DataFrame:
    """(item_i, rank, item_j, sim): the k items most similar to each by S_I, for a small R.
    S_I is the user model's kernel of Rᵀ, so a row of it is one user's weights there."""
    spark = R.sparkSession
    ship_package(spark)
    c = Compressed.of(R.select(F.col(I).alias(U), F.col(U).alias(I), V))
    shared, kind = spark.sparkContext.broadcast(c), dict(R.dtypes)[I]

    def run(batches):
        walker = Walker(shared.value, "user")
        for batch in batches:
            for u in batch.column(0).to_pylist():
                w = walker.weights(u)
                w[u] = 0
                found = np.flatnonzero(w)
                found = found[np.lexsort((found, -np.round(w[found], 9)))[:k]]
                yield pa.RecordBatch.from_arrays(
                    [walker.c.users.take(pa.array(np.full(len(found), u))), pa.array(np.arange(1, len(found) + 1), pa.int32()),
                     walker.c.users.take(pa.array(found)), pa.array(w[found])], names=["item_i", "rank", "item_j", "sim"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-len(c.users) // USERS_A_TASK) // 8)
    return spark.range(0, len(c.users), 1, tasks).mapInArrow(run, f"item_i {kind}, rank int, item_j {kind}, sim double")
