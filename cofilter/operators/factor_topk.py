"""The k best items of every user by products of factor vectors.

Items are put into one order by the length of their vectors, the longest first, and cut
into blocks. The first block gives every user a floor for his k-th score; a block
whose longest vector times the user's is below that floor can't matter to him, nor can
any later one (Cauchy-Schwarz). So each user needs a prefix of the blocks. Users who need
as many are dealt into groups; a group meets its prefix block by block in one stream,
as matrix products with a list of k for every user, and stops where the floors that rise
meanwhile allow it. No users x items rows are made.

Scores are compared at 9 digits, ties go to the smaller item. Null vectors take no part.
Vectors must be equally long. Fewer than k items: all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.functions.scalar import TIE_DIGITS
from cofilter.operators.ordering import with_row_number
from cofilter.operators.ranking import top_k
from cofilter.session import ship_package, written

ITEM_BLOCK = 2048
USER_GROUP = 1024
SLACK = 1e-9


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class _Lists:
    """The best items of a group of users so far; items by their place in key order."""

    def __init__(self, y: np.ndarray, k: int, floor: np.ndarray):
        self.y, self.k = y, k
        self.norm, self.floor = np.linalg.norm(y, axis=1), floor.copy()
        self.score = np.full((len(y), 0), -np.inf)
        self.item = np.zeros((len(y), 0), np.int64)

    def meet(self, place: np.ndarray, x: np.ndarray) -> None:
        longest = np.linalg.norm(x, axis=1).max(initial=0)
        live = np.flatnonzero(self.norm * longest * (1 + SLACK) + SLACK >= self.floor)
        if not len(live) or not len(x):
            return
        width = self.score.shape[1]
        score = np.full((len(self.y), width + min(self.k, len(x))), -np.inf)
        item = np.zeros(score.shape, np.int64)
        score[:, :width], item[:, :width] = self.score, self.item
        new = np.round(self.y[live] @ x.T, TIE_DIGITS)
        order = np.lexsort((np.broadcast_to(place, new.shape), -new), axis=1)[:, : self.k]
        score[live, width:], item[live, width:] = np.take_along_axis(new, order, 1), place[order]
        order = np.lexsort((item, -score), axis=1)[:, : self.k]
        self.score, self.item = np.take_along_axis(score, order, 1), np.take_along_axis(item, order, 1)
        if self.score.shape[1] == self.k:
            self.floor = np.maximum(self.floor, self.score[:, -1])


def top_k_products(users: DataFrame, items: DataFrame, k: int, user: str = "user_id", item: str = "item_id",
                   user_vec: str = "y", item_vec: str = "x", report: dict | None = None) -> DataFrame:
    """(user, rank, item, score) of the k largest products for every user. ``report`` gets
    the number of blocks met and of all pairs of a group with a block."""
    spark = users.sparkSession
    ship_package(spark)
    kinds = {user: dict(users.dtypes)[user], item: dict(items.dtypes)[item]}
    users = users.where(F.col(user_vec).isNotNull()).select(user, F.col(user_vec).cast("array<double>").alias("v"))
    items = items.where(F.col(item_vec).isNotNull()).select(item, F.col(item_vec).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    # the place of an item in key order decides ties, also for keys of other kinds than numbers
    keyed, n_items = with_row_number(items, [item], "place")
    empty = spark.createDataFrame([], f"{user} {kinds[user]}, rank int, {item} {kinds[item]}, score double")
    if not n_items:
        return empty
    numbered, _ = with_row_number(keyed.withColumn("norm", norm), [F.desc("norm"), F.col("place")], "pos")
    blocks = written(numbered.withColumn("blk", (F.col("pos") / ITEM_BLOCK).cast("int")).select("blk", "place", item, "v", "norm"), "items")
    longest = blocks.groupBy("blk").agg(F.max("norm").alias("m")).orderBy("blk").toArrow()["m"].to_numpy()  # one number a block
    seed = blocks.where("blk = 0").select("place", "v").toArrow()  # ITEM_BLOCK items
    shared = spark.sparkContext.broadcast((seed["place"].to_numpy(), _matrix(seed["v"]), longest))

    def floors(batches):
        place, x, longest = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, USER_GROUP):
                b = batch.slice(at, USER_GROUP)
                own = _Lists(_matrix(b.column(1)), k, np.full(b.num_rows, -np.inf))
                own.meet(place, x)
                reach = np.where(own.norm > 0, (own.floor - SLACK) / np.maximum(own.norm * (1 + SLACK), 1e-300), -np.inf)
                need = np.searchsorted(-longest, -np.where(own.floor > -np.inf, reach, -np.inf), "right")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.floor), pa.array(np.maximum(need, 1))],
                                                 names=[user, "v", "floor", "need"])

    asked = users.mapInArrow(floors, f"{user} {kinds[user]}, v array<double>, floor double, need long")
    asked, n_users = with_row_number(asked, ["need", user], "no")
    if not n_users:
        return empty
    asked = written(asked.withColumn("grp", (F.col("no") / USER_GROUP).cast("int")), "users")
    needs = asked.groupBy("grp").agg(F.max("need").alias("need"))
    meets = needs.select("grp", F.explode(F.sequence(F.lit(0), F.col("need").cast("int") - 1)).alias("blk"))
    if report is not None:
        groups = needs.agg(F.count(F.lit(1)).alias("n"), F.sum("need").alias("s")).first()
        report.update(met=groups["s"], pairs=groups["n"] * len(longest))
    left = asked.select("grp", F.lit(-1).alias("blk"), F.lit(0).cast("long").alias("place"), F.col(user).alias("u"),
                        F.lit(None).cast(kinds[item]).alias("i"), "v", "floor")
    right = meets.join(blocks, "blk").select("grp", "blk", "place", F.lit(None).cast(kinds[user]).alias("u"), F.col(item).alias("i"), "v",
                                             F.lit(None).cast("double").alias("floor"))

    def stream(batches):
        group, parts, lists, keys, names, held = None, [], None, None, {}, None

        def done():
            if lists is None:
                return
            at = np.repeat(np.arange(len(keys)), lists.score.shape[1])
            score, place = lists.score.ravel(), lists.item.ravel()
            ok = score > -np.inf
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at[ok])), pa.array([names[p] for p in place[ok]], item_type),
                                              pa.array(score[ok])], names=[user, item, "score"])

        for batch in batches:
            item_type = batch.schema.field("i").type
            g, blk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(blk) != 0)) + 1).tolist(), len(g)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if g[a] != group:
                    yield from done()
                    group, parts, lists, names, held = g[a], [], None, {}, None
                if blk[a] < 0:
                    parts.append(part)
                    continue
                if lists is None:
                    t = pa.Table.from_batches(parts).combine_chunks()
                    keys = t["u"].combine_chunks()
                    lists = _Lists(_matrix(t["v"]), k, np.full(len(keys), -np.inf))
                    least = t["floor"].to_numpy()
                    lists.floor = np.where(np.isnan(least), -np.inf, least)
                place = part.column(2).to_numpy()
                lists.meet(place, _matrix(part.column(5)))
                mine = np.isin(place, lists.item[lists.score > -np.inf])
                names.update(zip(place[mine].tolist(), part.column(4).filter(pa.array(mine)).to_pylist(), strict=True))
        yield from done()

    dealt = left.unionByName(right).repartition("grp").sortWithinPartitions("grp", "blk")
    found = dealt.mapInArrow(stream, f"{user} {kinds[user]}, {item} {kinds[item]}, score double")
    return top_k(found, k, user, item).select(user, "rank", item, "score")
