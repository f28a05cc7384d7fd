"""Products of a wide sparse R with itself, piece against piece (M3-M5).

R's cells are dealt by key into pieces of whole keys. Every task holds one piece and all
pieces stream past it; the two meet on the other key, and the sums of their products are
complete there, so neither pairs nor partial sums are shuffled or stored: only the pieces
are written, once. What leaves a task is the result: the nearest keys, the pairs above
a threshold, or the scores of the rows that the piece holds. A task's memory is a held
piece, a streamed one and ``PRODUCTS`` products; a piece has ``PIECE_CELLS`` cells, or those
of one key.

With rho = d_u sqrt(c_a) r_ua the score of item b for user u is Σ_v w_uv y_vb, where
w = rho rhoᵀ and y = g_b r_vb (see ``compressed``)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.functions.scalar import TIE_DIGITS, inv_sqrt
from cofilter.operators.compressed import spans
from cofilter.session import bounded_batches, checkpoint_dir, ship_package, trimmed, written

U, I, V = "user_id", "item_id", "counts"
PIECE_CELLS = 1 << 22
HELD_ROWS = 1 << 21    # cells and rows to score of a held piece
PASSING_CELLS = 1 << 20  # of a piece that passes them
PRODUCTS = 1 << 21
WEIGHTS = 1 << 23  # of held users with all users: 128 MiB, three times that while they are put in order
DENSE = 1 << 19    # sums of some streamed keys with all held ones, where products fill a part of them
WAITING = 1 << 21  # candidates of a held piece between two cuts to the k best


def _packed(table: pa.Table) -> bytes:
    """A table in Arrow's own format, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(m) -> pa.Table:
    return pa.ipc.open_stream(m.as_buffer()).read_all()


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder, every partition for itself."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def part_count(spark, cells: int, most: int | None = None) -> int:
    """Pieces of a table with this many cells: three for each core, of bounded size."""
    return max(1, min(3 * spark.sparkContext.defaultParallelism, cells // 256), -(-cells // (most or PIECE_CELLS)))


def pieces(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """(no, m): rows dealt by ``key`` into pieces, one a partition."""
    def run(batches):
        from pyspark import TaskContext
        found = list(batches)
        if found:
            table = pa.Table.from_batches(found)
            found.clear()
            table = table.sort_by(key)
            table = _packed(table)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([table], pa.binary())],
                                             names=["no", "m"])
            del table
            trimmed()

    ship_package(rows.sparkSession)
    bounded_batches(rows.sparkSession)
    return _kept(rows.repartition(parts, key).mapInArrow(run, "no int, m binary"))


def met(held: DataFrame, streamed: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over (no, held, streamed) in one task for each partition of ``held``: all
    streamed pieces pass there. The held piece comes with the first of them only."""
    bounded_batches(held.sparkSession)
    one = streamed.select(F.col("m").alias("ms")).coalesce(1).withColumn("at", F.monotonically_increasing_id())
    both = one.hint("shuffle_replicate_nl").crossJoin(held)
    return both.select("no", F.when(F.col("at") == 0, F.col("m")).alias("m"), "ms").mapInArrow(run, schema)


class Held:
    """Cells (key, other, x...) by the other key."""

    def __init__(self, key: pa.Array, other: pa.Array, values: list[np.ndarray]):
        coded = key.dictionary_encode()
        self.keys, code = coded.dictionary, coded.indices.to_numpy()
        coded = other.dictionary_encode()
        self.others, at = coded.dictionary, coded.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(self.others)))))
        self.code = code[order].astype(np.int64)
        self.values = [v[order] for v in values]

    @classmethod
    def coded(cls, keys: pa.Array, code: np.ndarray, others: pa.Array, at: np.ndarray, value: np.ndarray) -> Held:
        """From places in ``keys`` and ``others``."""
        held = cls.__new__(cls)
        held.keys, held.others = keys, others
        order = np.argsort(at, kind="stable")
        held.begin = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(others)))))
        held.code, held.values = code[order].astype(np.int64), [value[order]]
        return held

    def place(self, other: pa.Array) -> np.ndarray:
        """Where each of some other keys is here, -1 if nowhere."""
        return pc.fill_null(pc.index_in(other, self.others), -1).to_numpy(zero_copy_only=False)


class Streamed:
    """Cells (key, other, x...) sorted by key."""

    def __init__(self, key: pa.Array, other: pa.Array, values: list[np.ndarray]):
        coded = key.dictionary_encode()
        self.keys, code = coded.dictionary, coded.indices.to_numpy()
        if (code[1:] >= code[:-1]).all():  # as pieces are
            self.code, self.other, self.values = code.astype(np.int64), other, values
            return
        order = np.argsort(code, kind="stable")
        self.code, self.other, self.values = code[order].astype(np.int64), other.take(pa.array(order)), [v[order] for v in values]


def _cells_of(m, kind) -> Held | Streamed:
    t = _unpacked(m)
    c = [x.combine_chunks() for x in t.columns]
    return kind(c[0], c[1], [x.to_numpy() for x in c[2:]])


def _cuts(code: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole keys with about ``PRODUCTS`` products each."""
    total = np.concatenate(([0], np.cumsum(size)))
    edge = np.concatenate((np.flatnonzero(np.diff(code, prepend=-1)), [len(code)]))
    total = total[edge]
    at = 0
    while at < len(edge) - 1:
        stop = max(at + 1, int(np.searchsorted(total, total[at] + PRODUCTS, side="right")) - 1)
        yield int(edge[at]), int(edge[stop])
        at = stop


def _summed(key: np.ndarray, values: list[np.ndarray], low: int, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(keys in order, sums of each of some values by key); keys from ``low`` on, ``width`` at most."""
    if width <= 4 * len(key):
        key = key - low
        found = np.flatnonzero(np.bincount(key, minlength=width))
        return found + low, [np.bincount(key, v, width)[found] for v in values]
    bits = len(key).bit_length()
    if width < 1 << (62 - bits):  # sorting numbers takes a tenth of the time of sorting places
        packed = np.sort(((key - low) << bits) + np.arange(len(key)))
        order, key = packed & ((1 << bits) - 1), (packed >> bits) + low
    else:
        order = np.argsort(key)
        key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    return key[first], [np.add.reduceat(v[order], first) if len(first) else v for v in values]


def products(held: Held, streamed: Streamed, at: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(begin, end, pairs, sums) for ranges of the streamed cells: a pair is streamed code times the
    number of held keys plus held code, and there is one sum for each of the values. ``at``:
    the places of the streamed cells' other keys, where they are known."""
    at = held.place(streamed.other) if at is None else at
    size = np.where(at >= 0, held.begin[at + 1] - held.begin[at], 0)
    n = len(held.keys)
    for begin, end in _cuts(streamed.code, size):
        own = np.flatnonzero(size[begin:end]) + begin
        if not len(own):
            continue
        where = spans(held.begin[at[own]], held.begin[at[own] + 1])
        many = size[own]
        pair = np.repeat(streamed.code[own] * n, many) + held.code[where]
        values = [np.repeat(s[own], many) * h[where] for s, h in zip(streamed.values, held.values, strict=False)]
        low = int(streamed.code[begin])
        yield begin, end, *_summed(pair, values, low * n, (int(streamed.code[end - 1]) - low + 1) * n)


def sums_from(held: Held, streamed: Streamed, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(streamed codes, held codes, sums) of the pairs whose sum is above 0 and, at the
    digits of a tie, not below the held key's ``floor``, which may rise in between."""
    at, n = held.place(streamed.other), len(held.keys)
    size = np.where(at >= 0, held.begin[at + 1] - held.begin[at], 0)
    if int(size.sum()) * 64 < len(streamed.keys) * n:
        for _, _, pair, (x,) in products(held, streamed):
            b, a = np.divmod(pair, n)
            keep = (x > 0) & (np.round(x, TIE_DIGITS) >= floor[a])
            yield b[keep], a[keep], x[keep]
        return
    own = np.flatnonzero(size)
    code, begin, size, y = streamed.code[own], held.begin[at[own]], size[own], streamed.values[0][own]
    step = max(1, DENSE // n)
    edge = np.searchsorted(code, np.arange(0, len(streamed.keys) + step, step))
    sums, low = np.zeros(step * n), np.empty(n)
    for j, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        if lo == hi:
            continue
        where, many = spans(begin[lo:hi], begin[lo:hi] + size[lo:hi]), size[lo:hi]
        a = held.code[where]
        place = np.repeat((code[lo:hi] - j * step) * n, many) + a
        np.add.at(sums, place, np.repeat(y[lo:hi], many) * held.values[0][where])
        np.maximum(floor - 10.0 ** -TIE_DIGITS, 5e-324, out=low)
        found = np.unique(place[sums[place] >= low[a]])
        x = sums[found]
        sums[place] = 0
        b, a = np.divmod(found, n)
        keep = np.round(x, TIE_DIGITS) >= floor[a]
        yield b[keep] + j * step, a[keep], x[keep]


def _unit_cells(R: DataFrame) -> DataFrame:
    """(item_id, user_id, x) with x = r / sqrt(column sum); null keys meet nothing."""
    q = R.groupBy(I).agg(F.sum(F.col(V).cast("double")).alias("_q"))
    return R.where(f"{U} IS NOT NULL AND {V} IS NOT NULL").join(q, I).select(I, U, (F.col(V) * inv_sqrt("_q")).alias("x"))


def _k_best(a, b, s, keys, k):
    """The k best of each a, in order, with their ranks: by value at 9 digits, then key."""
    place = pc.array_sort_indices(keys).to_numpy()
    order_of = np.empty(len(keys), np.int64)
    order_of[place] = np.arange(len(keys))
    order = np.lexsort((order_of[b], -np.round(s, TIE_DIGITS), a))
    a, b, s = a[order], b[order], s[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    keep = rank < k
    return a[keep], b[keep], s[keep], rank[keep] + 1


def _cut_to(state: list, k: int) -> np.ndarray:
    """Leaves the k best of every held key in ``state`` (held, floors, waiting rows, their
    number) and raises the floors; their ranks."""
    _, floor, waiting, _ = state
    a, s = (np.concatenate([w[j] for w in waiting]) for j in (0, 2))
    coded = pa.concat_arrays([w[1] for w in waiting]).dictionary_encode()
    a, b, s, rank = _k_best(a, coded.indices.to_numpy(), s, coded.dictionary, k)
    last = rank == k
    floor[a[last]] = np.round(s[last], TIE_DIGITS)
    state[2], state[3] = [(a, coded.dictionary.take(pa.array(b)), s)], 0
    return rank


def nearest(R: DataFrame, k: int, cells: int) -> DataFrame:
    """(item_i, rank, item_j, sim): the k items most similar to each by S_I; by score at 9
    digits, then item. R has positive values in ``cells`` unique cells."""
    table = pieces(_unit_cells(R), I, part_count(R.sparkSession, cells))
    kind = dict(R.dtypes)[I]

    def run(batches):
        pool: dict[int, list] = {}
        for batch in batches:
            for no, m, ms in zip(*batch.columns, strict=True):
                if no.as_py() not in pool:
                    held = _cells_of(m, Held)
                    pool[no.as_py()] = [held, np.full(len(held.keys), -np.inf), [], 0]
                state = pool[no.as_py()]
                held, floor = state[:2]
                streamed, n = _cells_of(ms, Streamed), len(held.keys)
                own = pc.fill_null(pc.index_in(streamed.keys, held.keys), -1).to_numpy(zero_copy_only=False)
                for _, _, pair, (s,) in products(held, streamed):
                    b, a = np.divmod(pair, n)
                    keep = (own[b] != a) & (np.round(s, TIE_DIGITS) >= floor[a]) & (s != 0)
                    state[2].append((a[keep], streamed.keys.take(pa.array(b[keep])), s[keep]))
                    state[3] += int(keep.sum())
                    if state[3] > WAITING:
                        _cut_to(state, k)
        for state in pool.values():
            if state[2]:
                rank = _cut_to(state, k)
                a, b, s = state[2][0]
                yield pa.RecordBatch.from_arrays([state[0].keys.take(pa.array(a)), pa.array(rank, pa.int32()), b, pa.array(s)],
                                                 names=["item_i", "rank", "item_j", "sim"])

    return met(table, table, run, f"item_i {kind}, rank int, item_j {kind}, sim double")


def similar(R: DataFrame, threshold: float, cells: int) -> DataFrame:
    """(item_i, item_j, sim) of the pairs i <> j, both ways, with S_I at or above a threshold > 0."""
    table = pieces(_unit_cells(R), I, part_count(R.sparkSession, cells))
    kind = dict(R.dtypes)[I]

    def run(batches):
        last, held = None, None
        for batch in batches:
            for no, m, ms in zip(*batch.columns, strict=True):
                if no.as_py() != last:
                    last, held = no.as_py(), _cells_of(m, Held)
                streamed = _cells_of(ms, Streamed)
                own = pc.fill_null(pc.index_in(streamed.keys, held.keys), -1).to_numpy(zero_copy_only=False)
                for _, _, pair, (s,) in products(held, streamed):
                    found = s >= threshold
                    b, a = np.divmod(pair[found], len(held.keys))
                    s, other = s[found], own[b] != a
                    if other.any():
                        yield pa.RecordBatch.from_arrays([held.keys.take(pa.array(a[other])), streamed.keys.take(pa.array(b[other])),
                                                          pa.array(s[other])], names=["item_i", "item_j", "sim"])

    return met(table, table, run, f"item_i {kind}, item_j {kind}, sim double")


def _scaled(R: DataFrame, models: list[str]) -> DataFrame:
    """(user_id, item_id, rho and y of every model)."""
    value, out = F.col(V).cast("double"), []
    # sums over all rows, those without the other key too
    q, p = R.groupBy(I).agg(F.sum(value).alias("_q")), R.groupBy(U).agg(F.sum(value).alias("_p"))
    if "item" in models:
        R = R.join(q, I).withColumn("_g", inv_sqrt("_q"))
    if "user" in models:
        R = R.join(p, U).withColumn("_d", inv_sqrt("_p"))
    for m in models:
        out += [(value * (F.sqrt("_g") if m == "item" else F.col("_d"))).alias(f"rho_{m}"),
                (value * F.col("_g") if m == "item" else value).alias(f"y_{m}")]
    return R.where(f"{U} IS NOT NULL AND {I} IS NOT NULL AND {V} IS NOT NULL").select(U, I, *out)


def top_k_scores(R: DataFrame, k: int, model: str, cells: int, products_by_item: float) -> DataFrame:
    """(user_id, rank, item_id, score): every user's k best items, by score at 9 digits, then
    item. A task holds users. All users' cells stream past them and give their weights, then
    all items' cells, which meet the weights: an item's scores for the held users are
    complete at once, and k a user stay. R has positive values in ``cells`` unique cells;
    ``products_by_item``, Σ_i deg(i)², bounds the number of weights."""
    spark, kinds = R.sparkSession, dict(R.dtypes)
    scaled = written(_scaled(R, [model]), "scaled")
    by_user = scaled.select(U, I, f"rho_{model}")
    parts = part_count(spark, cells)
    held = pieces(by_user, U, max(parts, math.ceil(products_by_item / WEIGHTS)))
    users = pieces(by_user, U, parts)
    items = pieces(scaled.select(I, U, f"y_{model}"), I, parts)
    expected = users.count()

    def weigh(state, s):
        """Adds the held users' weights with the users of a streamed piece."""
        held, before = state["held"], state["seen"]
        for _, _, pair, (w,) in products(held, s):
            v, u = np.divmod(pair, len(held.keys))
            state["weights"].append((u.astype(np.int32), (v + before).astype(np.int32), w))
        state["users"].append(s.keys)
        state["seen"] += len(s.keys)

    def turned(state):
        """Weights by streamed user in place of the held users' cells."""
        u, v, w = (np.concatenate([x[j] for x in state["weights"]]) for j in range(3))
        state["weights"] = None
        keys = state["held"].keys
        state["best"] = [Held.coded(keys, u, pa.concat_arrays(state["users"]), v, w), np.full(len(keys), -np.inf), [], 0]

    def choose(best, s):
        """Takes the scores of a streamed piece's items."""
        for b, a, x in sums_from(best[0], s, best[1]):
            best[2].append((a, s.keys.take(pa.array(b)), x))
            best[3] += len(a)
            if best[3] > WAITING:
                _cut_to(best, k)

    def run(batches):
        pool: dict[int, dict] = {}
        for batch in batches:
            for no, m, ms in zip(*batch.columns, strict=True):
                if no.as_py() not in pool:
                    pool[no.as_py()] = {"held": _cells_of(m, Held), "weights": [], "users": [], "seen": 0, "early": [], "best": None}
                state = pool[no.as_py()]
                kind = _unpacked(ms).column_names[0]
                if kind == U:
                    weigh(state, _cells_of(ms, Streamed))
                    if len(state["users"]) == expected:
                        turned(state)
                        for early in state.pop("early"):
                            choose(state["best"], _cells_of(early, Streamed))
                elif state["best"] is None:  # the users' pieces come first; where they don't, these wait
                    state["early"].append(ms)
                else:
                    choose(state["best"], _cells_of(ms, Streamed))
        for state in pool.values():
            best = state["best"]
            if best[2]:
                rank = _cut_to(best, k)
                a, b, s = best[2][0]
                yield pa.RecordBatch.from_arrays([best[0].keys.take(pa.array(a)), pa.array(rank, pa.int32()), b, pa.array(s)],
                                                 names=[U, "rank", I, "score"])

    return met(held, users.unionByName(items), run, f"{U} {kinds[U]}, rank int, {I} {kinds[I]}, score double")


def score_rows(R: DataFrame, rows: DataFrame, weights: dict[str, float], cells: int) -> DataFrame:
    """``rows`` with ``pred``, the sum of the models' scores by weight, 0 where R has no
    path. A task holds users with their rows, and all users' cells stream past them. R has
    positive values in ``cells`` unique cells."""
    spark = R.sparkSession
    total = {m: x for m, x in weights.items() if x} or {"item": 0.0}
    models = list(total)
    scaled = _scaled(R, models)
    streamed = pieces(scaled, U, part_count(spark, cells, PASSING_CELLS))
    if streamed.isEmpty():  # no cell has both keys
        return rows.withColumn("pred", F.lit(0.0))
    names, kinds = rows.columns, dict(rows.dtypes)
    fields = [f"_c{j}" for j in range(len(names))]
    rho = [f"rho_{m}" for m in models]
    own = scaled.select(F.lit(0).alias("_kind"), *[F.col(r) for r in rho], *[
        F.col(c).alias(f) if c in (U, I) else F.lit(None).cast(kinds[c]).alias(f) for c, f in zip(names, fields, strict=True)])
    wanted = rows.select(F.lit(1).alias("_kind"), *[F.lit(0.0).alias(r) for r in rho],
                         *[F.col(f"`{c}`").alias(f) for c, f in zip(names, fields, strict=True)])
    user, item = fields[names.index(U)], fields[names.index(I)]
    both = own.unionByName(wanted)
    kinds = dict(both.dtypes)
    # a task holds cells and rows, so both count
    held = pieces(both, user, part_count(spark, cells + rows.count(), HELD_ROWS))
    every = spark.sparkContext.broadcast(list(total.values()))
    step = len(models)

    def prepared(m):
        t = _unpacked(m)
        kind = t["_kind"].combine_chunks().to_numpy()
        mine = t.select([user, item, *rho]).filter(pa.array(kind == 0)).combine_chunks()
        asked = t.select(fields).filter(pa.array(kind == 1))
        del t
        users = Held(mine[user].combine_chunks(), mine[item].combine_chunks(), [mine[r].combine_chunks().to_numpy() for r in rho])
        # asked rows by item; rows of a user or an item that R hasn't stay at 0
        place = pc.fill_null(pc.index_in(asked[user].combine_chunks(), users.keys), -1).to_numpy(zero_copy_only=False)
        live = np.flatnonzero((place >= 0) & pc.is_valid(asked[item].combine_chunks()).to_numpy(zero_copy_only=False))
        by_item = Held(pa.array(live), asked[item].combine_chunks().take(pa.array(live)), [place[live]])
        # Held codes its keys as they come, so code j is row live[j]; every item of the two and its places in both
        items = pa.concat_arrays([users.others, by_item.others]).unique()
        places = [np.append(h.place(items), -1) for h in (users, by_item)]
        asked = _packed(asked) if asked.num_rows else None
        return users, by_item, live, asked, np.zeros(len(live)), items, places

    def run(batches):
        pool: dict[int, tuple] = {}
        for batch in batches:
            for no, m, ms in zip(*batch.columns, strict=True):
                if no.as_py() not in pool:
                    pool[no.as_py()] = prepared(m)
                    trimmed()
                users, by_item, live, _, got, items, places = pool[no.as_py()]
                if not len(live):
                    continue
                s = _cells_of(ms, Streamed)
                ys = s.values[1::2]
                s.values = s.values[0::2]
                known = pc.fill_null(pc.index_in(s.other, items), -1).to_numpy(zero_copy_only=False)
                own, at = (p[known] for p in places)
                n = len(users.keys)
                size = np.where(at >= 0, by_item.begin[at + 1] - by_item.begin[at], 0)
                for begin, end, pair, sums in products(users, s, own):
                    cell = np.flatnonzero(size[begin:end]) + begin
                    for a, b in _cuts(np.arange(len(cell)), size[cell]):
                        c = cell[a:b]
                        where = spans(by_item.begin[at[c]], by_item.begin[at[c] + 1])
                        many = size[c]
                        key = np.repeat(s.code[c] * n, many) + by_item.values[0][where]
                        spot = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
                        hit = np.flatnonzero(pair[spot] == key)
                        row, spot = by_item.code[where[hit]], spot[hit]
                        gain = sum(x * w[spot] * np.repeat(y[c], many)[hit] for x, w, y in zip(every.value, sums, ys, strict=True))
                        np.add.at(got, row, gain)
                del s, ys
                trimmed()
        for _, _, live, asked, got, *_ in pool.values():
            if asked is not None:
                asked = pa.ipc.open_stream(asked).read_all()
                pred = np.zeros(asked.num_rows)
                pred[live] = got
                yield from asked.append_column("pred", pa.array(pred)).combine_chunks().to_batches()

    schema = ", ".join([*[f"{f} {kinds[f]}" for f in fields], "pred double"])
    done = met(held, streamed, run, schema)
    return done.select(*[F.col(f).alias(c) for c, f in zip(names, fields, strict=True)], "pred")
