"""Singular vectors by a block Krylov space with thick restarts (M8).

The space of C = RᵀR over the smaller side of R is spanned block by block: C times the
newest block is made orthogonal to the whole kept basis twice, and what is left is the
next block. Rayleigh-Ritz over all of the basis gives values and vectors, and the last
block alone gives each pair's residual. A full basis is replaced by its best Ritz
vectors and goes on from there, so nothing found is thrown away.

The basis lives in one of three places. While it is small by count (keys of the smaller
side times columns, at most ``LOCAL_VALUES``) it is a matrix on the driver, and C times a
block is one pass over R's rows with the block broadcast: partial sums by task, added
up in slots. While a few columns are that small, it is the same matrix in a temporary file
of the driver, narrower and worked on in slabs of rows, and a block is broadcast as many
columns at a time as ``PASS_VALUES`` allows. Beyond that it is a table of blocks of keys, and
products, inner products and orthogonalisation are cogroups of such blocks; only matrices
of basis width reach the driver."""

from __future__ import annotations

import gc
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.operators.ordering import with_row_number
from cofilter.session import bounded_batches, checkpoint_dir, scratch_path, ship_package, written

COLUMNS = 32              # of a block of the Krylov space
BASIS = 640               # columns of the basis, more where many values are asked for
LOCAL_VALUES = 1 << 25    # doubles of a basis on the driver: 256 MiB
FILE_COLUMNS = 16         # of a block where the basis is in a file
FILE_VALUES = 3 << 25     # doubles of a basis in a file of the driver: 768 MiB, more where k asks for it
PASS_VALUES = 1 << 22     # doubles of the columns that one pass over R takes: 32 MiB
SLAB_VALUES = 1 << 20     # doubles of a slab of rows: 8 MiB
BLOCK_VALUES = 1 << 21    # doubles of a block of a basis on the executors: 16 MiB
CHUNK_CELLS = 1 << 20     # cells of R in a chunk of rows
SLAB_CELLS = 8192         # cells whose rows are added up at once
SLOTS = 8                 # partial sums are added up in so many parts
ROUNDING = 1e-13          # residuals below this share of the first squared value are rounding errors


def kept(df: DataFrame) -> DataFrame:
    return written(df, "svd")


def array(blob, width: int) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), np.float64).reshape(-1, width)


def block_table(blk, keys: pa.Array, m: np.ndarray) -> pa.Table:
    lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
    return pa.table({"blk": pa.array([blk], pa.int32()), "keys": lists,
                     "m": pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())})


def block_schema(key: str) -> str:
    return f"blk int, keys array<{key}>, m binary"


def added(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of the vectors (slot, m), slot by slot on the executors."""

    def total(group: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(m.as_buffer()) for m in group["m"])
        return pa.table({"slot": pa.array([group["slot"][0].as_py()], pa.int32()), "m": pa.array([out.tobytes()], pa.binary())})

    rows = parts.groupBy("slot").applyInArrow(total, "slot int, m binary")  # ``size`` doubles in all
    out, cut = np.zeros(size), np.linspace(0, size, SLOTS + 1).astype(int)
    rows = rows.collect()
    while rows:
        r = rows.pop()
        out[cut[r["slot"]]: cut[r["slot"] + 1]] = np.frombuffer(r["m"])
    return out


def in_slots(v: np.ndarray):
    cut = np.linspace(0, v.size, SLOTS + 1).astype(int)
    flat = v.ravel()
    for j, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([flat[a:b].tobytes()], pa.binary())], names=["slot", "m"])


def triangle(blocks: DataFrame, width: int) -> np.ndarray:
    """The triangular factor of all blocks' rows by a tree of QR factorisations."""

    def local(batches):
        for batch in batches:
            for blk, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                r = np.linalg.qr(array(m, width), mode="r")
                yield pa.RecordBatch.from_arrays([pa.array([blk % 16], pa.int32()), pa.array([r.tobytes()], pa.binary())],
                                                 names=["slot", "m"])

    def merged(group: pa.Table) -> pa.Table:
        r = np.zeros((0, width))
        for m in group["m"]:
            r = np.linalg.qr(np.concatenate((r, array(m, width))), mode="r")
        return pa.table({"m": pa.array([r.tobytes()], pa.binary())})

    ship_package(blocks.sparkSession)
    rows = (blocks.select("blk", "m").mapInArrow(local, "slot int, m binary").groupBy("slot")
            .applyInArrow(merged, "m binary").collect())  # 16 matrices at most
    parts = [np.frombuffer(bytes(r["m"]), np.float64).reshape(-1, width) for r in rows]
    return np.linalg.qr(np.concatenate(parts), mode="r") if parts else np.zeros((0, width))


def turned(blocks: DataFrame, width: int, t: np.ndarray) -> DataFrame:
    """Every block times a small matrix."""

    def run(batches):
        for batch in batches:
            out = [np.ascontiguousarray(array(m, width) @ t).tobytes() for m in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())],
                                             names=["blk", "keys", "m"])

    ship_package(blocks.sparkSession)
    return blocks.mapInArrow(run, blocks.schema)


def _factors(r: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(t, f) of a triangular factor: its matrix times t has orthonormal columns, or columns
    of nothing where a direction is below ``scale``, and those times f give it back."""
    width = r.shape[1]
    _, s, v = np.linalg.svd(r)
    s = np.concatenate((s, np.zeros(width - len(s))))
    live = s > max(scale, 1e-300)
    return np.where(live, v.T / np.where(live, s, 1), 0), np.where(live, s, 0)[:, None] * v


def swept(spark) -> None:
    """Has the driver let go of what no query needs any more; Spark then deletes the files
    of those shuffles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Local:
    """The basis as a matrix on the driver, in memory or in a file; R in chunks of rows on
    the executors."""

    def __init__(self, R: DataFrame, side: str, other: str, value: str, cells: int, seed: int, filed: bool = False):
        self.spark, self.side, self.other, self.filed = R.sparkSession, side, other, filed
        ship_package(self.spark)
        self.keys = R.select(side).distinct().orderBy(side).toArrow()[side].combine_chunks()  # at most LOCAL_VALUES / basis
        self.n = len(self.keys)
        self.rng = np.random.default_rng(seed)
        keys, kind = self.spark.sparkContext.broadcast(self.keys), dict(R.dtypes)[other]
        parts = max(self.spark.sparkContext.defaultParallelism, -(-cells // CHUNK_CELLS))

        def chunk(batches):
            group = list(batches)
            if not group:
                return
            group = pa.Table.from_batches(group).sort_by(other)
            coded = group[other].combine_chunks().dictionary_encode()
            row = coded.indices.to_numpy(zero_copy_only=False)
            at = pc.index_in(group[side].combine_chunks(), keys.value).to_numpy(zero_copy_only=False).astype(np.int32)
            size = np.bincount(row, minlength=len(coded.dictionary)).astype(np.int32)

            def one(v):
                return pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)

            from pyspark import TaskContext
            blk = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [blk, one(coded.dictionary), one(pa.array(size)), one(pa.array(at)), one(group["value"].combine_chunks())],
                names=["blk", "keys", "size", "at", "value"])

        bounded_batches(self.spark)
        checkpoint_dir(self.spark)
        rows = R.select(side, other, F.col(value).cast("double").alias("value")).repartition(parts, other)
        # a chunk is a partition of its own, so that tasks get as many each
        self.chunks = rows.mapInArrow(chunk, f"blk int, keys array<{kind}>, size array<int>, at array<int>, value array<double>")
        self.chunks = self.chunks.checkpoint(eager=True)
        keys.destroy()
        if filed:
            swept(self.spark)
        self.m, self.basis = 0, None

    def _image(self, q: np.ndarray, finish, schema: str):
        """finish(rows of a chunk times q, chunk) for every chunk of R, and what is broadcast for it."""
        shared = self.spark.sparkContext.broadcast(q)

        def run(batches):
            yield from finish(_chunk_products(batches, shared.value))

        return self.chunks.coalesce(self.spark.sparkContext.defaultParallelism).mapInArrow(run, schema), shared

    def apply(self, q: np.ndarray) -> np.ndarray:
        """RᵀR q in one pass, or some columns of it at a time."""
        passes = -(-q.shape[1] // max(1, PASS_VALUES // max(1, len(q))))
        if passes <= 1:
            return self._apply(np.ascontiguousarray(q))
        out, step = np.empty(q.shape), -(-q.shape[1] // passes)
        for a in range(0, q.shape[1], step):
            out[:, a: a + step] = self._apply(np.ascontiguousarray(q[:, a: a + step]))
        return out

    def _apply(self, q: np.ndarray) -> np.ndarray:
        shape = q.shape

        def back(products):
            out = np.zeros(shape)
            for _, _, y, row, at, value in products:
                # sorting numbers takes a tenth of the time of sorting places
                order = np.sort((at.astype(np.int64) << 32) | np.arange(len(at))) & 0xFFFFFFFF
                for i in range(0, len(order), SLAB_CELLS):
                    some = order[i: i + SLAB_CELLS]
                    a, part = at[some], np.take(y, row[some], axis=0)
                    part *= value[some, None]
                    begin = np.flatnonzero(np.diff(a, prepend=-1))
                    if len(begin) < len(a):
                        a, part = a[begin], np.add.reduceat(part, begin, axis=0)
                    part += np.take(out, a, axis=0)
                    out[a] = part
            yield from in_slots(out)

        parts, shared = self._image(q, back, "slot int, m binary")
        out = added(parts, q.size).reshape(shape)
        shared.destroy()
        del parts
        if self.filed:
            swept(self.spark)
        return out

    def _slabs(self):
        step = max(1, SLAB_VALUES // max(1, self.basis.shape[1]))
        return [slice(a, a + step) for a in range(0, self.n, step)]

    def _room(self, columns: int) -> np.ndarray:
        if not self.filed:
            return np.empty((self.n, columns))
        with tempfile.TemporaryFile() as file:  # gone with its last mapping
            return np.asarray(np.memmap(file, np.float64, "w+", shape=(self.n, columns)))

    def start(self, width: int, room: int) -> None:
        self.basis = self._room(room)
        self.m, self.width, self.rest = 0, width, self.rng.normal(size=(self.n, width))
        self.next(0.0)
        self.append()

    def _clear(self, w: np.ndarray) -> np.ndarray:
        total = 0
        for _ in range(2):
            g = sum(self.basis[s, : self.m].T @ w[s] for s in self._slabs())
            for s in self._slabs():
                w[s] -= self.basis[s, : self.m] @ g
            total = total + g
        self.rest = w
        return total

    def project(self) -> np.ndarray:
        self.rest = None
        return self._clear(self.apply(self.basis[:, self.m - self.width: self.m]))

    def fresh(self) -> None:
        self._clear(self.rng.normal(size=(self.n, self.width)))

    def next(self, scale: float) -> np.ndarray:
        factor = np.eye(self.width)
        for floor in (scale, 0.5):
            r = np.zeros((0, self.width))
            for s in self._slabs():
                r = np.linalg.qr(np.concatenate((r, self.rest[s])), mode="r")
            t, f = _factors(r, floor)
            for s in self._slabs():
                self.rest[s] = self.rest[s] @ t
            factor = f @ factor
        return factor

    def restart(self, y: np.ndarray) -> None:
        for s in self._slabs():
            self.basis[s, : y.shape[1]] = self.basis[s, : len(y)] @ y
        self.m = y.shape[1]

    def append(self) -> None:
        self.basis[:, self.m: self.m + self.width] = self.rest
        self.m += self.width

    def identity(self) -> None:
        self.basis, self.m = np.eye(self.n), self.n

    def finish(self, y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, object, object]:
        """Singular values and turn of the chosen vectors, from R times them, and
        functions that give both sides' blocks turned."""
        if y is None:
            q = self.basis[:, : self.m]
        else:
            q = self._room(y.shape[1])
            for s in self._slabs():
                q[s] = self.basis[s, : self.m] @ y
        self.basis = self.rest = None
        k = q.shape[1]

        def factor(products):
            r = np.zeros((0, k))
            for _, _, y, *_ in products:
                r = np.linalg.qr(np.concatenate((r, y)), mode="r")
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["blk", "m"])

        images, shared = self._image(q, factor, "blk int, m binary")
        values, turn = _values(triangle(images, k), k)
        shared.destroy()

        def vectors(t: np.ndarray) -> DataFrame:
            rows = max(1, BLOCK_VALUES // max(1, k))
            tables = (block_table(b, self.keys[a: a + rows], q[a: a + rows] @ t) for b, a in enumerate(range(0, self.n, rows)))
            if not self.filed:
                return self.spark.createDataFrame(pa.concat_tables(list(tables)))
            path = scratch_path(self.spark, "svd")
            for table in tables:  # a block at a time passes through the driver's JVM
                part = self.spark.createDataFrame(table)
                part.write.mode("append").parquet(path)
            return self.spark.read.schema(part.schema).parquet(path)

        def image(t: np.ndarray) -> DataFrame:
            def blocks(products):
                for blk, keys, y, *_ in products:
                    yield block_table(blk, keys, y).to_batches()[0]

            kind = self.chunks.schema["keys"].dataType.elementType.simpleString()
            return self._image(np.ascontiguousarray(q @ t), blocks, block_schema(kind))[0]

        return values, turn, vectors, image


def _chunk_products(batches, q: np.ndarray):
    """(chunk, keys, rows times q, row of every cell, its place in q, its value) by chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys, size, at, value = (batch.column(c)[i].values for c in range(1, 5))
            size, at, value = (x.to_numpy() for x in (size, at, value))
            row = np.repeat(np.arange(len(size), dtype=np.int32), size)
            y = np.zeros((len(size), q.shape[1]))
            for a in range(0, len(at), SLAB_CELLS):
                r = row[a: a + SLAB_CELLS]
                begin = np.flatnonzero(np.diff(r, prepend=-1))
                part = np.take(q, at[a: a + SLAB_CELLS], axis=0)
                part *= value[a: a + SLAB_CELLS, None]
                y[r[begin]] += np.add.reduceat(part, begin, axis=0)
            yield batch.column(0)[i].as_py(), keys, y, row, at, value


def _values(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    _, s, v = np.linalg.svd(r)
    return np.concatenate((s, np.zeros(k - len(s)))), v.T


def _numbered(keys: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct keys and the place of each key among them."""
    coded = keys.combine_chunks().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def multiply(cells: DataFrame, q: DataFrame, width: int, key: str, other: str, n_key: int) -> DataFrame:
    """Blocks of (R or Rᵀ) Q, keys in order, not written yet: for each ``key`` the sum over
    its cells of value times the ``other`` side's row. ``cells`` has kb and ob, the blocks
    of both sides."""
    kind = dict(cells.dtypes)[key]

    def partial(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return block_table(0, pa.array([], left.schema.field(key).type), np.zeros((0, width))).slice(0, 0)
        at = pc.index_in(left[other].combine_chunks(), right["keys"][0].values).to_numpy(zero_copy_only=False)
        keys, row = _numbered(left[key])
        value, rows = left["value"].to_numpy(), array(right["m"][0], width)
        out = np.zeros((len(keys), width))
        order = np.argsort(row, kind="stable")
        for i in range(0, len(order), 8192):
            part = order[i: i + 8192]
            begin = np.flatnonzero(np.diff(row[part], prepend=-1))
            out[row[part][begin]] += np.add.reduceat(value[part, None] * rows[at[part]], begin, axis=0)
        return block_table(left["kb"][0].as_py(), keys, out)

    def total(group: pa.Table) -> pa.Table:
        keys, place = _numbered(pa.chunked_array([pa.concat_arrays([k.values for k in group["keys"]])]))
        out = np.zeros((len(keys), width))
        at = 0
        for m in group["m"]:
            m = array(m, width)
            out[place[at: at + len(m)]] += m  # keys are distinct within a part
            at += len(m)
        order = pc.sort_indices(keys)
        return block_table(group["blk"][0].as_py(), keys.take(order), out[order.to_numpy()])

    every = q.select(F.col("blk").alias("ob"), "keys", "m").withColumn(
        "kb", F.explode(F.sequence(F.lit(0), F.lit(n_key - 1))))
    parts = (cells.groupBy("kb", "ob").cogroup(every.groupBy("kb", "ob")).applyInArrow(partial, block_schema(kind)))
    return parts.groupBy("blk").applyInArrow(total, block_schema(kind))


class Blocks:
    """The basis as stored blocks of keys, each Krylov block a table of its own."""

    def __init__(self, R: DataFrame, side: str, other: str, value: str, n_side: int, n_other: int, room: int, seed: int):
        self.spark, self.side, self.other, self.n, self.seed = R.sparkSession, side, other, n_side, seed
        ship_package(self.spark)
        self.blocks, self.other_blocks = (max(1, -(-n * room // BLOCK_VALUES)) for n in (n_side, n_other))

        def block(c, number):
            return F.pmod(F.xxhash64(c), F.lit(number)).cast("int")

        cells = R.select(side, other, F.col(value).cast("double").alias("value"))
        self.down = kept(cells.withColumn("kb", block(other, self.other_blocks)).withColumn("ob", block(side, self.blocks)))
        self.up = self.down.select(side, other, "value", F.col("ob").alias("kb"), F.col("kb").alias("ob"))
        self.pieces: list[tuple[DataFrame, int]] = []

    @property
    def m(self) -> int:
        return sum(w for _, w in self.pieces)

    def _rows(self, fill) -> DataFrame:
        """Blocks over all keys in order, filled by fill(keys of a block, their table)."""
        keys, kind = self.up.select(F.col("kb").alias("blk"), self.side).distinct(), dict(self.up.dtypes)[self.side]
        side = self.side

        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by(side)
            return block_table(group["blk"][0].as_py(), group[side].combine_chunks(), fill(group))

        return keys, lambda keys: kept(keys.groupBy("blk").applyInArrow(run, block_schema(kind)))

    def _random(self, width: int) -> DataFrame:
        self.seed += 1
        seed = self.seed
        keys, build = self._rows(lambda g: np.random.default_rng((seed, g["blk"][0].as_py())).normal(size=(g.num_rows, width)))
        return build(keys)

    def _image(self, q: DataFrame, width: int) -> DataFrame:
        return multiply(self.down, q, width, self.other, self.side, self.other_blocks)

    def _beside(self, z: DataFrame, run, schema: str) -> DataFrame:
        """run(blk, keys, basis rows, rows of z) for every block of keys."""
        widths = [w for _, w in self.pieces]
        tagged = z.select("blk", F.lit(-1).alias("j"), "keys", "m")
        for j, (piece, _) in enumerate(self.pieces):
            tagged = tagged.union(piece.select("blk", F.lit(j).alias("j"), F.lit(None).cast(z.schema["keys"].dataType).alias("keys"), "m"))
        width = self.width

        def both(group: pa.Table) -> pa.Table:
            group = group.sort_by("j")
            own = array(group["m"][0], width)
            basis = np.concatenate([array(m, w) for m, w in zip(group["m"].slice(1), widths, strict=True)], axis=1)
            return run(group["blk"][0].as_py(), group["keys"][0].values, basis, own)

        return tagged.groupBy("blk").applyInArrow(both, schema)

    def start(self, width: int, room: int) -> None:
        self.width = width
        self.rest = self._random(width)
        self.next(0.0)
        self.pieces = [(self.rest, width)]

    def _clear(self, w: DataFrame) -> np.ndarray:
        total = np.zeros((self.m, self.width))
        for _ in range(2):
            def inner(blk, keys, basis, own):
                return pa.Table.from_batches(in_slots(basis.T @ own))

            g = added(self._beside(w, inner, "slot int, m binary"), total.size).reshape(total.shape)
            w = kept(self._beside(w, lambda blk, keys, basis, own, g=g: block_table(blk, keys, own - basis @ g),
                                  block_schema(dict(self.up.dtypes)[self.side])))
            total += g
        self.rest = w
        return total

    def project(self) -> np.ndarray:
        q, width = self.pieces[-1]
        y = self._image(q, width)
        return self._clear(kept(multiply(self.up, y, width, self.side, self.other, self.blocks)))

    def fresh(self) -> None:
        self._clear(self._random(self.width))

    def next(self, scale: float) -> np.ndarray:
        factor = np.eye(self.width)
        for floor in (scale, 0.5):
            t, f = _factors(triangle(self.rest, self.width), floor)
            self.rest, factor = kept(turned(self.rest, self.width, t)), f @ factor
        return factor

    def restart(self, y: np.ndarray) -> None:
        self.pieces = [(self._combined(y), y.shape[1])]

    def _combined(self, y: np.ndarray) -> DataFrame:
        kind = dict(self.up.dtypes)[self.side]
        return kept(self._beside(self.rest, lambda blk, keys, basis, own: block_table(blk, keys, basis @ y), block_schema(kind)))

    def append(self) -> None:
        self.pieces.append((self.rest, self.width))

    def identity(self) -> None:
        n = self.n

        def fill(group: pa.Table) -> np.ndarray:
            out = np.zeros((group.num_rows, n))
            out[np.arange(group.num_rows), group["no"].to_numpy()] = 1
            return out

        keys, build = self._rows(fill)
        self.pieces, self.width = [(build(with_row_number(keys, [self.side], "no")[0]), n)], n

    def finish(self, y: np.ndarray | None):
        q, k = self.pieces[0] if y is None else (self._combined(y), y.shape[1])
        image = kept(self._image(q, k))
        values, turn = _values(triangle(image, k), k)
        return values, turn, lambda t: turned(q, k, t), lambda t: turned(image, k, t)


def ritz(space, k: int, width: int, room: int, steps: int, tolerance: float) -> np.ndarray:
    """The combination of the space's basis that gives the k first vectors. A squared
    value's residual is at most ``tolerance`` of it, or of the order of rounding errors
    in the first one; where ``steps`` don't lead there, a RuntimeError."""
    space.start(width, room)
    h = np.zeros((0, 0))
    for _ in range(steps):
        g = space.project()  # the basis against C times its newest block
        m = len(g)
        grown = np.zeros((m, m))
        grown[: len(h), : len(h)] = h
        grown[:, m - width:], grown[m - width:, :] = g, g.T
        grown[m - width:, m - width:] = (g[m - width:] + g[m - width:].T) / 2
        h = grown
        value, y = np.linalg.eigh(h)
        value, y = np.maximum(value[::-1], 0), y[:, ::-1]
        left = space.next(ROUNDING * value[0])
        error = np.linalg.norm(left @ y[m - width:, :k], axis=0)
        bound = np.maximum(tolerance * value[:k], ROUNDING * value[0])
        if m >= k and np.all(error <= bound):
            return y[:, :k]
        if not left.any():  # the space is closed but too small: go on from another start
            space.fresh()
            space.next(0.0)
        if m + width > room:
            keep = max(k + width, room // 3)
            space.restart(y[:, :keep])
            h = np.diag(value[:keep])
        space.append()
    raise RuntimeError(f"SVD not converged in {steps} steps: residuals up to {np.max(error / bound) * tolerance:.1e} of a squared value")
