"""Small helpers shared by the corpus operators: scratch tables in the shared
folder, Arrow plumbing, character and word arrays, connected components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofilter.session import bounded_batches, scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the
    lineage and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hand_back() -> None:
    """Give free memory of a Python worker back: workers stay between tasks, and what
    the allocators keep of one task's arrays counts against the next stage's, as do the
    powers kept for ``word_hashes``. Functions on groups call it when their arrays are gone."""
    _POW.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors, and rows sent there in
    batches of ``BATCH_BYTES`` (a session that sets a size of its own keeps it)."""
    ship_package(df.sparkSession)

    def tidy(batches):
        yield from run(batches)
        hand_back()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(tidy, schema)


def learn_split(doc_id: str, mod: int, held: int):
    """True where a row is held out: crc32(doc_id as text) mod ``mod`` = ``held``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == held, F.lit(False))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
WORD_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


POWER_STEP = 1 << 20  # powers are kept for whole steps of bytes
_POW = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of a byte array."""
    if len(data) + 1 > len(_POW["up"]):
        n = (len(data) // POWER_STEP + 1) * POWER_STEP + 1
        _POW["up"], _POW["down"] = powers(n, int(WORD_BASE)), powers(n, pow(int(WORD_BASE), -1, 1 << 64))
    space = _SPACES[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POW["up"][: len(data)], out=total[1:])
    return start, mix64((total[end] - total[start]) * _POW["down"][start]
                        + (end - start).astype(np.uint64))


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches, column: str, limit: int = 4 << 20):
    """Record batches cut so that ``column`` holds about ``limit`` bytes in each
    (one row at least): bounds what a task holds whatever the row sizes are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.nan_to_num(np.asarray(
            pc.binary_length(col).to_numpy(zero_copy_only=False), float)).astype(np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


HUB_ROWS = 512       # edges of a node before its join is split
MOST_HUBS = 50_000   # nodes split at once: their table is broadcast


def _with_lowest(edges: DataFrame, limit: int) -> DataFrame:
    """Directed edges (u, v) with m, the smallest v of each u. The edges of a node with
    over ``limit`` of them are dealt over several tasks, and its m is copied to each."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    shares = F.ceil(F.col("n") / limit).cast("int")
    hubs = F.broadcast(low.where(F.col("n") > limit).select("u", shares.alias("g")))  # MOST_HUBS rows at most
    dealt = edges.join(hubs, "u", "left").withColumn(
        "s", F.when(F.col("g").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), "g")).cast("int"))
    copied = low.select("u", "m", F.explode(F.sequence(F.lit(0), shares - 1)).alias("s"))
    return dealt.join(copied, ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list by alternating large-star
    and small-star steps; returns (node, root), root the smallest node reachable.

    Each step is a shuffle of the edges; after a few steps every component is a
    star around its smallest node, whose edges are dealt over several tasks.
    Nothing is collected but counts and whether that's so."""
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), "cc")
    for _ in range(rounds):
        limit = max(HUB_ROWS, -(-2 * e.count() // MOST_HUBS))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_lowest(both, limit).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _with_lowest(large, limit).select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = stored(small.select("x.u", "x.v").where("u <> v").distinct(), "cc")
        # stars: no node hangs on two others, and none on a node that hangs itself
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down")),
                                          F.struct(F.col("v").alias("x"), F.lit(0).alias("down")))).alias("x"))
        odd = ends.groupBy("x.x").agg(F.sum("x.down").alias("n"), F.min("x.down").alias("top"))
        if odd.where("n > 1 OR (n = 1 AND top = 0)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
