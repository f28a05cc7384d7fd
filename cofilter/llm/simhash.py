"""SimHash near duplicates by the general pigeonhole principle.

A text's fingerprint takes each bit that is set in over half of its shingles' XXH64
values. Links join fingerprints that differ in ``bits`` bits at most. Equal
fingerprints are one node, so copies cost nothing; the nodes are joined as follows.

1. Statistics over all nodes: how often two bits are set together (64 x 64 sums), from
   which correlated bits are grouped into eight groups of eight; then the counts of
   each group's 256 values, which give the share of pairs that differ in d bits there.
2. The groups are merged into m partitions. If two fingerprints differ in ``bits`` bits
   at most, then for any thresholds t that sum to ``bits - m + 1`` some partition i
   differs in t[i] bits at most (t[i] = -1 leaves a partition out). For every m a
   dynamic program over the partitions chooses the thresholds with the least cost: rows
   posted and probed, plus candidates, estimated from the groups' distances. So few
   narrow keys serve a small table, and fewer, wider keys with probes a large one.
3. Nodes are posted under their partition's bits and, where the threshold is above 0,
   probe the keys that many flipped bits away (of two keys, the one in which the highest
   flipped bit is set probes). A key with over ``BLOCK`` rows is cut into blocks of rows
   that meet in cells, so no key is one task. Tasks stream through cells in order,
   verify all 64 bits, and return per cell only a forest of links.

Null and empty texts and texts without words have fingerprint zero and link like any
other. Rows with a null id are left out. Each other row gives one row; rows that share
an id are fingerprinted each. Other columns are ignored. An empty table gives no rows."""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.llm.common import components, mapped, slices, stored, text_bytes

SHINGLE = 3
BITS = 3
SEED = 42
PIECE = 1 << 20      # bytes of a text held as words at once
GROUP = 8            # bits of a group
BLOCK = 2048         # rows of a key that meet in one cell
SMALL = 32           # cells up to this size are compared many at once
ROW_COST = 100       # a posted row costs as much as so many candidates
HOT_ROWS = 100_000   # a table of split keys up to this size is broadcast
_SPACE = re.compile(rb"[\x09-\x0d ]")


def _pieces(text: bytes, size: int):
    """The text in stretches of about ``size`` bytes that end where a word ends."""
    at = 0
    while at < len(text):
        end = at + size
        found = _SPACE.search(text, end) if end < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    xxh = xxhash.xxh64_intdigest
    return np.fromiter((xxh(joined[i:j], seed) for i, j in zip(begins[: len(words) - width + 1].tolist(),
                                                             ends[width - 1:].tolist(), strict=True)),
                       np.uint64, len(words) - width + 1)


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED, piece: int = PIECE) -> int:
    """The 64 bits, as an unsigned number."""
    words: list[bytes] = []
    total, ones = 0, np.zeros(64, np.int64)
    for part in _pieces(text, piece):
        words += part.lower().split()
        if len(words) < width:
            continue
        h = _hashes(words, width, seed)
        for at in range(0, len(h), 1 << 15):
            raw = h[at: at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
        words = words[len(words) - width + 1:]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(words), seed) if words else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """(id, fp) of every row with an id; fp holds the 64 bits as a signed number."""

    def run(batches):
        for batch in slices(batches, "t"):
            fp = [fingerprint(t, width, seed) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))],
                                             names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id IS NOT NULL")
    return mapped(rows, run, "id long, fp long")


def bit_rows(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def extract(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of every fingerprint, as a number; bits[0] is its lowest."""
    out = np.zeros(len(fp), np.int64)
    for j, b in enumerate(bits):
        out |= ((fp >> np.int64(b)) & np.int64(1)) << np.int64(j)
    return out


def _summed(nodes: DataFrame, count, size: int) -> np.ndarray:
    """``count(fp)``, a vector of ``size`` whole numbers, summed over all nodes on the executors."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 1 << 14):
                total += count(fp[at: at + (1 << 14)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(size, np.int64)
    for r in mapped(nodes.select("fp"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def grouped_bits(together: np.ndarray, n: int) -> list[list[int]]:
    """Eight groups of eight bits from the counts of bits set together: each group starts
    at the free bit most correlated with the group before, and takes the free bit most
    correlated with its own, again and again."""
    p = np.diag(together) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / n - np.outer(p, p)) / np.outer(spread, spread))
    corr[np.outer(spread < 1e-5, np.ones(64, bool)) | np.outer(np.ones(64, bool), spread < 1e-5)] = 1.0  # constant bits go together
    np.fill_diagonal(corr, 0)
    free, groups = set(range(64)), []
    while free:
        seen = groups[-1] if groups else range(64)
        group = [max(sorted(free), key=lambda b: corr[b, seen].mean())]
        free.remove(group[0])
        while len(group) < GROUP:
            best = max(sorted(free), key=lambda b: corr[b, group].mean())
            group.append(best)
            free.remove(best)
        groups.append(group)
    return groups


def distance_shares(hist: np.ndarray) -> np.ndarray:
    """Share of ordered pairs of rows whose values of a group differ in 0, 1, .. bits."""
    h = hist / hist.sum()
    x = np.arange(len(h))
    far = np.bitwise_count(x[:, None] ^ x)
    return np.bincount(far.ravel(), weights=np.outer(h, h).ravel(), minlength=GROUP + 1)


@dataclass
class Plan:
    """Partitions (lists of bits) with their thresholds, and the estimated cost."""

    parts: list[list[int]]
    limits: list[int]
    cost: float


def _part_costs(shares: list[np.ndarray], width: int, bits: int, n: int) -> dict[int, float]:
    """Cost of a partition by its threshold, from its groups' distances taken as independent."""
    whole = np.ones(1)
    for s in shares:
        whole = np.convolve(whole, s)[: bits + 1]
    costs, probes = {-1: 0.0}, 0.0
    for t in range(bits + 1):
        probes += math.comb(width, t) / 2 if t else 0
        costs[t] = ROW_COST * n * (1 + probes) + n * n / 2 * whole[: t + 1].sum()
    return costs


def allocate(costs: list[dict[int, float]], bits: int) -> tuple[list[int], float]:
    """Thresholds of at least -1 that sum to ``bits - m + 1`` at the least cost: a dynamic
    program over the partitions and what is left of the sum."""
    best = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for (used, (c, ts)), t in itertools.product(best.items(), cost):
            at = used + t + 1
            if at <= bits + 1 and (at not in new or c + cost[t] < new[at][0]):
                new[at] = (c + cost[t], [*ts, t])
        best = new
    return best[bits + 1][1], best[bits + 1][0]


def plan(groups: list[list[int]], hists: np.ndarray, n: int, bits: int) -> Plan:
    """The cheapest partitioning of the groups into 2 to 8 partitions."""
    shares = [distance_shares(h) for h in hists]
    found = []
    for m in range(2, len(groups) + 1):
        runs = np.array_split(np.arange(len(groups)), m)
        parts = [[b for g in run for b in groups[g]] for run in runs]
        costs = [_part_costs([shares[g] for g in run], len(p), bits, n) for run, p in zip(runs, parts, strict=True)]
        limits, cost = allocate(costs, bits)
        found.append(Plan(parts, limits, cost))
    return min(found, key=lambda p: p.cost)


def _postings(nodes: DataFrame, chosen: Plan) -> DataFrame:
    """(part, key, side, fp): side 0 is posted, side 1 probes."""
    todo = [(i, bits, t) for i, (bits, t) in enumerate(zip(chosen.parts, chosen.limits, strict=True)) if t >= 0]

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for i, bits, t in todo:
                key = extract(fps, bits)
                flips = [0, *(sum(1 << b for b in c) for k in range(1, t + 1)
                              for c in itertools.combinations(range(len(bits)), k))]
                for mask in flips:
                    top = np.int64(1 << (mask.bit_length() - 1)) if mask else None
                    go = slice(None) if t == 0 else (key & top) != 0 if mask else slice(None)
                    for side in ([0] if t == 0 or not mask else [1]) + ([1] if t and not mask else []):
                        k = (key ^ np.int64(mask))[go]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(k), i, np.int32)), pa.array(k), pa.array(np.full(len(k), side, np.int32)),
                             pa.array(fps[go])], names=["part", "key", "side", "fp"])

    return mapped(nodes.select("fp"), run, "part int, key long, side int, fp long")


def _cells(posts: DataFrame, sided: list[int], block: int) -> DataFrame:
    """(cell, mark, fp): rows meet in a cell where one has mark 1 and one mark 2 (3:
    both). Keys with over ``block`` rows are cut into blocks that meet two by two."""
    count = posts.groupBy("part", "key").agg(F.sum(1 - F.col("side")).alias("n0"), F.sum("side").alias("n1"))
    hot = stored(count.where((F.col("n0") > block) | (F.col("n1") > block)).select(
        "part", "key", F.greatest(F.lit(1), F.ceil(F.col("n0") / block)).cast("int").alias("b0"),
        F.greatest(F.lit(1), F.ceil(F.col("n1") / block)).cast("int").alias("b1")), "hot")
    probing = F.col("part").isin(sided) if sided else F.lit(False)
    mark = F.when(~probing, 3).when(F.col("side") == 0, 1).otherwise(2)
    split = hot.count()
    if not split:
        return posts.select(F.xxhash64("part", "key").alias("cell"), mark.alias("mark"), "fp")
    both = posts.join(F.broadcast(hot) if split <= HOT_ROWS else hot, ["part", "key"], "left")
    cool = both.where("b0 IS NULL").select(F.xxhash64("part", "key", F.lit(0), F.lit(0)).alias("cell"), mark.alias("mark"), "fp")
    blocks = F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1"))
    others = F.when(probing, F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b0"))).otherwise(F.col("b0"))
    dealt = (both.where("b0 IS NOT NULL").withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), others - 1))))
    row = F.when(probing, F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))).otherwise(F.least("own", "other"))
    col = F.when(probing, F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))).otherwise(F.greatest("own", "other"))
    part = F.when(probing, mark).otherwise(F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2))
    return cool.union(dealt.select(F.xxhash64("part", "key", row, col).alias("cell"), part.alias("mark"), "fp"))


def _near(fp: np.ndarray, mark: np.ndarray, begins: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within ``bits`` of each other in cells that begin at ``begins``."""
    ends = np.append(begins[1:], len(fp))
    a, b = [], []
    for i, j in zip(begins[ends - begins > SMALL].tolist(), ends[ends - begins > SMALL].tolist(), strict=True):
        rows, cols = i + np.flatnonzero(mark[i:j] & 1), i + np.flatnonzero(mark[i:j] & 2)
        for at in range(0, len(rows), 256):
            r = rows[at: at + 256]
            x, y = np.nonzero(np.bitwise_count(fp[r, None] ^ fp[cols]) <= bits)
            a.append(r[x])
            b.append(cols[y])
    last = np.repeat(np.where(ends - begins > SMALL, begins, ends), ends - begins)
    here = np.arange(len(fp))
    for d in range(1, SMALL):
        i = here[: -d][here[: -d] + d < last[: -d]] if d < len(fp) else here[:0]
        if not len(i):
            break
        meet = ((mark[i] & 1) & (mark[i + d] >> 1)) | ((mark[i] >> 1) & (mark[i + d] & 1))
        i = i[(meet != 0) & (np.bitwise_count(fp[i] ^ fp[i + d]) <= bits)]
        a.append(i)
        b.append(i + d)
    return (np.concatenate(a), np.concatenate(b)) if a else (here[:0], here[:0])


def forest(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that pairs of rows connect to a smaller one, with the smallest."""
    nodes, place = np.unique(fp, return_inverse=True)
    a, b = place[a], place[b]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def links(nodes: DataFrame, chosen: Plan, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between fingerprints that connect all nodes within ``bits`` of each other."""
    sided = [i for i, t in enumerate(chosen.limits) if t > 0]

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = batch if held is None else pa.concat_batches([held, batch])
                if held.num_rows < 1 << 14:
                    continue
            if held is None or not held.num_rows:
                continue
            cell = held.column(0).to_numpy()
            begins = np.flatnonzero(np.diff(cell, prepend=~cell[:1]))
            done = len(cell) if batch is None else int(begins[-1])
            if not done:
                continue
            fp = held.column(2).to_numpy()[:done]
            a, b = _near(fp.view(np.uint64), held.column(1).to_numpy()[:done], begins[begins < done], bits)
            node, root = forest(fp, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])
            held = held.slice(done)

    cells = _cells(_postings(nodes, chosen), sided, block)
    return mapped(cells.repartition("cell").sortWithinPartitions("cell"), run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row with an id."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    n = nodes.count()
    named = nodes.select("fp", F.col("id").alias("component_id"))
    if n > 1:
        together = _summed(nodes, lambda fp: (lambda x: x.T @ x)(bit_rows(fp).astype(np.float32)).astype(np.int64).ravel(), 4096)
        groups = grouped_bits(together.reshape(64, 64), n)
        hists = _summed(nodes, lambda fp: np.concatenate([np.bincount(extract(fp, g), minlength=256) for g in groups]), 2048)
        chosen = plan(groups, hists.reshape(8, 256), n, bits)
        comps = components(links(nodes, chosen, bits, block)).withColumnRenamed("node", "fp")
        rooted = nodes.join(comps, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        named = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                           "component_id")
