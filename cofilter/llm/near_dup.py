"""MinHash near duplicates through a signature-coordinate inverted join.

Every distinct shingle set gets ``coords`` MinHash values. A set is posted under
each (coordinate, value) pair; pairs nobody shares are skipped, and of the rest
only the rarest ``coords - matches + 1`` of a set's postings are kept (two sets
that agree on ``matches`` coordinates must share one of those). Lists are merged
in two steps: first every set is held against one leader of its lists; lists whose
members are all connected by then are skipped. In the others, if they have at most
``SHORT`` members, what is not connected becomes pairs with the rest; longer lists
are compared in blocks of documents, on the full sets. Pairs agree
on ``matches`` coordinates or more; links are confirmed on the full sets.

With 64 coordinates and 36 matches a pair at similarity 0.8 is missed with a
probability of about 3e-6, closer pairs less.

Null and empty texts have an empty set: no link, component their own id. Texts
shorter than a shingle are one shingle. Rows with a null id are left out.
Repeated ids: rows of one id count as one document with the largest set among
its rows. Other columns of the input are ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.llm.common import WORD_BASE, components, hand_back, list_array, mapped, mix64, slices, stored, text_bytes, word_hashes

SHINGLE = 5
COORDS = 64
MATCHES = 36
SHORT = 32
CELL_SHINGLES = 1_200_000
CELL_OVERHEAD = 600  # a document counts as so many shingles more, so a block has 2,000 at most
PERCENT = 80
#: width of a size class: sizes two classes apart differ by more than 1 / 0.8
CLASS = float(np.log(1.25))

def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text: ASCII letters lowered, words
    cut at ASCII white space, the whole sequence where it is shorter than a shingle."""
    data = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths + 1) - lengths - 1
    start, words = word_hashes(data)
    first = np.searchsorted(start, begins)
    last = np.searchsorted(start, begins + lengths)
    long = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        long = long * WORD_BASE + words[j: j + len(long)]
    long = mix64(long)
    out = []
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        if j - i >= width:
            out.append(np.unique(long[i: j - width + 1]))
        elif j > i:
            h = np.uint64(j - i)
            with np.errstate(over="ignore"):
                for w in words[i:j]:
                    h = h * WORD_BASE + w
            out.append(mix64(np.array([h], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _coefficients(coords: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * coords + 1, dtype=np.uint64) * WORD_BASE)
    return seeds[:coords] | np.uint64(1), seeds[coords:]


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 512):
        np.minimum(best, (hashes[i: i + 512, None] * a + b).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, coords: int) -> DataFrame:
    """(id, n, f1, f2, sig): set size, a 128-bit fingerprint of the set, the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(coords)
        for batch in slices(batches, "t"):
            sets = shingle_sets(text_bytes(batch.column(1)), width)
            sig = [signature(s, a, b) if len(s) else np.empty(0, np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                pa.array(np.array([mix64(s ^ WORD_BASE).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                list_array(np.concatenate(sig), np.array([len(s) for s in sig]), pa.int32()),
            ], names=["id", "n", "f1", "f2", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id IS NOT NULL")
    return mapped(rows, run, "id long, n long, f1 long, f2 long, sig array<int>")


def _postings(sets: DataFrame, coords: int, matches: int) -> DataFrame:
    """(key, id, n): the postings of each set that can still decide a pair."""
    posts = sets.select("id", "n", F.posexplode("sig").alias("c", "v")).select(
        F.expr("shiftleft(cast(c AS BIGINT), 32) + (cast(v AS BIGINT) & 4294967295)").alias("key"), "id", "n")
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # a set with s unshared postings has used up s of its prefix on them
    own = posts.join(shared, "key").groupBy("id", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "key"))).alias("p"))
    keep = F.expr(f"slice(p, 1, greatest(0, least(size(p), size(p) - {matches} + 1)))")
    return own.select("id", "n", F.explode(keep).alias("x")).select(F.col("x.key").alias("key"), "id", "n")


def _agreeing(pairs: DataFrame, sets: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b, ...) with their count of equal coordinates, at or above the threshold."""
    sig = sets.select("id", "sig")
    both = (pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b"))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return both.withColumn("same", same).where(F.col("same") >= matches).drop("sa", "sb")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    def compare(batches):
        for batch in slices(batches, "sb"):
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                inter = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    full = _full_sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), texts, width)
    both = (pairs.select("a", "b").join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
            .join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb"))
    return mapped(both, compare, "a long, b long")


def _with_roots(df: DataFrame, comps: DataFrame, node: str, out: str) -> DataFrame:
    c = comps.select(F.col("node").alias(node), F.col("root").alias("_r"))
    return df.join(c, node, "left").withColumn(out, F.coalesce("_r", node)).drop("_r")


def _leader_pairs(posts: DataFrame, sets: DataFrame, matches: int) -> DataFrame:
    """Every set with that leader of its lists that it agrees with best; a hash of
    list and member picks the leader of each size class of a list."""
    p = posts.withColumn("cls", F.floor(F.log(F.col("n")) / CLASS).cast("int"))
    lead = p.groupBy("key", "cls").agg(F.min(F.struct(F.xxhash64("key", "id"), "id", "n")).alias("l"),
                                       F.count(F.lit(1)).alias("members")).where("members > 1")
    pairs = (p.join(lead, ["key", "cls"]).where("id <> l.id AND 100 * least(n, l.n) >= 80 * greatest(n, l.n)")
             .select(F.col("id").alias("a"), F.col("l.id").alias("b")).distinct())
    best = _agreeing(pairs, sets, matches).groupBy("a").agg(F.max_by("b", F.struct("same", F.negative("b"))).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rest_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """In short lists: the members outside the list's largest component against all
    members of other components. At most ``SHORT`` pairs for each posting."""
    open_ = posts.withColumn("cls", F.floor(F.log(F.col("n")) / CLASS).cast("int"))
    left = (open_.where("root <> main").withColumn("at", F.explode(F.array(F.col("cls") - 1, "cls", F.col("cls") + 1)))
            .select("key", F.col("at").alias("cls"), F.col("id").alias("i"), F.col("root").alias("r"),
                    F.col("n").alias("m")))
    pairs = open_.join(left, ["key", "cls"]).where(
        f"root <> r AND (root = main OR id < i) AND 100 * least(n, m) >= {percent} * greatest(n, m)")
    return pairs.select(F.least("id", "i").alias("a"), F.greatest("id", "i").alias("b")).distinct()


def linked_cells(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a cell's documents, where ``left`` marks one block and the rest the other
    (all left: one block with itself): each document with the smallest id that links
    lead to within the cell. Intersections are products of incidence matrices, over
    the shingles that several documents have, some thousand at a time."""
    rows, cols = np.flatnonzero(left), np.flatnonzero(~left)
    if not len(cols):
        cols = rows
    size = np.array([len(s) for s in sets], np.float32)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    value, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    keep = count[place] > 1
    owner, place = owner[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((len(rows), len(cols)), np.float32)
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        i, j = np.searchsorted(place, (start, start + 4096))
        dense = np.zeros((len(sets), 4096), np.float32)
        dense[owner[i:j], place[i:j] - start] = 1
        both += dense[rows] @ dense[cols].T
    link = 100 * both >= percent * (size[rows, None] + size[None, cols] - both)
    label = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = label.copy()
        new[rows] = np.minimum(new[rows], np.where(link, label[cols], top).min(axis=1, initial=top))
        new[cols] = np.minimum(new[cols], np.where(link, label[rows][:, None], top).min(axis=0, initial=top))
        if (new == label).all():
            break
        label = new
    moved = label != ids
    return ids[moved], label[moved]


def _cell_links(posts: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """In long lists: whole blocks of documents against each other, so that no pair
    is ever a row. A document's home is the longest of its lists; homes are dealt into
    blocks of about ``CELL_SHINGLES`` shingles, and two blocks that meet in some list
    are one cell."""
    home = posts.groupBy("id").agg(F.max(F.struct("members", "key")).alias("h"), F.max("n").alias("n"))
    weight = home.groupBy("h.key").agg(F.sum(F.col("n") + CELL_OVERHEAD).alias("w"))
    slot = F.pmod(F.xxhash64("id"), F.ceil(F.col("w") / CELL_SHINGLES))
    doc = stored(home.select("id", "n", F.col("h.key").alias("key")).join(weight, "key")
                 .select("id", F.xxhash64("key", slot).alias("block")), "homes")
    met = posts.join(doc, "id").select("key", "block").distinct()
    cells = (met.withColumnRenamed("block", "i").join(met.withColumnRenamed("block", "j"), "key").where("i <= j")
             .select("i", "j").distinct())
    rows = _full_sets(doc.select("id"), texts, width).join(doc, "id")
    left = cells.join(rows.withColumnRenamed("block", "i"), "i").select("i", "j", F.lit(True).alias("left"), "id", "s")
    right = cells.where("i < j").join(rows.withColumnRenamed("block", "j"), "j").select(
        "i", "j", F.lit(False).alias("left"), "id", "s")

    def run(cell: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell["s"]]
        a, b = linked_cells(cell["id"].to_numpy(), sets, cell["left"].to_numpy(), percent)
        hand_back()
        return pa.table({"a": pa.array(b), "b": pa.array(a)})

    return left.union(right).groupBy("i", "j").applyInArrow(run, "a long, b long")


def _full_sets(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(id, s): the shingle sets of some documents, as bytes."""

    def to_sets(batches):
        for batch in slices(batches, "t"):
            sets = shingle_sets(text_bytes(batch.column(1)), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["id", "s"])

    return stored(mapped(texts.join(ids, "id", "left_semi"), to_sets, "id long, s binary")
                  .groupBy("id").agg(F.max_by("s", F.length("s")).alias("s")), "sets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, coords: int = COORDS, matches: int = MATCHES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    sigs = signatures(docs, id_col, text_col, shingle, coords)
    sigs = stored(sigs, "signatures")
    # rows of one id: the largest set stands for the id
    member = sigs.groupBy("id").agg(F.max(F.struct("n", "f1", "f2")).alias("x")).select("id", "x.*")
    # equal sets are one class, its smallest id stands for it
    classes = member.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    sets = stored(sigs.join(classes.select(F.col("rep").alias("id"), "n", "f1", "f2"), ["id", "n", "f1", "f2"])
                  .dropDuplicates(["id", "n", "f1", "f2"]).select("id", "n", "sig"), "reps")
    posts = stored(_postings(sets, coords, matches), "postings")
    # few sets share enough with others to be posted; from here on 16 bits of each value do
    sets = stored(sets.join(posts.select("id").distinct(), "id", "left_semi")
                  .select("id", F.expr("transform(sig, v -> cast(v & 32767 AS SMALLINT))").alias("sig")), "posted")
    texts = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
             .where("id IS NOT NULL"))
    done = stored(_leader_pairs(posts, sets, matches), "pairs")
    comps = components(_confirmed(done, texts, shingle, percent))
    # what the leaders didn't connect, in the lists that still hold several components
    rooted = _with_roots(posts, comps, "id", "root")
    count = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
    lists = count.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("members"),
                                     F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps")
    rooted = stored(rooted.join(lists, "key"), "open")
    rest = _agreeing(_rest_pairs(rooted.where(F.col("members") <= SHORT), percent), sets, matches)
    rest = stored(rest.join(done, ["a", "b"], "left_anti").select("a", "b"), "pairs")
    found = _confirmed(rest, texts, shingle, percent)
    long = rooted.where(F.col("members") > SHORT)
    if not long.isEmpty():
        found = found.union(_cell_links(long, texts, shingle, percent))
    comps = components(found.union(comps.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = member.join(classes, ["n", "f1", "f2"], "left").withColumn("rep", F.coalesce("rep", "id"))
    named = _with_roots(named, comps, "rep", "component_id")
    return named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
                        (F.col("id") == F.col("component_id")).alias("kept"))
