"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case with single spaces. An item of m
characters may differ in e = floor(``rate`` * m) edits. It is cut into e + 1
pieces; a passage within e edits holds one of them unchanged, so an automaton
over all pieces finds every candidate place, and Myers' bit-parallel algorithm
gives the least distance of the item to any substring there.

Items are read in chunks of at most ``CHUNK_CHARS`` characters; each chunk is
broadcast and meets all documents, so nothing broadcast grows with the data.
Equal items share one search and are all reported. Null and empty texts match
nothing; null and blank items are matched by nothing; an item too short for an
edit must occur unchanged. Rows with a null id are left out; rows that repeat an
id are read as they come and reported once. A document and an item give one
row, with the least distance of all places and, of those, the first end."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.llm.common import mapped, slices

RATE = 0.06
CHUNK_CHARS = 8 << 20


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item cut into edits + 1 pieces of nearly equal length, with their places."""
    cut = np.linspace(0, len(item), edits + 2).astype(int)
    return [(int(a), item[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any substring of the text and the
    first end of such a substring, if within the limit (Myers 1999)."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score = mask, 0, m
    best = (m, 0) if m <= limit else None
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # the first row is zero: a match may start anywhere
        ph, mh = ph << 1, mh << 1
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
        if score <= limit and (best is None or score < best[0]):
            best = (score, i + 1)
    return best


class Matcher:
    """The pieces of a chunk of items in one automaton."""

    def __init__(self, items: list[str], rate: float):
        self.items = [(t, int(rate * len(t))) for t in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (t, e) in enumerate(self.items):
            for place, piece in pieces(t, e):
                at.setdefault(piece, []).append((n, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end) of every item within its edits of a substring."""
        if not len(self.automaton) or not text:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, place in where:
                starts.setdefault(n, set()).add(end + 1 - size - place)
        out = []
        for n, found in starts.items():
            item, e = self.items[n]
            best, low, high = None, None, None
            for s in [*sorted(found), None]:
                # places whose windows overlap are searched as one
                if low is not None and (s is None or s - e > high):
                    begin = max(0, low)
                    hit = myers(item, text[begin:high], e)
                    if hit and (best is None or hit[0] < best[0]):
                        best = (hit[0], begin + hit[1])
                    low = None
                if s is not None:
                    low = s - e if low is None else low
                    high = s + len(item) + e
            if best:
                out.append((n, *best))
        return out


def _chunks(benchmark: DataFrame, item_col: str, text_col: str, chunk_chars: int):
    """Lists of (distinct normalised item, its ids), a bounded number of characters in each."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(
        "i IS NOT NULL AND t IS NOT NULL")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = int(total // chunk_chars) + 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        items: dict[str, list[int]] = {}
        for r in part.toLocalIterator():
            if t := normalise(r["t"]):
                items.setdefault(t, []).append(r["i"])
        yield sorted((t, sorted(set(ids))) for t, ids in items.items())


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE,
            chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end_char): items that occur in a document within their edits."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(
        "i IS NOT NULL AND t IS NOT NULL")
    parts = []
    for items in _chunks(benchmark, item_col, item_text_col, chunk_chars):
        shared = sc.broadcast(items)

        def run(batches, shared=shared):
            matcher = Matcher([t for t, _ in shared.value], rate)
            for batch in slices(batches, "t"):
                out = []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for n, distance, end in matcher.find(normalise(t)):
                        out += [(i, item, distance, end) for item in shared.value[n][1]]
                columns = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns],
                                                 names=["doc_id", "item_id", "distance", "end_char"])

        parts.append(mapped(rows, run, "doc_id long, item_id long, distance long, end_char long"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return (found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end_char")).alias("x"))
            .select("doc_id", "item_id", "x.*"))


def without_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", rate: float = RATE, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose own text holds no item within its edits, whatever their
    ids: null and repeated ids are kept or dropped by their texts, null and empty texts
    stay. Each row is searched where it is; nothing is joined back."""
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for items in _chunks(benchmark, item_col, item_text_col, chunk_chars):
        shared = sc.broadcast([t for t, _ in items])

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, rate)
            for batch in slices(batches, text_col):
                clean = [not t or not matcher.find(normalise(t)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = mapped(docs, run, schema)
    return docs
