"""Language identification with interpolated Kneser-Ney character models.

Training counts the character n-grams (letters lowered, everything else one
space) of every labelled text, one language at a time, on the executors; the
sums are kept per (language, n-gram). Lower orders use continuation counts, so
they follow from the distinct n-grams of the highest order. All languages share
one table per order: n-gram hashes, sorted, beside the log-probability under each
language, so scoring is a binary search for each character. The lowest
cross-entropy per character wins.

No n-gram is dropped. Up to ``BROADCAST_GRAMS`` counted n-grams the model is arrays that
every task holds. Above that it is Spark tables: discounts, continuation counts,
probabilities and back-off weights by groupings and joins, and documents are scored by
joining their n-grams, each distinct one looked up once.

Rejection is calibrated on training documents: the excess of the winning
cross-entropy over its language's mean, in units of a length-dependent
deviation, must stay below ``SLACK`` times the value that all but
``REJECT_RATE`` of the calibration rows stay below.

Null texts and texts without a letter: ``und``, score 0, rejected. Ties go to
the language that sorts first. Rows repeat as they come, null ids included.
Without a labelled row every document is ``und``. Columns named like the
operator's outputs are replaced. Letters above the basic plane are one symbol. The
calibration reads about ``CALIBRATION_ROWS`` documents, chosen by a hash of their ids
(their scores, not their texts, reach the driver)."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.llm.common import list_array, mapped, slices, stored
from cofilter.operators.selection import kth_values

ORDER = 4
BROADCAST_GRAMS = 2_000_000
REJECT_RATE = 0.0005
SLACK = 3.0
UNKNOWN = "und"
_BITS = np.uint64(16)


@functools.cache
def _letters() -> np.ndarray:
    """Symbol of every code point: itself for letters (65535 above the basic
    plane), 32 for the rest."""
    out = np.full(0x110000, 32, np.uint16)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = min(c, 0xFFFF)
    return out


def symbols(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in one array, the start of each text and its count
    of letters. A text is ``order - 1`` spaces, its letter runs with single spaces
    between, and a space at the end where it has letters."""
    joined = ("\n" + "\n".join(texts)).lower() if texts else ""
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    # lower() can change a text's length: starts come from the lowered texts
    lengths = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts)) if len(code) != sum(
        map(len, texts)) + len(texts) else np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths + 1) - lengths - 1
    sym = _letters()[code]
    letter = sym != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the space after a run of letters
    keep[begins] = False  # the mark before a text
    ends = begins + lengths
    # a run that touches the end of its text needs its space too: the next text's mark serves
    open_end = letter[ends] & (lengths > 0)
    sym, count = sym.copy(), np.add.reduceat(letter, begins, dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(keep)))
    sizes = total[ends + 1] - total[begins] + open_end
    pad = order - 1
    starts = np.cumsum(sizes + pad) - sizes - pad
    out = np.full(int((sizes + pad).sum()), 32, np.uint16)
    body = np.ones(len(out), bool)
    for j in range(pad):
        body[starts + j] = False
    body[(starts + pad + sizes - 1)[open_end]] = False
    out[body] = sym[keep]
    return out, starts, count


def gram_keys(sym: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each symbol from ``order - 1`` on, packed."""
    wide = sym.astype(np.uint64)
    key = wide[: len(wide) - order + 1].copy()
    for j in range(1, order):
        key = (key << _BITS) | wide[j: len(wide) - order + 1 + j]
    return key


def _body(starts: np.ndarray, size: int, order: int) -> np.ndarray:
    """Positions of n-grams that end inside a text, not in the next one's padding."""
    keep = np.ones(size, bool)
    for j in range(1, order):
        at = starts[1:] - j
        keep[at[at >= 0]] = False
    return keep


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def count_grams(docs: DataFrame, text_col: str, lang_col: str, order: int) -> DataFrame:
    """(lang, gram, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        def out(lang, key, n):
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)),
                                               pa.array(n)], names=["lang", "gram", "n"])

        for batch in slices(batches, "t", 1 << 19):
            langs, texts = batch.column(0).to_pylist(), _texts(batch.column(1))
            for lang in sorted(set(langs)):
                sym, starts, _ = symbols([t for t, x in zip(texts, langs, strict=True) if x == lang], order)
                if len(sym) < order:
                    continue
                key = gram_keys(sym, order)
                key, n = np.unique(key[_body(starts, len(key), order)], return_counts=True)
                held.setdefault(lang, []).append((key, n.astype(np.int64)))
                if sum(len(k) for k, _ in held[lang]) > 500_000:
                    held[lang] = [merged(held[lang])]
                    if len(held[lang][0][0]) > 250_000:
                        yield out(lang, *held.pop(lang)[0])
        for lang, parts in held.items():
            yield out(lang, *merged(parts))

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).where(
        "lang IS NOT NULL AND t IS NOT NULL")
    return (mapped(rows, run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _discount(n: np.ndarray) -> float:
    one, two = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
    return one / (one + 2 * two) if one and two else 0.5


def _hash(key: np.ndarray) -> np.ndarray:
    """Bijective: equal hashes are equal n-grams. The leading bits depend on all symbols."""
    return key * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Table:
    """Sorted hashes, a row of values for each, and where every leading-bits bucket starts."""

    hashes: np.ndarray
    values: list[np.ndarray]  # one array by language
    bucket: np.ndarray
    shift: np.uint64
    deepest: int

    @staticmethod
    def build(key: np.ndarray, value: np.ndarray) -> Table:
        h = _hash(key)
        at = np.argsort(h)
        h = h[at]
        bits = int(np.clip(np.ceil(np.log2(max(2, len(h)))), 1, 22))
        shift = np.uint64(64 - bits)
        bucket = np.searchsorted((h >> shift).astype(np.int64), np.arange((1 << bits) + 1)).astype(np.int32)
        return Table(np.append(h, np.uint64(0)), [np.ascontiguousarray(np.append(v, 0.0)) for v in value[at].T],
                     bucket, shift, int(np.diff(bucket).max(initial=0)))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each n-gram (the last one, of value 0, where it isn't there) and whether it's there."""
        h = _hash(key)
        at = self.bucket[(h >> self.shift).astype(np.int64)]
        hit = self.hashes[at] == h
        left = np.flatnonzero(~hit)
        for _ in range(self.deepest - 1):
            if not len(left):
                break
            at[left] = np.minimum(at[left] + 1, len(self.hashes) - 1)
            ok = self.hashes[at[left]] == h[left]
            hit[left[ok]] = True
            left = left[~ok]
        at[~hit] = len(self.hashes) - 1
        hit &= at < len(self.hashes) - 1
        return at, hit


@dataclass
class Model:
    langs: list[str]
    order: int
    grams: list[Table]  # by order: log P
    back: list[Table]  # by order, of contexts: log back-off weight
    floor: np.ndarray  # log P of a symbol never seen
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = np.inf
    heat: float = 1.0

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per symbol by text and language, the number of symbols, the number of letters."""
        sym, starts, letters = symbols(texts, self.order)
        sizes = np.diff(np.append(starts, len(sym))) - self.order + 1
        out = np.zeros((len(texts), len(self.langs)))
        if len(self.langs) and sizes.any():
            key = gram_keys(sym, self.order)
            key = key[_body(starts, len(key), self.order)]
            full = sizes > 0
            first = (np.cumsum(sizes) - sizes)[full]
            at, hit = self.grams[-1].find(key)
            miss = np.flatnonzero(~hit)
            rest, rest_at = np.unique(key[miss], return_inverse=True)
            lower = self._backed_off(rest, self.order)
            for j in range(len(self.langs)):
                logp = self.grams[-1].values[j][at]
                logp[miss] = lower[rest_at, j]
                out[full, j] = -np.add.reduceat(logp, first) / sizes[full]
        return out, sizes, letters

    def _backed_off(self, key: np.ndarray, order: int) -> np.ndarray:
        """log P of n-grams that the table of their order lacks, by language."""
        key_low = key & np.uint64((1 << 16 * (order - 1)) - 1)
        at, _ = self.back[order - 1].find(key >> _BITS)
        weight = np.stack([v[at] for v in self.back[order - 1].values], 1)
        if order == 1:
            return weight + self.floor
        at, hit = self.grams[order - 2].find(key_low)
        lower = np.stack([v[at] for v in self.grams[order - 2].values], 1)
        if not hit.all():
            lower[~hit] = self._backed_off(key_low[~hit], order - 1)
        return weight + lower


def kneser_ney(langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]], order: int) -> Model:
    """Interpolated Kneser-Ney models from the (packed n-gram, count) table of each language."""
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    for key, n in tables:
        at = np.argsort(key)
        key, n = key[at], n[at]
        for k in range(order, 0, -1):
            by_order[k - 1].append((key, n))
            # continuation counts: in how many different contexts the shorter n-gram occurs
            key, n = np.unique(key & np.uint64((1 << 16 * (k - 1)) - 1), return_counts=True)
    alphabet = np.unique(np.concatenate([key for key, _ in by_order[0]])) if langs else np.empty(0)
    floor = np.full(len(langs), 1.0 / (len(alphabet) + 1))
    grams, back, lower_key, lower = [], [], np.zeros(1, np.uint64), np.log(floor)[None, :]
    for k in range(1, order + 1):
        union = np.unique(np.concatenate([key for key, _ in by_order[k - 1]]))
        contexts = np.unique(union >> _BITS)
        prob, weight = np.empty((len(union), len(langs))), np.zeros((len(contexts), len(langs)))
        # P of the suffix, found or backed off
        base = np.exp(lower[np.searchsorted(lower_key, union & np.uint64((1 << 16 * (k - 1)) - 1))])
        of = np.searchsorted(contexts, union >> _BITS)
        for j, (key, n) in enumerate(by_order[k - 1]):
            d = _discount(n)
            ctx = np.searchsorted(contexts, key >> _BITS)
            total = np.bincount(ctx, n, len(contexts))
            kinds = np.bincount(ctx, minlength=len(contexts))
            gamma = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            own = np.zeros(len(union))
            own[np.searchsorted(union, key)] = np.maximum(n - d, 0)
            prob[:, j] = own / np.maximum(total[of], 1) + gamma[of] * base[:, j]
            weight[:, j] = np.log(gamma)
        grams.append(Table.build(union, np.log(prob)))
        back.append(Table.build(contexts, weight))
        lower_key, lower = union, np.log(prob)
    return Model(langs, order, grams, back, np.log(floor))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
          broadcast_grams: int | None = None) -> Model | WideModel:
    counted = stored(count_grams(docs, text_col, lang_col, order), "grams")
    size = counted.count()
    if not size:
        return Model([], order, [], [], np.empty(0))
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())  # a label each
    if size > (BROADCAST_GRAMS if broadcast_grams is None else broadcast_grams):
        model = wide_model(counted, langs, order)
    else:
        table = counted.select("lang", "gram", "n").toArrow()
        place = pc.index_in(table["lang"].combine_chunks(), pa.array(langs)).to_numpy(zero_copy_only=False)
        gram, n = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
        model = kneser_ney(langs, [(gram[place == j], n[place == j]) for j in range(len(langs))], order)
    return calibrate(docs, model, text_col, lang_col)


@dataclass
class WideModel:
    """The same model as tables (gram, p) and (gram, w) by order: log-probabilities of
    n-grams and log back-off weights of contexts, an array over the languages each."""

    langs: list[str]
    order: int
    grams: list[DataFrame]
    back: list[DataFrame]
    floor: float  # log P of a symbol never seen
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = np.inf
    heat: float = 1.0

    def entropies(self, rows: DataFrame, key: str, text_col: str) -> DataFrame:
        """(key, size, letters, ce) of rows told apart by ``key``."""
        order = self.order

        def run(batches):
            for batch in slices(batches, "t", 1 << 19):
                sym, starts, letters = symbols(_texts(batch.column(1)), order)
                sizes = np.diff(np.append(starts, len(sym))) - order + 1
                found = gram_keys(sym, order)
                found = found[_body(starts, len(found), order)]
                own = np.repeat(np.arange(len(sizes)), sizes)
                at = np.lexsort((found, own))
                found, own = found[at], own[at]
                edge = np.flatnonzero((np.diff(found, prepend=~found[:1]) != 0) | (np.diff(own, prepend=-1) != 0))
                n = np.diff(np.append(edge, len(found)))
                each = np.bincount(own[edge], minlength=len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes), pa.array(letters), list_array(found[edge].view(np.int64), each, pa.int64()),
                     list_array(n, each, pa.int64())], names=["key", "size", "letters", "gram", "n"])

        docs = rows.select(F.col(key).alias("key"), F.col(text_col).alias("t"))
        kind = dict(rows.dtypes)[key]
        docs = stored(mapped(docs, run, f"key {kind}, size long, letters long, gram array<long>, n array<long>"), "docs")
        parts = docs.select("key", F.explode(F.arrays_zip("gram", "n")).alias("x")).select("key", "x.gram", "x.n")
        known = self._looked_up(parts.select("gram").distinct())
        langs = range(len(self.langs))
        ce = parts.join(known, "gram").groupBy("key").agg(*[F.sum(F.col("n") * F.col("p")[j]).alias(f"s{j}") for j in langs])
        out = docs.select("key", "size", "letters").join(ce, "key", "left")
        return out.select(F.col("key").alias(key), "size", "letters", F.array(*[
            F.when(F.col("size") > 0, -F.coalesce(F.col(f"s{j}"), F.lit(0.0)) / F.col("size")).otherwise(0.0) for j in langs]).alias("ce"))

    def _looked_up(self, grams: DataFrame) -> DataFrame:
        """(gram, p): found in the table of its order, or backed off."""
        zero = F.array(*[F.lit(0.0) for _ in self.langs])
        out = grams.withColumn("p", F.lit(None).cast("array<double>")).withColumn("w", zero)
        for k in range(self.order, 0, -1):
            low = out.withColumn("low", F.col("gram").bitwiseAND(F.lit(_mask(k))))
            low = low.join(self.grams[k - 1].select(F.col("gram").alias("low"), F.col("p").alias("own")), "low", "left")
            low = low.withColumn("ctx", F.shiftrightunsigned("low", 16)).join(
                self.back[k - 1].select(F.col("gram").alias("ctx"), F.col("w").alias("more")), "ctx", "left")
            here = F.zip_with("w", "own", lambda a, b: a + b)
            out = low.select("gram", F.coalesce("p", F.when(F.col("own").isNotNull(), here)).alias("p"),
                             F.zip_with("w", F.coalesce("more", zero), lambda a, b: a + b).alias("w"))
        return out.select("gram", F.coalesce("p", F.transform("w", lambda x: x + self.floor)).alias("p"))


def _mask(k: int) -> int:
    """The low k symbols of a packed n-gram, as a signed number."""
    return (1 << 16 * k) - 1 if k < 4 else -1


def wide_model(counted: DataFrame, langs: list[str], order: int) -> WideModel:
    """``kneser_ney`` by groupings and joins."""
    by_order = [counted.select("lang", "gram", "n")]
    for k in range(order - 1, 0, -1):  # continuation counts
        by_order.append(stored(by_order[-1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram"))
                               .agg(F.count(F.lit(1)).alias("n")), "grams"))
    by_order.reverse()
    floor = float(np.log(1.0 / (by_order[0].select("gram").distinct().count() + 1)))
    grams, back = [], []
    for k, table in enumerate(by_order, 1):
        ones = {r["lang"]: r for r in table.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")).alias("one"),
                                                              F.sum((F.col("n") == 2).cast("long")).alias("two")).collect()}
        d = [ones[x]["one"] / (ones[x]["one"] + 2 * ones[x]["two"]) if x in ones and ones[x]["one"] and ones[x]["two"] else 0.5 for x in langs]
        count = table.groupBy("gram").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in langs]).alias("c"))
        count = stored(count.withColumn("ctx", F.shiftrightunsigned("gram", 16)), "counts")
        sums = count.groupBy("ctx").agg(
            F.array(*[F.sum(F.col("c")[j]) for j in range(len(langs))]).alias("total"),
            F.array(*[F.sum((F.col("c")[j] > 0).cast("long")) for j in range(len(langs))]).alias("kinds"))
        gamma = F.array(*[F.when(F.col("total")[j] > 0, F.lit(d[j]) * F.col("kinds")[j] / F.col("total")[j]).otherwise(1.0)
                          for j in range(len(langs))])
        sums = stored(sums.withColumn("gamma", gamma), "contexts")
        rows = count.join(sums, "ctx")
        if k == 1:
            rows = rows.withColumn("base", F.array(*[F.lit(floor) for _ in langs]))
        else:
            rows = rows.withColumn("low", F.col("gram").bitwiseAND(F.lit(_mask(k - 1)))).join(
                grams[-1].select(F.col("gram").alias("low"), F.col("p").alias("base")), "low")
        p = F.array(*[F.log(F.greatest(F.col("c")[j] - F.lit(d[j]), F.lit(0.0)) / F.greatest(F.col("total")[j], F.lit(1))
                            + F.col("gamma")[j] * F.exp(F.col("base")[j])) for j in range(len(langs))])
        grams.append(stored(rows.select("gram", p.alias("p")), "grams"))
        back.append(stored(sums.select(F.col("ctx").alias("gram"), F.transform("gamma", lambda x: F.log(x)).alias("w")), "back"))
    return WideModel(langs, order, grams, back, floor)


def calibrate(docs: DataFrame, model: Model | WideModel, text_col: str, lang_col: str) -> Model | WideModel:
    """Deviation of the cross-entropy by length, rejection limit and score temperature,
    from every labelled text; sums and order statistics reach the driver, no row does."""
    known = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).where("t IS NOT NULL AND lang IS NOT NULL")
    if isinstance(model, WideModel):
        known = stored(known.withColumn("row", F.monotonically_increasing_id()), "known")
        got = model.entropies(known, "row", "t").join(known.select("row", "lang"), "row")
        rows = got.select("ce", "size", "letters", "lang")
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            for batch in slices(batches, "t", 1 << 19):
                ce, sizes, letters = shared.value.cross_entropy(_texts(batch.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(list(ce)), pa.array(sizes), pa.array(letters), batch.column(1)],
                                                 names=["ce", "size", "letters", "lang"])

        rows = mapped(known, run, "ce array<double>, size long, letters long, lang string")
    rows = stored(rows.where("letters > 0").select("ce", "size", "lang"), "entropies")
    langs, n = model.langs, len(model.langs)
    grid = np.geomspace(0.25, 64, 25)

    def numbers(batch):
        ce = pc.list_flatten(batch.column(0)).to_numpy().reshape(-1, n)
        return ce, batch.column(1).to_numpy().astype(float), ce.min(axis=1)

    def first(batch):
        ce, size, low = numbers(batch)
        true, each = np.searchsorted(langs, batch.column(2).to_pylist()), np.arange(len(ce))
        own = ce[each, true]
        return [*np.bincount(true, minlength=n), *np.bincount(true, own, n), low.sum(),
                *[_log_share(ce, size, g)[each, true].sum() for g in grid]]

    total = _sums(rows, first, 2 * n + 1 + len(grid))
    seen = total[:n]
    if not seen.sum():
        return model
    mean = np.where(seen > 0, total[n: 2 * n] / np.maximum(seen, 1), total[2 * n] / seen.sum())
    model.heat = float(grid[int(np.argmax(total[2 * n + 1:]))])

    # deviation² = between documents + within documents / symbols, fitted by moments over long and short texts
    def moments(batch):
        ce, size, low = numbers(batch)
        square = (low - mean[ce.argmin(axis=1)]) ** 2
        return [size.sum(), len(size), (1 / size).sum(), (size * square).sum(), square.sum()]

    m = _sums(rows, moments, 5)
    spread = np.maximum(np.linalg.lstsq(np.array([[m[0], m[1]], [m[1], m[2]]]), m[3:], rcond=None)[0], [1e-4, 0.25])

    def excess(batches):
        for batch in batches:
            ce, size, low = numbers(batch)
            yield pa.RecordBatch.from_arrays([pa.array((low - mean[ce.argmin(axis=1)]) / np.sqrt(spread[0] + spread[1] / size))], names=["x"])

    place = (seen.sum() - 1) * (1 - REJECT_RATE)
    ranks = [math.floor(place), math.ceil(place)]
    value = kth_values(stored(mapped(rows, excess, "x double"), "excess"), "x", ranks)
    high = value[ranks[0]] + (place - ranks[0]) * (value[ranks[1]] - value[ranks[0]])
    model.mean, model.spread, model.limit = mean, spread, float(SLACK * max(1.0, high))
    return model


def _sums(rows: DataFrame, numbers, count: int) -> np.ndarray:
    """Sums over all batches of the numbers that a function gives for one."""

    def run(batches):
        total = np.zeros(count)
        for batch in batches:
            if batch.num_rows:
                total += np.array(numbers(batch), float)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count)), pa.array(total)], names=["at", "x"])

    out = np.zeros(count)
    for r in mapped(rows, run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out


def _log_share(ce: np.ndarray, size: np.ndarray, heat: float) -> np.ndarray:
    z = -heat * np.sqrt(size)[:, None] * (ce - ce.min(axis=1, keepdims=True))
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class Judge:
    """What decides, apart from the n-grams."""

    langs: list[str]
    mean: np.ndarray | None
    spread: np.ndarray | None
    limit: float
    heat: float

    @staticmethod
    def of(m: Model | WideModel) -> Judge:
        return Judge(m.langs, m.mean, m.spread, m.limit, m.heat)

    def columns(self, ce: np.ndarray, size: np.ndarray, letters: np.ndarray) -> list[pa.Array]:
        """lang_pred, lang_score, cross_entropy and rejected."""
        n = len(ce)
        ok = (letters > 0) & bool(self.langs)
        lang, score, low, out = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n), ~ok
        if ok.any():
            best = ce.argmin(axis=1)
            low = np.where(ok, ce.min(axis=1), 0)
            lang[ok] = np.array(self.langs, object)[best[ok]]
            score[ok] = np.exp(_log_share(ce[ok], size[ok].astype(float), self.heat).max(axis=1))
            if self.spread is not None:
                off = (low - self.mean[best]) / np.sqrt(self.spread[0] + self.spread[1] / np.maximum(size, 1))
                out |= off > self.limit
        return [pa.array(lang, pa.string()), pa.array(score), pa.array(low), pa.array(out)]


def identify(docs: DataFrame, model: Model | WideModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred, lang_score, cross_entropy and rejected."""
    new = ["lang_pred", "lang_score", "cross_entropy", "rejected"]
    made = "lang_pred string, lang_score double, cross_entropy double, rejected boolean"
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    sent = kept if text_col in kept else [*kept, text_col]  # the text goes out once
    at = sent.index(text_col)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(sent)])
    judge = Judge.of(model)
    if isinstance(model, WideModel):
        rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")

        def decide(batches):
            for batch in batches:
                ce = np.array(batch.column(3).to_pylist()).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *judge.columns(ce, batch.column(1).to_numpy(), batch.column(2).to_numpy())], names=["_row", *new])

        done = rows.join(mapped(model.entropies(rows, "_row", f"_c{at}"), decide, f"_row long, {made}"), "_row")
        return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], *new)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, f"_c{at}", 1 << 19):
            columns = judge.columns(*shared.value.cross_entropy(_texts(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[f"_c{i}" for i in range(len(kept))] + new)

    schema = ", ".join([f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] + [made])
    return mapped(rows, run, schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], *new)
