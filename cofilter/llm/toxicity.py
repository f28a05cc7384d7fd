"""Toxicity from a subsequence string kernel, Nyström landmarks and a linear SVM.

Words are compared by their gapped three-letter subsequences: each occurrence
spanning s characters weighs ``DECAY ** s``, spans over ``SPAN`` don't count, and
the start of a word is a letter of its own. An inserted or replaced letter is
only a longer gap, and characters that aren't letters are skipped. The normalised kernel is raised to ``POWER`` (a product of
kernels is a kernel), and the kernel of two sentences is the sum over their word
pairs, so a sentence's decision is a sum over its words. Landmarks are words and
word beginnings typical of the toxic training documents, taken until each of those
documents holds ``COVER`` of them or near copies of them (if it has that many), so a
rare language gets its own; a word that so many could show by chance is not typical; the Nyström map is the inverse root of their kernel
matrix, and a squared-hinge SVM is trained on the mapped sentences. Sentence
labels come from document labels: a clean document's sentences are clean, and of
a toxic document's those that the machine itself picks, its best one at least,
are toxic (a few rounds of training and picking). The features of the training
sentences stay on the executors; each Newton step brings sums of their products.

A document's score is a logistic curve, fitted to document labels, of its worst
sentence's decision, the number of sentences above ``HARMLESS``, and its length. The
curve never falls with the first two and never rises with the length, so harmless
sentences can't raise a score. Runs of three or more one-letter words also count as one
word, which catches spaced-out insults.

Null and empty texts, and texts without words, score as a sentence without
words. Equal texts score the same; rows repeat as they come, null ids included.
Without labelled rows of both kinds every score is the share of toxic rows.
Training reads at most ``TRAIN_DOCS`` documents of each label, in hash order,
weighted to the mix of all labelled rows, with all their sentences; scoring reads whole texts."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cofilter.llm.common import list_array, mapped, slices, stored
from cofilter.llm.quality import _logistic, training_ids

DECAY = 0.6
SPAN = 5
POWER = 4  # a power of two
COVER = 8
HARMLESS = -0.7  # the margin of clean sentences is at -1
TYPICAL = 8  # words of a toxic training document that can become landmarks
TRAIN_DOCS = 3_000
CHUNK = 4096  # sentences of a stored row
PICKS = 4
RIDGE = 1e-5
GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_TABLE = 1 << 21  # subsequences up to this number are looked up in a table, else by binary search


@functools.cache
def _letter_table() -> np.ndarray:
    table = np.array([chr(c).isalpha() for c in range(0x110000)])
    table[10] = True  # the mark
    return table


@dataclass
class Words:
    """The words of a batch of texts: distinct ones, and where they occur."""

    distinct: list[str]
    code: np.ndarray  # by occurrence: index into ``distinct``
    sentence: np.ndarray  # by occurrence: sentence within the batch
    first: np.ndarray  # by text: its first sentence; one more at the end

    @staticmethod
    def of(texts: pa.Array) -> Words:
        # a line's end also ends a sentence
        lines = pc.replace_substring(pc.fill_null(pc.utf8_lower(texts), ""), "\n", " .\n")
        tokens = pc.utf8_split_whitespace(lines)
        sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = tokens.flatten()
        flat = flat.filter(pc.not_equal(flat, "")) if len(flat) else flat
        if len(flat) != sizes.sum():
            kept = pc.not_equal(tokens.flatten(), "").to_numpy(zero_copy_only=False)
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), kept, len(sizes)).astype(np.int64)
        coded = flat.dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes)
        ends = pc.match_substring_regex(words, "[.!?]$").to_numpy(zero_copy_only=False) if len(words) else np.empty(0, bool)
        # a sentence ends with its text, or after a word that ends in . ! or ?
        stop = ends[code] if len(code) else np.empty(0, bool)
        stop[np.cumsum(sizes)[sizes > 0] - 1] = True
        sentence = np.cumsum(stop) - stop
        count = np.bincount(text, stop, len(sizes)).astype(np.int64)
        blank = np.cumsum(count == 0) - (count == 0)  # texts without words have one empty sentence
        sentence = sentence + blank[text]
        first = np.concatenate(([0], np.cumsum(np.maximum(count, 1))))
        out = Words(words.to_pylist(), code, sentence, first)
        out._join_letters(text)
        return out

    def _join_letters(self, text: np.ndarray) -> None:
        short = np.fromiter((len(w) == 1 and w.isalpha() for w in self.distinct), bool, len(self.distinct))
        if not short.any():
            return
        one = np.concatenate(([False], short[self.code], [False]))
        edge = np.diff(one.astype(np.int8))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        index, code, sentence = {}, [], []
        for a, b in zip(starts[stops - starts > 2].tolist(), stops[stops - starts > 2].tolist(), strict=True):
            for t in np.unique(text[a:b]):  # a run doesn't go on in the next text
                at = a + np.flatnonzero(text[a:b] == t)
                if len(at) > 2:
                    word = "".join(self.distinct[c] for c in self.code[at])
                    code.append(len(self.distinct) + index.setdefault(word, len(index)))
                    sentence.append(self.sentence[at[0]])
        if code:
            self.distinct = self.distinct + list(index)
            self.code = np.append(self.code, code)
            self.sentence = np.append(self.sentence, sentence)
            order = np.argsort(self.sentence, kind="stable")
            self.code, self.sentence = self.code[order], self.sentence[order]


def _norm(letters: np.ndarray) -> np.ndarray:
    """Norm of words with so many letters: every triple of letters and the mark before
    them, each a feature of its own."""
    total = sum(np.maximum(letters + 1.0 - j, 0) * DECAY ** (2 * j + 2) for _, j in GAPS)
    return np.sqrt(np.maximum(total, 1e-12)).astype(np.float32)


@dataclass
class Kernel:
    letters: str  # symbol 0 is a letter no landmark has, 1 the start of a word, from 2 on these
    landmarks: list[str]
    keys: np.ndarray  # sorted subsequences; ``weight`` has a row for each, and a last one for the rest
    index: np.ndarray | None  # subsequence -> row, where the table is small enough
    weight: np.ndarray  # subsequence x landmark

    @staticmethod
    def build(landmarks: list[str]) -> Kernel:
        letters = "".join(sorted({c for w in landmarks for c in w if c.isalpha()}))
        k = Kernel(letters, landmarks, np.empty(0, np.int64), None, np.zeros((1, len(landmarks)), np.float32))
        sym, word, norm = k._symbols(landmarks)
        parts = []
        for i, j in GAPS:
            key, same = k._subsequences(sym, word, i, j)
            at = np.flatnonzero(same)
            parts.append((key[at], word[at], np.full(len(at), DECAY ** (j + 1))))
        key, own, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, row = np.unique(key, return_inverse=True)
        weight = np.zeros((len(keys) + 1, len(landmarks)))
        np.add.at(weight, (row, own), value)
        k.keys = keys
        if (len(letters) + 2) ** 3 <= _TABLE:
            k.index = np.full((len(letters) + 2) ** 3, len(keys), np.int32)
            k.index[keys] = np.arange(len(keys))
        k.weight = (weight / norm).astype(np.float32)
        return k

    @functools.cached_property
    def _symbol(self) -> np.ndarray:
        out = np.zeros(0x110000, np.int32 if len(self.letters) < 1200 else np.int64)
        out[[ord(c) for c in self.letters]] = np.arange(len(self.letters)) + 2
        out[10] = 1
        return out

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The letters of all words with a mark before each word, the word of
        every position, and the norm of every word."""
        code = np.frombuffer(("\n" + "\n".join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = code[_letter_table()[code]]
        mark = code == 10
        word = np.cumsum(mark, dtype=np.int32) - np.int32(1)
        size = np.bincount(word, minlength=len(words)) - 1
        return self._symbol[code], word, _norm(size)

    def _subsequences(self, sym, word, i, j):
        """Key of the letters at distances 0, i and j, and whether one word holds all three."""
        n, base = max(0, len(sym) - j), len(self.letters) + 2
        return (sym[:n] * base + sym[i: i + n]) * base + sym[j: j + n], word[:n] == word[j: j + n]

    def _rows(self, key):
        if self.index is not None:
            return self.index[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys))

    def against(self, words: list[str]) -> np.ndarray:
        """The kernel of every word with every landmark."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        none = len(self.weight) - 1
        for start in range(0, len(words), 4096):
            part = words[start: start + 4096]
            sym, word, norm = self._symbols(part)
            sums = np.zeros((len(part), len(self.landmarks)), np.float32)
            for i, j in GAPS:
                key, same = self._subsequences(sym, word, i, j)
                row = self._rows(key)
                hit = np.flatnonzero((row != none) & same)
                if len(hit):
                    own = word[hit]
                    begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    sums[own[begin]] += np.float32(DECAY ** (j + 1)) * np.add.reduceat(self.weight[row[hit]], begin, axis=0)
            sums /= norm[:, None]
            for _ in range(POWER // 2):
                sums *= sums
            out[start: start + len(part)] = sums
        return out


@dataclass
class Machine:
    kernel: Kernel | None
    weight: np.ndarray  # by landmark, the Nyström map folded in
    bias: float = 0.0
    curve: np.ndarray | None = None  # of the document features, the constant last
    prior: float = 0.5

    def decisions(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Decision by sentence, first sentence by text (and one more)."""
        words = Words.of(texts)
        value = self.kernel.against(words.distinct) @ self.weight if self.kernel else np.zeros(len(words.distinct))
        return np.bincount(words.sentence, value[words.code], words.first[-1]) + self.bias, words.first

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Score by text, and the place of its worst sentence."""
        value, first = self.decisions(texts)
        worst = np.maximum.reduceat(value, first[:-1]) if len(texts) else np.empty(0)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        at = np.flatnonzero(value >= worst[owner])
        place = np.full(len(texts), -1, np.int64)
        place[owner[at][::-1]] = (at - first[owner[at]])[::-1]
        if self.curve is None:
            return np.full(len(texts), self.prior), place
        above = np.bincount(owner, value > HARMLESS, len(texts))
        return _logistic(document_features(worst, above, np.diff(first)) @ self.curve), place


def document_features(worst: np.ndarray, above: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of texts by their largest sentence decision, their number of sentences that are
    not harmless and of all: what the curve sees, a constant last. The second is scaled
    so that the ridge leaves it more of the say: one such sentence tells most."""
    return np.stack((np.clip(worst, -2, 2), 2 * np.log1p(above), np.log(n), np.ones(len(n))), 1)


def monotone_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The logistic curve of the document features that neither falls with the worst
    sentence and the number above ``HARMLESS`` nor rises with the length: a feature that would is left out."""
    use, sign = np.ones(4, bool), np.array([1, 1, -1, 0])
    while True:
        w = np.zeros(4)
        w[use] = fit_curve(x[:, use], y, weight)
        wrong = use & (w * sign < 0)
        if not wrong.any():
            return w
        use &= ~wrong


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps with a little ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _logistic(x @ w)
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * w)
        w += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return w


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... within each group of the given sizes."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def choose_landmarks(words: list[str], holders: list[list[int]], cover: int = COVER, at_once: int = 512) -> list[str]:
    """Of words in order of preference, with the documents that hold each: those that a
    document still lacking ``cover`` landmarks holds. A near copy of a landmark is none
    of its own, but counts for its documents."""
    lack: dict[int, int] = {}
    for docs in holders:
        for d in docs:
            lack[d] = cover
    taken: list[str] = []
    for start in range(0, len(words), at_once):
        part = [n for n in range(start, min(start + at_once, len(words))) if any(lack[d] > 0 for d in holders[n])]
        if not part:
            continue
        close = _gram(taken + [words[n] for n in part])
        own = list(range(len(taken)))
        for i, n in enumerate(part, len(taken)):
            if not any(lack[d] > 0 for d in holders[n]):
                continue
            if not own or close[i, own].max() < 0.7 ** POWER:
                own.append(i)
            for d in holders[n]:
                lack[d] -= 1
        names = taken + [words[n] for n in part]
        taken = [names[i] for i in own]
    return taken


def _gram(words: list[str]) -> np.ndarray:
    k = Kernel.build(words).against(words).astype(float)
    return (k + k.T) / 2


def hinge_sums(f: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """What a Newton step of the squared hinge needs of sentences ``f`` (a constant last):
    products and sums of those within the margin of ``w``, and the weight of all."""
    inside = y * (f @ w) < 1
    x, s = f[inside], weight[inside]
    return (x * s[:, None]).T @ x, x.T @ (s * y[inside]), float(weight.sum())


def newton(sums, root: np.ndarray, w: np.ndarray, steps: int = 25) -> np.ndarray:
    """The squared-hinge SVM on features mapped by ``root`` (the constant is not mapped);
    ``sums(w)`` gives the sums for weights of the unmapped features."""
    turn = np.zeros((len(root) + 1, len(root) + 1))
    turn[:-1, :-1], turn[-1, -1] = root, 1
    ridge = RIDGE * np.eye(len(turn))
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        left, right, total = sums(turn @ w)
        new = np.linalg.solve(ridge + turn.T @ left @ turn / total, turn.T @ right / total)
        if np.allclose(new, w, rtol=1e-6, atol=1e-6):
            break
        w = new
    return turn @ w


def _sentences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features (a constant last) and row of the batch for every stored sentence."""
    size = batch.column(3).to_numpy()
    flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
    f = np.ones((size.sum(), len(flat) // max(1, size.sum()) + 1))
    f[:, :-1] = flat.reshape(len(f), -1)
    return f, np.repeat(np.arange(len(size)), size)


def fit(kernel: Kernel, stored_features: DataFrame, prior: float) -> Machine:
    """Train on stored sentence features (doc, y, weight, n, f)."""
    value, vector = np.linalg.eigh(_gram(kernel.landmarks))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    size = len(root) + 1

    def best_of(pick: np.ndarray) -> dict[int, float]:
        """The largest decision of each toxic training document."""

        def run(batches):
            for batch in batches:
                f, row = _sentences(batch)
                best = np.full(batch.num_rows, -np.inf)
                np.maximum.at(best, row, f @ pick)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best)], names=["doc", "best"])

        got = mapped(stored_features.where("y = 1"), run, "doc long, best double").groupBy("doc").agg(F.max("best").alias("best"))
        return {r["doc"]: r["best"] for r in got.collect()}

    def summed(pick: np.ndarray | None, best: dict[int, float]):
        def sums(w: np.ndarray):
            def run(batches):
                left, right, total = np.zeros((size, size)), np.zeros(size), 0.0
                for batch in batches:
                    f, row = _sentences(batch)
                    toxic = batch.column(1).to_numpy()[row] == 1
                    weight = batch.column(2).to_numpy()[row]
                    if pick is not None:
                        own = f @ pick
                        top = np.array([best.get(d, np.inf) for d in batch.column(0).to_pylist()])[row]
                        weight = np.where(toxic & (own <= 0) & (own < top), 0.0, weight)
                    a, b, c = hinge_sums(f, np.where(toxic, 1.0, -1.0), weight, w)
                    left, right, total = left + a, right + b, total + c
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((left.ravel(), right, [total]))])], names=["s"])

            got = mapped(stored_features, run, "s array<double>").toArrow()["s"].combine_chunks()
            total = got.flatten().to_numpy().reshape(len(got), -1).sum(axis=0)
            return total[: size * size].reshape(size, size), total[size * size: -1], total[-1]

        return sums

    w = np.zeros(size)
    for turn in range(PICKS):
        pick, best = (w, best_of(w)) if turn else (None, {})
        w = newton(summed(pick, best), root, np.zeros(size))

    def decisions(batches):
        for batch in batches:
            f, row = _sentences(batch)
            own = f @ w
            worst = np.full(batch.num_rows, -np.inf)
            np.maximum.at(worst, row, own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(worst), pa.array(
                np.bincount(row, own > HARMLESS, batch.num_rows))], names=["doc", "y", "weight", "n", "worst", "above"])

    docs = (mapped(stored_features, decisions, "doc long, y int, weight double, n long, worst double, above double")
            .groupBy("doc", "y", "weight").agg(F.max("worst").alias("worst"), F.sum("above").alias("above"), F.sum("n").alias("n"))
            .orderBy("doc").toArrow())  # a row for each training document
    x = document_features(*(docs[c].to_numpy() for c in ("worst", "above", "n")))
    weight = docs["weight"].to_numpy()
    curve = monotone_curve(x, docs["y"].to_numpy().astype(float), weight / weight.mean())
    return Machine(kernel, w[:-1], float(w[-1]), curve, prior)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", train_docs: int = TRAIN_DOCS, cover: int = COVER) -> Machine:
    ids = training_ids(labels, id_col, label_col, train_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    sample = stored(rows.join(F.broadcast(ids), "id")  # at most 2 * train_docs ids
                    .select("y", "weight", "t", F.monotonically_increasing_id().alias("doc")), "sample")
    total = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # with the weights: of all labelled rows
    share = ids.agg((F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("p")).first().p
    if len(total) < 2:
        prior = float(next(iter(total), 0.5))
        return Machine(None, np.zeros(0), prior=prior)

    def words_of(batches):
        for batch in slices(batches, "t"):
            w = Words.of(batch.column(2))
            text = np.searchsorted(w.first, w.sentence, "right") - 1
            pair = np.unique(text * len(w.distinct) + w.code) if len(w.code) else np.empty(0, np.int64)
            text, code = (pair // len(w.distinct), pair % len(w.distinct)) if len(pair) else (pair, pair)
            clean = [x.strip(".,;:!?'\"()") for x in w.distinct]
            starts = [list(dict.fromkeys([x[:n] for n in range(3, min(len(x), 9))] + [x])) for x in clean]
            size = np.fromiter(map(len, starts), np.int64, len(starts))
            begin = np.cumsum(size) - size
            at = np.repeat(begin[code], size[code]) + _within(size[code])
            words = np.array([x for y in starts for x in y], object)
            own = pa.array(np.repeat(text, size[code]))
            yield pa.RecordBatch.from_arrays([pa.array(words[at], pa.string()), batch.column(0).take(own), batch.column(3).take(own)],
                                             names=["w", "y", "doc"])

    # a beginning counts once for each text: several of its words can share it
    held = mapped(sample, words_of, "w string, y int, doc long").where("length(w) > 2").distinct()
    counts = stored(held.groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")), "words")
    p, q = (F.col("p") + 0.5) / (total[1] + 1), (F.col("q") + 0.5) / (total[0] + 1)
    # more of the toxic documents hold the word than chance gives the best of so many words
    share_all = (F.col("p") + F.col("q")) / (total[0] + total[1])
    spread = share_all * (1 - share_all) * (1 / total[0] + 1 / total[1])
    beyond = F.pow(F.col("p") / total[1] - F.col("q") / total[0], F.lit(2.0)) > spread * 2 * float(np.log(max(2, counts.count())))
    typical = stored(counts.withColumn("g", (p - q) * F.log(p / q)).where((p > 2 * q) & beyond).select("w", "g"), "typical")
    order = (F.desc("g"), F.desc(F.length("w")), "w")
    first = W.partitionBy("doc").orderBy(*order)
    best = (held.where("y = 1").join(typical, "w").withColumn("r", F.row_number().over(first)).where(F.col("r") <= TYPICAL)
            .groupBy("w").agg(F.max("g").alias("g"), F.collect_list("doc").alias("docs")).orderBy(*order))
    found = best.collect()  # TYPICAL words of each toxic training document
    kernel_words = choose_landmarks([r["w"] for r in found], [r["docs"] for r in found], cover)
    if not kernel_words:
        return Machine(None, np.zeros(0), prior=share)
    kernel = Kernel.build(kernel_words)
    shared = docs.sparkSession.sparkContext.broadcast(kernel)

    def features(batches):
        for batch in slices(batches, "t"):
            w = Words.of(batch.column(2))
            k = shared.value.against(w.distinct)
            begin = np.flatnonzero(np.diff(w.sentence, prepend=-1))
            for i in range(batch.num_rows):
                for a in range(w.first[i], w.first[i + 1], CHUNK):
                    b = min(a + CHUNK, w.first[i + 1])
                    f = np.zeros((b - a, k.shape[1]), np.float32)
                    here = begin[np.searchsorted(w.sentence[begin], a): np.searchsorted(w.sentence[begin], b)]
                    if len(here):
                        stop = np.searchsorted(w.sentence, b)
                        f[w.sentence[here] - a] = np.add.reduceat(k[w.code[here[0]: stop]], here - here[0], axis=0)
                    one = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([one.column(3), one.column(0), one.column(1), pa.array([b - a]),
                                                      list_array(f.ravel(), np.array([f.size]), pa.float32())],
                                                     names=["doc", "y", "weight", "n", "f"])

    kept = stored(mapped(sample, features, "doc long, y int, weight double, n long, f array<float>"), "features")
    return fit(kernel, kept, share)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, worst_sentence) for every row; sentences count from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in slices(batches, "t"):
            value, place = shared.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array(place)],
                                             names=["doc_id", "score", "worst_sentence"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return mapped(rows, run, "doc_id long, score double, worst_sentence long")
