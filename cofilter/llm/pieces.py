"""SentencePiece encoding and decoding over a relational lattice.

A text, with a space in front, is cut into units where no piece of the table can
cross (a piece never goes from a letter to a full stop, say), so the best path of a
text is that of its units. Distinct units are few beside their
occurrences, so only they are segmented: every substring up to the longest piece
is joined to the piece table by a hash, the edges are held by unit and place, and
a fold from left to right keeps the best path to every place (Viterbi). Units up to
``IN_STEP`` characters are folded many at once; longer ones (unspaced scripts, rulers,
encoded data) one by one in windows, which hand the best scores of their last places
on. A
character without a piece becomes its UTF-8 byte pieces. Ties go to the longer
piece. The lattice runs on arrays inside the tasks; as rows of Spark tables with
a higher-order ``aggregate`` the same work took over twice its budget (README).

Scores are the logarithms of the pieces' ranks, -ln(1 + rank): the table given
here is ranked by merges, and sums of raw ranks would prefer many common pieces
to one rarer piece.

Documents travel in blocks of about ``BLOCK_CHARS`` characters. A block's distinct
units go to the bucket of their checksum, about ``UNIT_CHARS`` characters of text
each, where every unit is segmented once, and come back to the block; no
occurrence is ever shuffled, and a block has a row only for a bucket it fills. A block is named by a digest of its texts, so the
two passes that build it agree; a unit without its segmentation is an error.

Null texts have null pieces, empty texts none. Decoding is exact for every text,
literal U+2581 characters included. Rows repeat as they come, null ids included;
an empty table gives none. Columns named like the outputs are replaced."""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.llm.common import WORD_BASE, hand_back, powers, mapped, mix64

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_CHARS = 16 << 20
UNIT_CHARS = 16 << 20  # of text for each bucket of units
IN_STEP = 64
WINDOW = 1 << 14  # characters of a long unit folded at once
IN_TURN = 1 << 17  # units of a block whose ids are put together at once


@dataclass
class Pieces:
    """A piece table: text (a space for the space mark), id and score; byte pieces by byte."""

    text: list[str]
    ids: list[int]
    score: list[float]
    byte_ids: list[int]
    byte_score: float

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        text, ids, score, byte_ids = [], [], [], [0] * 256
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(p[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text.append(p.replace("▁", " "))
                ids.append(i)
                score.append(-math.log1p(max(0.0, -model.get_score(i))))
        return Pieces(text, ids, score, byte_ids, min(score) - 1.0)

    def cutter(self) -> Cutter:
        inside = np.zeros((4, 4), bool)
        for p in self.text:
            k = [_kind(c) for c in p]
            inside[k[:-1], k[1:]] = True
        return Cutter(inside)


def _kind(c: str) -> int:
    return 0 if c == " " else 1 if c.isalpha() else 2 if c.isdigit() else 3


_KINDS: dict[str, np.ndarray] = {}


@dataclass
class Cutter:
    """Cuts texts where the kinds of two neighbours never meet inside a piece."""

    inside: np.ndarray

    def units(self, text: str) -> list[str]:
        if "kind" not in _KINDS:
            _KINDS["kind"] = np.array([_kind(chr(c)) for c in range(0x110000)], np.int8)
        text = " " + text
        kind = _KINDS["kind"][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cut = np.flatnonzero(~self.inside[kind[:-1], kind[1:]]) + 1
        edge = [0, *cut.tolist(), len(text)]
        return [text[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Consecutive rows of about BLOCK_CHARS characters, with a digest of their texts (the first column)."""
    held, size, name = [], 0, hashlib.blake2b(digest_size=8)
    for batch in batches:
        begin = 0
        for i, t in enumerate(batch.column(0)):
            t = t.as_py()
            size += len(t or "")
            name.update(b"\0" if t is None else b"\1" + t.encode())
            if size >= BLOCK_CHARS:
                held.append(batch.slice(begin, i + 1 - begin))
                yield int.from_bytes(name.digest(), "little", signed=True), held
                held, size, name, begin = [], 0, hashlib.blake2b(digest_size=8), i + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield int.from_bytes(name.digest(), "little", signed=True), held


def _distinct(parts: list[pa.RecordBatch], cutter: Cutter, buckets: int) -> dict[int, list[str]]:
    """The distinct units of a block, sorted, by bucket of their checksum; buckets that it fills."""
    found: set[str] = set()
    for part in parts:
        for t in part.column(0):
            if t := t.as_py():
                found.update(cutter.units(t))
    return _by_bucket(found, buckets)


def _by_bucket(units: Iterable[str], buckets: int) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for u in sorted(units):
        out.setdefault(zlib.crc32(u.encode("utf-8", "surrogatepass")) % buckets, []).append(u)
    return out


class _Places(dict):
    """Numbers keys as they first come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _coded(parts: list[pa.RecordBatch], cutter: Cutter) -> tuple[dict[str, int], list[tuple[np.ndarray, np.ndarray]]]:
    """The place of each distinct unit of a block, and for each part the places of all its
    units and their number by text. Every text is cut once."""
    place = _Places()
    out = []
    for part in parts:
        codes, counts = array("i"), []
        for t in part.column(0):
            own = cutter.units(t) if (t := t.as_py()) else []
            codes.extend(map(place.__getitem__, own))
            counts.append(len(own))
        out.append((np.frombuffer(codes, np.int32) if codes else np.empty(0, np.int32), np.array(counts, np.int64)))
    return place, out


def _joined(codes: np.ndarray, counts: np.ndarray, size: np.ndarray, begin: np.ndarray,
            pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a part, from where those of each distinct unit begin in
    ``pool``, and the offsets of the texts; ``IN_TURN`` units at a time."""
    upto = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(size[codes], out=upto[1:])
    ids = np.empty(upto[-1], np.int32)
    for at in range(0, len(codes), IN_TURN):
        some = codes[at: at + IN_TURN]
        first, last = int(upto[at]), int(upto[at + len(some)])
        ids[first:last] = pool[np.repeat(begin[some] - upto[at: at + len(some)], size[some]) + np.arange(first, last)]
    return ids, upto[np.concatenate(([0], np.cumsum(counts)))]


class Lattice:
    """Best segmentations of many units at once."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.longest = max(map(len, pieces.text))
        self.bytes = np.array(pieces.byte_ids, np.int32)
        self.by_text: dict[str, int] = {}
        size = max(1 << 16, sum(map(len, pieces.text)))
        self.up = powers(size, int(WORD_BASE))
        self.down = powers(size, pow(int(WORD_BASE), -1, 1 << 64))
        code, start, size = _codes(pieces.text)
        key = self._hash(code, start, size)
        order = np.argsort(key)
        self.key, self.size = key[order], size[order]
        self.ids, self.score = np.array(pieces.ids, np.int32)[order], np.array(pieces.score)[order]

    def _hash(self, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Polynomial hashes of substrings, all from one array of prefix sums."""
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * self.up[: len(code)], out=total[1:])
        return mix64((total[start + size] - total[start]) * self.down[start] + size.astype(np.uint64))

    def edges(self, code: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id by length and start: every substring up to the longest piece,
        joined to the piece table; ``room`` is what is left of the unit at each start."""
        n = len(code)
        score = np.full((self.longest + 1, n), -np.inf)
        ids = np.full((self.longest + 1, n), -1, np.int32)
        for size in range(1, self.longest + 1):
            at = np.flatnonzero(room >= size)
            if not len(at):
                break
            key = self._hash(code, at, np.full(len(at), size))
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = (self.key[place] == key) & (self.size[place] == size)
            score[size, at[hit]], ids[size, at[hit]] = self.score[place[hit]], self.ids[place[hit]]
        lone = ids[1] < 0  # no piece for the character: its bytes
        width = 1 + (code > 0x7F).astype(int) + (code > 0x7FF) + (code > 0xFFFF)
        score[1, lone] = self.p.byte_score * width[lone]
        return score, ids

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in one array, and their number by unit."""
        flat, sizes = [], []
        part, held = [], 0
        for u in [*units, None]:
            if part and (u is None or held + len(u) > 1 << 16 or len(u) > IN_STEP):
                ids, size = self._segment(part)
                flat.append(ids)
                sizes.append(size)
                part, held = [], 0
            if u is not None and len(u) > IN_STEP:
                flat.append(self._long(u))
                sizes.append(np.array([len(flat[-1])]))
            elif u is not None:
                part.append(u)
                held += len(u)
        return (np.concatenate(flat), np.concatenate(sizes)) if flat else (np.empty(0, np.int32), np.empty(0, np.int64))

    def _long(self, unit: str, window: int | None = None) -> np.ndarray:
        """Ids of a long unit: the fold in windows. The scores of the places that a window's
        pieces reach beyond it go on to the next one."""
        window = window or WINDOW
        code, n = _codes([unit])[0], len(unit)
        by = np.zeros(n + 1, np.int32)
        reach = self.longest
        best = [0.0] + [-math.inf] * (window + reach)
        for w in range(0, n, window):
            part = code[w: w + window + reach]
            score, _ = self.edges(part, np.minimum(n - w, len(part)) - np.arange(len(part)))
            count = min(window, n - w)
            rows, back = score[:, :count].T.tolist(), [0] * (count + reach + 1)
            for s, row in enumerate(rows):
                here = best[s]
                for size in range(1, reach + 1):
                    # places are reached by longer pieces first, so ties go to them
                    if row[size] > -math.inf and here + row[size] > best[s + size]:
                        best[s + size], back[s + size] = here + row[size], size
            own = np.array(back[1:], np.int32)[: n - w]
            by[w + 1: w + 1 + len(own)] = np.where(own > 0, own, by[w + 1: w + 1 + len(own)])
            best = best[count: count + reach + 1] + [-math.inf] * window
        if not self.by_text:
            self.by_text.update(zip(self.p.text, self.p.ids, strict=True))
        out, at = [], n
        while at:
            piece = unit[at - by[at]: at]
            own = self.by_text.get(piece)
            out.append([own] if own is not None else self.bytes[np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8)].tolist())
            at -= by[at]
        return np.array([i for ids in reversed(out) for i in ids], np.int32)

    def _segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        code, start, length = _codes(units)
        room = np.repeat(start + length, length) - np.arange(len(code))
        score, ids = self.edges(code, room)
        # fold from left to right, all units in step; a node stands before each character and at each end
        node = start + np.arange(len(units))
        best = np.full(len(code) + len(units), -np.inf)
        best[node] = 0
        back = np.zeros(len(best), np.int16)
        order = np.argsort(-length, kind="stable")
        live = np.searchsorted(-length[order], -np.arange(length.max(initial=0) + 1), "right")
        for t in range(1, len(live)):
            who = order[: live[t]]
            top, by = np.full(len(who), -np.inf), np.zeros(len(who), np.int16)
            for size in range(min(t, self.longest), 0, -1):
                value = best[node[who] + t - size] + score[size, start[who] + t - size]
                better = value > top
                top[better], by[better] = value[better], size
            best[node[who] + t], back[node[who] + t] = top, by
        # walk back, marking where the pieces of the best path start
        used = np.zeros(len(code), np.int16)
        who, at = np.arange(len(units)), length.copy()
        while len(who):
            size = back[node[who] + at[who]]
            at[who] -= size
            used[start[who] + at[who]] = size
            who = who[at[who] > 0]
        place = np.flatnonzero(used)
        unit = np.repeat(np.arange(len(units)), length)[place]
        own = ids[used[place], place]
        lone = np.flatnonzero(own < 0)
        if not len(lone):
            return own, np.bincount(unit, minlength=len(units))
        spelled = [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8) for c in code[place[lone]].tolist()]
        width = np.ones(len(own), np.int64)
        width[lone] = [len(b) for b in spelled]
        out = np.repeat(own, width)
        out[np.repeat(own < 0, width)] = self.bytes[np.concatenate(spelled)]
        return out, np.bincount(unit, width, len(units)).astype(np.int64)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return code, np.cumsum(size) - size, size


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``ids``, the piece ids of the text."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    rows = docs.select(F.col(f"`{text_col}`").alias("_t"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)])
    cutter = pieces.cutter()
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    text = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    buckets = max(1, int(text // UNIT_CHARS) + 1)

    def units_of(batches):
        for name, parts in _blocks(batches):
            units = _distinct(parts, cutter, buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(units), pa.int64()), pa.array(list(units), pa.int32()),
                 pa.array(list(units.values()), pa.list_(pa.string()))], names=["block", "bucket", "units"])

    def segmented(group: pa.Table) -> pa.Table:
        out = segment_all(group)
        hand_back()
        return out

    def segment_all(group: pa.Table) -> pa.Table:
        # blocks share units: only the distinct ones become strings
        coded = group["units"].combine_chunks().flatten().dictionary_encode()
        ids, size = Lattice(shared.value).segment(coded.dictionary.to_pylist())
        begin = np.cumsum(size) - size
        index, out = coded.indices.to_numpy(), []
        stop = np.cumsum(pa.compute.list_value_length(group["units"]).to_numpy())
        for a, b in zip(np.concatenate(([0], stop[:-1])).tolist(), stop.tolist(), strict=True):
            own = size[index[a:b]]
            at = np.repeat(begin[index[a:b]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            out.append((own.astype(np.int32).tobytes(), ids[at].astype(np.int32).tobytes()))
        return pa.table({"block": group["block"], "bucket": group["bucket"], "size": pa.array([x for x, _ in out], pa.binary()),
                         "ids": pa.array([x for _, x in out], pa.binary())})

    def payload(batches):
        codec = pa.Codec("zstd", compression_level=3)
        for name, parts in _blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema) as out:
                for p in parts:
                    out.write_batch(p)
            raw = sink.getvalue()
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([raw.size], pa.int64()),
                                              pa.array([codec.compress(raw, asbytes=True)], pa.binary())],
                                             names=["block", "size", "blob"])

    done = (mapped(rows.select("_t"), units_of, "block long, bucket int, units array<string>").groupBy("bucket")
            .applyInArrow(segmented, "block long, bucket int, size binary, ids binary"))
    fields = [f"_c{i}" for i in range(len(kept))]

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        out = put_together(left, right)
        hand_back()
        return out

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {b: (np.frombuffer(s, np.int32), np.frombuffer(i, np.int32)) for b, s, i in zip(
            right["bucket"].to_pylist(), right["size"].to_pylist(), right["ids"].to_pylist(), strict=True)}
        size, out = None, []
        for raw, blob in zip(left["size"].to_pylist(), left["blob"], strict=True):
            parts = list(pa.ipc.open_stream(pa.Codec("zstd").decompress(blob.as_buffer(), raw)))
            place, coded = _coded(parts, cutter)
            if size is None:  # blocks of one name have the same texts, so the same places
                size, own_ids = np.empty(len(place), np.int32), [np.empty(0, np.int32)]
                begin, at = np.empty(len(place), np.int64), 0
                for bucket, units in _by_bucket(place, buckets).items():
                    sizes, ids = found[bucket]
                    if len(sizes) != len(units):
                        raise ValueError("a unit without its segmentation")
                    own = np.array([place[u] for u in units], np.int64)
                    size[own], begin[own] = sizes, at + np.cumsum(sizes, dtype=np.int64) - sizes
                    at += len(ids)
                    own_ids.append(ids)
                pool = np.concatenate(own_ids)
                del own_ids, found
            del place
            for p, (codes, counts) in zip(parts, coded, strict=True):
                ids, offsets = _joined(codes, counts, size, begin, pool)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=p.column(0).is_null())
                out.append(pa.Table.from_arrays([*p.columns[1:], lists], names=[*fields, "ids"]))
        return pa.concat_tables(out)

    schema = ", ".join([f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] + ["ids array<int>"])
    full = (mapped(rows, payload, "block long, size long, blob binary").groupBy("block")
            .cogroup(done.groupBy("block")).applyInArrow(assemble, schema))
    return full.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], "ids")


def decode_ids(ids: list[int], table: list[bytes]) -> str:
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:]


def decode(df: DataFrame, pieces: Pieces, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its piece ids; null for null, control pieces are nothing."""
    kept = [c for c in df.columns if c != out]
    size = max([*pieces.ids, *pieces.byte_ids], default=0) + 1
    table = [b""] * size
    for i, t in zip(pieces.ids, pieces.text, strict=True):
        table[i] = t.encode()
    for b, i in enumerate(pieces.byte_ids):
        table[i] = bytes([b])
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, at = part.column(0), part.column(0).offsets.to_numpy().tolist()
                flat = ids.values.to_numpy()
                texts = [decode_ids(flat[a:b].tolist(), shared.value) if ok else None
                         for a, b, ok in zip(at[:-1], at[1:], ids.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())],
                                                 names=[f"_c{i}" for i in range(len(kept))] + [out])

    schema = ", ".join([f"_c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] + [f"{out} string"])
    rows = df.select(F.col(f"`{ids_col}`").alias("_i"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)])
    return mapped(rows, run, schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], out)
