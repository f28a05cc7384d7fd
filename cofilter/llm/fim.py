"""Fill-in-middle transformation by displacement scatter.

The texts of a batch are one array of bytes. Code points are counted in windows, so
both cuts of every text become byte positions. Prefix, middle and suffix then each
move by one distance: a difference array holds the change of that distance where a
part begins, its cumulative sum gives every byte its output position, and one numpy
scatter builds all outputs. Restoring finds the three marks, builds the same kind of
array over the restored bytes and gathers. Nothing but the batch, its output and one
window of positions is in memory, so a very long text costs twice its size.

A text that is empty or contains a mark stays plain, so each mark stands exactly once
in any other output (no mark can begin inside another or across a part's end).

Null texts count as empty, a null id hashes as an empty one. Rows are independent:
repeated ids and texts are transformed alike, and each row gives one row. Other
columns go unless named in ``keep``. An empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.llm.common import mapped, slices

FIM_PERCENT = 90
SPM_PERCENT = 20
SALT = "1:"
WINDOW = 1 << 20
# fixed values: the marks before prefix, suffix and middle
MARKS = (b"<P>", b"<S>", b"<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row begins (and the end); null is empty."""
    column = pc.fill_null(column, "")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]: ends[-1]]
    return data, ends - ends[0]


def strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data))


class CodePoints:
    """Code points of a byte array, counted by windows: which is at a byte, and where is the k-th."""

    def __init__(self, data: np.ndarray, window: int):
        self.data, self.window = data, window
        counts = [np.count_nonzero(self._begins(w)) for w in range(-(-len(data) // window))]
        self.before = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))

    def _begins(self, w: int) -> np.ndarray:
        return (self.data[w * self.window: (w + 1) * self.window] & 0xC0) != 0x80

    def _by_window(self, at: np.ndarray, values: np.ndarray, answer) -> np.ndarray:
        out = np.empty(len(values), np.int64)
        order = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[order], prepend=-1))
        for i, j in zip(edges, [*edges[1:], len(order)], strict=True):
            w = int(at[order[i]])
            out[order[i:j]] = answer(w, np.flatnonzero(self._begins(w)), values[order[i:j]])
        return out

    def count_before(self, byte: np.ndarray) -> np.ndarray:
        return self._by_window(byte // self.window, byte, lambda w, begins, v: self.before[min(w, len(self.before) - 1)]
                               + np.searchsorted(begins, v - w * self.window))

    def byte_of(self, k: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.before, k, "right") - 1
        return self._by_window(at, k, lambda w, begins, v: w * self.window + begins[v - self.before[w]]
                               if len(begins) else np.full(len(v), len(self.data)))


def displacements(begin: np.ndarray, target: np.ndarray, size: int, window: int):
    """For parts that begin at ``begin`` (ascending) and go to ``target``: windows
    (first byte, position of each byte in the target), from a difference array."""
    shift = target - begin
    step = np.diff(shift, prepend=0)
    held = 0
    for w in range(0, size, window):
        change = np.zeros(min(window, size - w), np.int64)
        i, j = np.searchsorted(begin, (w, w + len(change)))
        np.add.at(change, begin[i:j] - w, step[i:j])
        change[0] += held
        moved = np.cumsum(change)
        held = int(moved[-1])
        yield w, moved + np.arange(w, w + len(moved))


def marks_at(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, byte, which of ``MARKS``) of every mark that lies within a row."""
    found = []
    for w in range(0, len(data), window):
        d = data[w: w + window + 2]
        at = np.flatnonzero((d[:-2] == 0x3C) & (d[2:] == 0x3E)) if len(d) > 2 else np.empty(0, np.int64)
        found.append(at[np.isin(d[at + 1], [m[1] for m in MARKS])] + w)
    at = np.concatenate(found) if found else np.empty(0, np.int64)
    row = np.searchsorted(ends, at, "right") - 1
    inside = at + 3 <= ends[row + 1] if len(at) else np.empty(0, bool)
    at, row = at[inside], row[inside]
    which = np.searchsorted(np.sort([m[1] for m in MARKS]), data[at + 1]) if len(at) else at
    return row, at, np.argsort([m[1] for m in MARKS])[which] if len(at) else at


def _layout(form: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts (prefix, middle, suffix; columns of ``size``) and the marks of
    each row go, for rows whose output begins at ``begin``."""
    p, m, s = size.T
    parts = np.stack([begin, begin + p, begin + p + m], axis=1)
    marks = np.zeros_like(parts)
    psm, spm = form == PSM, form == SPM
    parts[psm] = np.stack([begin + 3, begin + 9 + p + s, begin + 6 + p], axis=1)[psm]
    parts[spm] = np.stack([begin + 6 + s, begin + 9 + s + p, begin + 3], axis=1)[spm]
    marks[:, 0], marks[:, 1], marks[:, 2] = parts[:, 0] - 3, parts[:, 2] - 3, parts[:, 1] - 3
    return parts, marks


def form_batch(data: np.ndarray, ends: np.ndarray, h: np.ndarray, fim_percent: int, spm_percent: int,
               window: int = WINDOW) -> dict[str, np.ndarray]:
    """Forms, counts and outputs of a batch of texts; ``h``: four hash values a row."""
    points = CodePoints(data, window)
    first = points.count_before(ends)
    n = np.diff(first)
    cut = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    middle = points.byte_of(first[:-1] + cut[:, 0])
    suffix = points.byte_of(first[:-1] + cut[:, 1])
    form = np.where(h[:, 3] % 100 < spm_percent, SPM, PSM).astype(object)
    form[(n == 0) | (h[:, 2] % 100 >= fim_percent)] = PLAIN
    form[marks_at(data, ends, window)[0]] = PLAIN
    own = form != PLAIN
    out_ends = np.concatenate(([0], np.cumsum(np.diff(ends) + 9 * own)))
    source = np.stack([ends[:-1], middle, suffix], axis=1)
    size = np.stack([middle - ends[:-1], suffix - middle, ends[1:] - suffix], axis=1)
    parts, marks = _layout(form, out_ends[:-1], size)
    out = np.empty(out_ends[-1], np.uint8)
    for w, position in displacements(source.ravel(), parts.ravel(), len(data), window):
        out[position] = data[w: w + len(position)]
    for j, mark in enumerate(MARKS):
        out[marks[own, j, None] + np.arange(3)] = np.frombuffer(mark, np.uint8)
    return {"n": n, "form": form, "cut": cut, "out": out, "ends": out_ends}


def restore_batch(data: np.ndarray, ends: np.ndarray, form: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The texts (bytes, ends) behind a batch of outputs, from outputs and forms alone."""
    own = form != PLAIN
    row, at, which = marks_at(data, ends, window)
    row, at, which = (x[own[row]] for x in (row, at, which))
    count = np.bincount(row, minlength=len(form))
    place = np.zeros((len(form), 3), np.int64)
    place[row, which] = at
    order = np.where((form == PSM)[:, None], place[:, [0, 1, 2]], place[:, [1, 0, 2]])
    if (count[own] != 3).any() or (np.diff(order[own], axis=1) <= 0).any() or (order[own, 0] != ends[:-1][own]).any():
        raise ValueError("an output does not hold its three marks")
    source = np.repeat(ends[:-1, None], 3, axis=1)
    size = np.zeros_like(source)
    size[:, 0] = np.diff(ends)
    stop = np.stack([order[:, 1], order[:, 2], ends[1:]], axis=1)
    length = stop - order - 3  # of the three stretches, as they stand
    psm, spm = form == PSM, form == SPM
    for rows, as_placed in ((psm, [0, 2, 1]), (spm, [1, 2, 0])):  # prefix, middle, suffix
        source[rows] = order[rows][:, as_placed] + 3
        size[rows] = length[rows][:, as_placed]
    out_ends = np.concatenate(([0], np.cumsum(size.sum(axis=1))))
    begin = out_ends[:-1, None] + np.cumsum(size, axis=1) - size
    out = np.empty(out_ends[-1], np.uint8)
    for w, position in displacements(begin.ravel(), source.ravel(), len(out), window):
        out[w: w + len(position)] = data[position]
    return out, out_ends


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (),
              fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, salt: str = SALT) -> DataFrame:
    """(``keep`` columns, n, form, prefix_chars, middle_chars, output) for every row."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    seeds = [F.conv(F.substring("_d", 8 * j + 1, 8), 16, 10).cast("long").alias(f"_h{j}") for j in range(4)]
    rows = (docs.select(*keep, digest.alias("_d"), F.col(text_col).cast("string").alias("_t"))
            .select(*keep, *seeds, "_t"))
    kept = len(keep)
    new = "n long, form string, prefix_chars long, middle_chars long, output string"
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), new])

    def run(batches):
        for batch in slices(batches, "_t"):
            h = np.stack([batch.column(kept + j).to_numpy() for j in range(4)], axis=1)
            data, ends = flat(batch.column(kept + 4))
            r = form_batch(data, ends, h, fim_percent, spm_percent)
            plain = r["form"] == PLAIN
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:kept], pa.array(r["n"]), pa.array(r["form"], pa.string()),
                pa.array(r["cut"][:, 0], pa.int64(), mask=plain),
                pa.array(r["cut"][:, 1] - r["cut"][:, 0], pa.int64(), mask=plain), strings(r["out"], r["ends"]),
            ], names=[*batch.schema.names[:kept], "n", "form", "prefix_chars", "middle_chars", "output"])

    return mapped(rows, run, schema)


def restore(formed: DataFrame) -> DataFrame:
    """The rows of ``formed`` with the text behind each output as ``restored``, from
    ``output`` and ``form`` alone. An output without its marks is an error."""
    names = formed.columns
    form_at, out_at = names.index("form"), names.index("output")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formed.schema) + ", restored string"

    def run(batches):
        for batch in slices(batches, "output"):
            form = np.array(batch.column(form_at).to_pylist(), object)
            data, ends = restore_batch(*flat(batch.column(out_at)), form)
            yield pa.RecordBatch.from_arrays([*batch.columns, strings(data, ends)], names=[*names, "restored"])

    return mapped(formed, run, schema)
