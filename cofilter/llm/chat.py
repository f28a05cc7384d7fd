"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one text: for each turn, by ``turn``, the start
mark, the role, a line feed, the text, the end mark and a line feed. The two marks
are special tokens of the tokenizer; inside roles and texts anything that could
be one is escaped reversibly (a backslash goes between ``<`` and ``|``, one more
where there are some), so marks always are marks. The rendering is encoded once,
with offsets; the spans of the assistant's texts and the tokens' spans are both
sorted, so binary search finds the tokens under each turn. The mask is kept by
token (any overlap) and as character spans, tokens clipped to their turn: a token
that begins in the mark's line feed counts for the text's part only.

Rows of a conversation come together by one shuffle and are sorted in it; a
task holds one conversation at a time, in blocks of whole turns of about
``BLOCK_CHARS`` characters. Marks split a text before it is encoded, so blocks have
the same tokens as the whole. A conversation however long needs the memory of one
block (or of its longest turn); positions are relative to their block.

Null texts and roles are empty. Rows with equal turns come by role, then text;
null turns first; null conversation ids are one conversation; repeated rows are
turns like others. An empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.llm.common import mapped

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
BLOCK_CHARS = 1 << 20

_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Also on one line: a line feed becomes backslash n, a backslash two."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns, and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        parts += [head, body, END + "\n"]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """By token whether it overlaps one of the spans, and the stretches of
    characters that tokens cover within each span. All spans are sorted."""
    under = np.zeros(len(starts), bool)
    covered = []
    for a, b in spans:
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        if i >= j:
            continue
        under[i:j] = True
        s, e = np.maximum(starts[i:j], a), np.minimum(ends[i:j], b)
        reach = np.maximum.accumulate(e)
        gap = np.flatnonzero(s[1:] > reach[:-1])  # the bytes of one character share its span
        covered += zip(s[np.concatenate(([0], gap + 1))].tolist(),
                       reach[np.concatenate((gap, [len(reach) - 1]))].tolist(), strict=True)
    return under, covered


def load_tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(START, special=True, normalized=False), AddedToken(END, special=True, normalized=False)])
    return t


FIELDS = ("conv_id long, block int, n_turns long, formatted string, ids array<int>, token_starts array<int>, "
          "token_ends array<int>, loss_mask array<boolean>, loss_spans array<struct<start: int, end: int>>")


def format_conversations(rows: DataFrame, tokenizer: str = TOKENIZER, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", loss_role: str = LOSS_ROLE,
                         block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Conversations in blocks: formatted text, token ids with their spans, loss mask
    by token and as character spans. Blocks of a conversation follow each other in
    one partition."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()),
             pa.list_(pa.int32()), pa.list_(pa.bool_()), kind]
    names = ["conv_id", "block", "n_turns", "formatted", "ids", "token_starts", "token_ends", "loss_mask", "loss_spans"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list[tuple[str, str]]]]:
        now, number, turns, size = None, 0, [], 0
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns and (conv != now or size >= block_chars):
                    yield now, number, turns
                    number, turns, size = number + 1 if conv == now else 0, [], 0
                now = conv
                turns.append((role, text))
                size += len(text)
        if turns:
            yield now, number, turns

    def run(batches):
        coder = load_tokenizer(tokenizer)
        out, held = [], 0

        def flush():
            texts = [render(turns) for _, _, turns in out]
            encoded = coder.encode_batch([t for t, _ in texts], add_special_tokens=False)
            rows = []
            for (conv, number, turns), (text, spans), code in zip(out, texts, encoded, strict=True):
                span = np.array(code.offsets, np.int32).reshape(-1, 2)
                own = [s for s, (role, _) in zip(spans, turns, strict=True) if role == loss_role and s[0] < s[1]]
                under, covered = mask(span[:, 0], span[:, 1], own)
                rows.append((conv, number, len(turns), text, np.array(code.ids, np.int32), span[:, 0], span[:, 1], under,
                             [{"start": a, "end": b} for a, b in covered]))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types,
                                                                                 strict=True)], names=names)

        for block in blocks(batches):
            out.append(block)
            held += sum(len(t) for _, t in block[2])
            if held >= block_chars or len(out) >= 512:
                yield flush()
                out, held = [], 0
        if out:
            yield flush()

    turns = rows.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("n"),
                        F.coalesce(role_col, F.lit("")).alias("r"), F.coalesce(text_col, F.lit("")).alias("t"))
    ordered = turns.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t")
    return mapped(ordered, run, FIELDS)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars),
    all from the formatted text and its loss spans. Reads blocks in the order
    ``format_conversations`` gives them."""

    def run(batches):
        now, state = None, None

        def row():
            n, turns, chars, loss, size = state
            return (now, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        for batch in batches:
            out = []
            for conv, number, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number == 0:
                    if state:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_turns(text)
                state[0] += len(turns)
                for role, body in turns:
                    state[1].update(f"{role}\n{body}\n".encode())
                for s in spans:
                    part = unescape(text[s["start"]: s["end"]])
                    state[2] += len(part)
                    state[3].update(part.encode())
                state[4] += len(text)
            yield _rows(out)
        if state:
            yield _rows([row()])

    return mapped(formatted.select("conv_id", "block", "formatted", "loss_spans"), run,
                  "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                                      names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                             "formatted_chars"])
