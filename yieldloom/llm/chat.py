"""Chat formatting by a grammar round trip.

Each turn is rendered with the marks of its role, the rendered text is parsed
again by the deterministic grammar below, and a turn that does not come back
identical is rendered anew with its control strings escaped, until it does.
Formatting is row by row: a turn becomes one self-delimited segment, and the
segments of a conversation in turn order, joined, are its text. A conversation
of any length is never held in memory; the digests are running ones.

Grammar: user ``[INST]text[/INST]``, system ``<<SYS>>text<</SYS>>``, assistant
``<s>text</s>``, any other role ``[ROLE]role[/ROLE]text</s>``. A control string
inside a text gets a backslash behind its first character, one more if
backslashes are there already, so escaping can always be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SQUARE, _ANGLE = r"\\*/?(?:INST|ROLE)\]", r"\\*(?:/?s>|</?SYS>>)"
_PLAIN = re.compile(rf"\[(?={_SQUARE})|<(?={_ANGLE})")
_ESCAPED = re.compile(rf"\[\\(?={_SQUARE})|<\\(?={_ANGLE})")
_MARK = re.compile(r"<s>|</s>|\[/?INST\]|\[/?ROLE\]|<</?SYS>>")
_OPEN = {"[INST]": ("user", "[/INST]"), "<<SYS>>": ("system", "<</SYS>>"), "<s>": ("assistant", "</s>")}
_MARKS = {role: (a, b) for a, (role, b) in _OPEN.items()}


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


def render(role: str, text: str) -> str:
    if role in _MARKS:
        a, b = _MARKS[role]
        return a + text + b
    return f"[ROLE]{role}[/ROLE]{text}</s>"


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end of the text in ``formatted``) of each turn; None if it does not follow the grammar."""
    out, at = [], 0
    marks = list(_MARK.finditer(formatted))
    i = 0
    while i < len(marks):
        m = marks[i]
        if m.start() != at or i + 1 >= len(marks):
            return None
        nxt = marks[i + 1]
        if m[0] in _OPEN and nxt[0] == _OPEN[m[0]][1]:
            role, start, end, used = _OPEN[m[0]][0], m.end(), nxt, 2
        elif m[0] == "[ROLE]" and nxt[0] == "[/ROLE]" and i + 2 < len(marks) and marks[i + 2][0] == "</s>":
            role, start, end, used = unescape(formatted[m.end() : nxt.start()]), nxt.end(), marks[i + 2], 3
        else:
            return None
        out.append((role, unescape(formatted[start : end.start()]), start, end.start()))
        at, i = end.end(), i + used
    return out if at == len(formatted) else None


def format_turn(role: str, text: str) -> str:
    """Render until the parser gives the turn back; plain text stays as it is."""
    for r, t in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        formatted = render(r, t)
        back = parse(formatted)
        if back is not None and len(back) == 1 and back[0][:2] == (role, text):
            return formatted
    raise ValueError("a turn does not survive the round trip")  # the grammar excludes it


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted), one self-delimited segment per row of (conv_id, turn, role, text).

    NULL roles and texts are empty; repeated rows are turns of their own; other
    columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [format_turn(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["conv_id", "turn", "formatted"])

    src = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    return src.mapInArrow(run, "conv_id long, turn long, formatted string")


def read_chats(segments: DataFrame) -> DataFrame:
    """Parse formatted segments: conv_id, turn, role, text, loss_start, loss_end (of assistant texts, inside the segment), chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, n, f in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                for k, (role, text, start, end) in enumerate(parse(f) or ()):
                    loss = role == "assistant"
                    rows.append((c, n, role, text, start if loss else None, end if loss else None, 0 if k else len(f)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "turn", "role", "text", "loss_start", "loss_end", "chars"])

    return segments.select("conv_id", "turn", "formatted").mapInArrow(run, "conv_id long, turn long, role string, text string, loss_start long, loss_end long, chars long")


def digest_chats(parsed: DataFrame) -> DataFrame:
    """Per conversation the digests of its turns and of its loss text.

    Turns are streamed in the order (turn, role, text), NULL turns first; only
    running digests are kept, whatever the length of a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, acc = none, None

        def row():
            return (conv, acc[0], acc[1].hexdigest(), acc[2], acc[3].hexdigest(), acc[4])

        done = []
        for b in batches:
            for c, _, role, text, _, _, chars in zip(*[b.column(i).to_pylist() for i in range(7)], strict=True):
                if conv is none or c != conv:
                    if conv is not none:
                        done.append(row())
                    conv, acc = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                acc[0] += 1
                acc[1].update(f"{role}\n{text}\n".encode())
                acc[4] += chars
                if role == "assistant":
                    acc[2] += len(text)
                    acc[3].update(text.encode())
            if done:
                yield _rows(done)
                done = []
        if conv is not none:
            yield _rows([row()])

    ordered = parsed.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
