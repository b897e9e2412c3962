"""Chat turns as marked text that parses back to the same turns.

A turn is ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end. The
parser is deterministic: a marker inside a role or text is an error, and a
backslash run between ``<`` and ``|`` loses one backslash. Each turn is rendered as it
is, parsed, and compared with its source; if they differ, the conflicting part is
escaped (one more backslash between ``<`` and ``|``) and compared again.

Turns are rendered one by one, so one endless conversation does not gather
anywhere; the rendered turns of a conversation, in order, are its text, and parse
on their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from demandloom.llm.common import slices

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
_ESCAPE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\+)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"<\\{m[1]}|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1][1:]}|", text)


def escape_role(role: str) -> str:
    """A role is one line: a line end and the backslash are written with a backslash."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """``(role, text, start, end)`` of each turn, start and end of its written text; None if it is no chat text."""
    turns, at = [], 0
    while at < len(text):
        head = text.find("\n", at)
        stop = text.find(END, head)
        if not text.startswith(START, at) or head < 0 or stop < 0 or not text.startswith("\n", stop + len(END)):
            return None
        role, body = text[at + len(START) : head], text[head + 1 : stop]
        if START in role or END in role or START in body:
            return None
        turns.append((unescape_role(role), unescape(body), head + 1, stop))
        at = stop + len(END) + 1
    return turns


def render(role: str | None, text: str | None) -> str:
    """One turn, escaped only where it would not parse back otherwise. Null role and text are empty."""
    role, text = role or "", text or ""
    for own_role in (role, escape_role(role)):
        for own_text in (text, escape(text)):
            written = f"{START}{own_role}\n{own_text}{END}\n"
            turns = parse(written)
            if turns is not None and [turn[:2] for turn in turns] == [(role, text)]:
                return written
    raise ValueError("a turn cannot be written so that it parses back")


def format_turns(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``(conv_id, turn, role, text, formatted)``: every turn and its rendered text.

    Null roles and texts are empty. Repeated rows are further turns, an empty table
    gives an empty table, and further columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 3):
            written = [render(*turn) for turn in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(written, pa.string())], names=[*part.schema.names, "formatted"]
            )

    names = {conv_col: "conv_id", turn_col: "turn", role_col: "role", text_col: "text"}
    rows = conversations.select(*(F.col(own).alias(name) for own, name in names.items()))
    kinds = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in rows.schema)
    return rows.mapInArrow(each, f"{kinds}, formatted string")


def loss_spans(turns: Iterable[tuple[str, str, int, int]]) -> list[tuple[int, int]]:
    """The ranges of written text that a model learns from."""
    return [(start, end) for role, _, start, end in turns if role == LEARNED]


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.learned = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        turns = parse(formatted)
        for role, text, _, _ in turns:
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        for start, end in loss_spans(turns):
            text = unescape(formatted[start:end])
            self.learned += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation of :func:`format_turns`, read back from the rendered text: ``conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Turns go by ``turn`` (null first), then role and text. A digest reads the turns one
    after the other, so a conversation is one stream through one task, of which one
    turn is in memory at a time. Rows of a null conversation are one conversation.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = None, []
        for part in slices(batches, 1):
            for conv_id, formatted in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if own is None or own.conv_id != conv_id:
                    if own:
                        done.append(own.row())
                    own = _Digest(conv_id)
                own.add(formatted)
            if len(done) > 1000:
                yield _digest_batch(done, kind)
                done = []
        if own:
            done.append(own.row())
        if done:
            yield _digest_batch(done, kind)

    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = ordered.select("conv_id", "formatted")
    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    return rows.mapInArrow(each, schema)


def _digest_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
