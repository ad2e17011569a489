"""Chats as training text: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strom.llm.shared import map_arrow, small_batches


@dataclass(frozen=True)
class Template:
    """What each role's turn looks like, which roles carry loss, and in which order roles may follow each other."""

    open: str = "<|im_start|>{role}\n"
    close: str = "<|im_end|>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    # state -> role -> next state; "" is the start
    moves: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: {
        "": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })
    final: frozenset[str] = frozenset({"assistant"})


CHATML = Template()
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    """No ``<|`` is left; each run between ``<`` and ``|`` is one backslash longer, so nothing else looks like it."""
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(text: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(text))


SEGMENTS = pa.schema([
    ("conv_id", pa.int64()), ("turn_no", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("state", pa.string()), ("valid", pa.bool_()),
])
SEGMENTS_SQL = "conv_id bigint, turn_no bigint, part int, text string, loss boolean, state string, valid boolean"


def _segments(template: Template, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, no, state, valid = object(), 0, "", True
    for batch in batches:
        out: list[tuple] = []
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if conv != current:
                current, no, state, valid = conv, 0, "", True
            following = template.moves.get(state, {}).get(role) if valid else None
            valid, state = following is not None, following if following is not None else "error"
            loss = role in template.loss_roles
            for part, piece, counts in ((0, template.open.format(role=escape_role(role or "")), False), (1, escape(text or ""), loss), (2, template.close, False)):
                out.append((conv, no, part, piece, counts, state, valid))
            no += 1
        columns = list(zip(*out)) or [()] * len(SEGMENTS)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SEGMENTS)], schema=SEGMENTS)


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """Text segments of all conversations with a loss flag each: per turn an opening, the escaped text and a closing.

    ``turns`` has conv_id, turn, role, text. A conversation's turns are ordered by turn (null first), then role, then text,
    and stream through one task in bounded memory, however long it is. The machine's state after the turn and whether all
    turns so far were allowed are in ``state`` and ``valid``; turns out of order are formatted all the same. Null text and
    null role are empty; rows without conv_id form one conversation. Repeated rows are turns of their own.
    """
    small_batches(turns.sparkSession)
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        return _segments(template, batches)

    return map_arrow(rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "role", "text"), run, SEGMENTS_SQL)


READ_SQL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, roles_valid boolean"
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                   ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("roles_valid", pa.bool_())])


class _Reader:
    """Parses one conversation's output as it comes, turn by turn."""

    def __init__(self, template: Template, conv):
        self.template, self.conv = template, conv
        self.head, self.tail = template.open.split("{role}")
        self.text = ""
        self.turns = self.chars = self.loss_chars = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.state, self.valid = "", True

    def add(self, piece: str, loss: bool, state: str, valid: bool) -> None:
        self.text += piece
        self.chars += len(piece)
        self.state, self.valid = state, valid
        if loss:
            said = unescape(piece)
            self.loss_chars += len(said)
            self.loss_hash.update(said.encode())
        while (end := self.text.find(self.template.close, len(self.head))) >= 0:
            turn, self.text = self.text[:end], self.text[end + len(self.template.close):]
            role, _, body = turn[len(self.head):].partition(self.tail)
            self.turn_hash.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
            self.turns += 1

    def row(self) -> tuple:
        return (self.conv, self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars,
                self.valid and self.state in self.template.final)


def _read(template: Template, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, done = None, []

    def flush():
        columns = list(zip(*done)) or [()] * len(_READ)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ)], schema=_READ)

    for batch in batches:
        for conv, piece, loss, state, valid in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if reader is None or conv != reader.conv:
                if reader is not None:
                    done.append(reader.row())
                reader = _Reader(template, conv)
            reader.add(piece, loss, state, valid)
        yield flush()
    if reader is not None:
        done.append(reader.row())
        yield flush()


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """Per conversation what the output itself says: the segments are joined, cut at the template's marks and unescaped."""
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "part").select("conv_id", "text", "loss", "state", "valid")

    def run(batches):
        return _read(template, batches)

    return map_arrow(rows, run, READ_SQL)
