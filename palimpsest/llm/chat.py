"""Chat formatting by grammar round trips.

A turn is rendered between control strings, read again by a deterministic parser and compared with its
source; where they differ the contents are escaped and the turn is rendered anew. Turns open and
close with marks of their own, so a conversation is its turns' renderings in order and is read back in
bounded stretches, however long it is.

    user       [INST] text [/INST]
    assistant  <s>text</s>
    others     [ROLE]role[TEXT]text[/ROLE]

Escaping puts a backslash behind the first character of a control string, and one more where
there are some already; contents without such strings are never changed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USER, ASSISTANT, OTHER = ("[INST] ", " [/INST]"), ("<s>", "</s>"), ("[ROLE]", "[TEXT]", "[/ROLE]")
MARKS = re.compile(r"\[(?:/?INST|/?ROLE|TEXT)\]|</?s>")
#: A control string, or what escaping makes of one.
CONFLICT = re.compile(r"([\[<])(\\*)((?:/?INST|/?ROLE|TEXT)\]|/?s>)")
ESCAPED = re.compile(r"([\[<])\\(\\*)((?:/?INST|/?ROLE|TEXT)\]|/?s>)")
#: Characters of a conversation that are read back together.
STRETCH = 1_000_000


def escaped(text: str) -> str:
    return CONFLICT.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn, start and end where its text stands as rendered; None if it isn't of the grammar."""
    turns, at, marks = [], 0, MARKS.finditer(rendered)
    for first in marks:
        if first.start() != at:
            return None
        second = next(marks, None)
        if second is None:
            return None
        role, begin, end = first[0], first.end(), second.start()
        if role == "[INST]" and second[0] == "[/INST]" and end >= begin + 2 and rendered[begin] == " " == rendered[end - 1]:
            turns.append(("user", unescaped(rendered[begin + 1 : end - 1]), begin + 1, end - 1))
        elif role == "<s>" and second[0] == "</s>":
            turns.append(("assistant", unescaped(rendered[begin:end]), begin, end))
        elif role == "[ROLE]" and second[0] == "[TEXT]" and (third := next(marks, None)) and third[0] == "[/ROLE]":
            turns.append((unescaped(rendered[begin:end]), unescaped(rendered[second.end() : third.start()]), second.end(), third.start()))
            second = third
        else:
            return None
        at = second.end()
    return turns if at == len(rendered) else None


def _written(role: str, text: str, name: str) -> str:
    if role == "user":
        return USER[0] + text + USER[1]
    if role == "assistant":
        return ASSISTANT[0] + text + ASSISTANT[1]
    return OTHER[0] + name + OTHER[1] + text + OTHER[2]


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn's rendering and where its text stands in it; contents are escaped where the parser would tell another turn."""
    name, body = role, text
    for _ in range(2):
        rendered = _written(role, body, name)
        told = parse(rendered)
        if told and [x[:2] for x in told] == [(role, text)]:
            return rendered, *told[0][2:]
        name, body = escaped(role), escaped(text)
    raise AssertionError("an escaped turn isn't read back as it was")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, turn, role, text = (batch.column(k) for k in range(4))
        made = [render(r or "", t or "") for r, t in zip(role.to_pylist(), text.to_pylist())]
        loss = [r == "assistant" for r in role.to_pylist()]
        spans = [pa.array([m[k] if ok else None for m, ok in zip(made, loss)], pa.int64()) for k in (1, 2)]
        yield pa.RecordBatch.from_arrays([conv, turn, pa.array([m[0] for m in made], pa.string()), *spans], ["conv_id", "turn", "segment", "loss_start", "loss_end"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_end) for every row: its rendering, and which code points of it the loss mask holds (an assistant's text; else null).

    A conversation's text is its segments by turn (null turns first; equal turns by segment). A null
    text or role is empty; null ids form one conversation; repeated rows are turns each. An empty table
    gives an empty result. Other columns are not read. Rows are rendered where they are: nothing is shuffled.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_rendered, "conv_id long, turn long, segment string, loss_start long, loss_end long")


class Reading:
    """What is read back from one conversation so far."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.formatted, self.loss = conv_id, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()
        self.waiting: list[tuple[str, int | None, int | None]] = []
        self.size = 0

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        self.waiting.append((segment, start, end))
        self.size += len(segment)
        if self.size >= STRETCH:
            self.read()

    def read(self) -> None:
        text = "".join(x for x, _, _ in self.waiting)
        told = parse(text)
        if told is None:
            raise ValueError(f"conversation {self.conv_id} isn't of the grammar")
        for role, body, _, _ in told:
            self.all.update(f"{role}\n{body}\n".encode())
        at = 0
        for segment, start, end in self.waiting:
            if start is not None:
                masked = unescaped(text[at + start : at + end])
                self.loss += len(masked)
                self.masked.update(masked.encode())
            at += len(segment)
        self.turns += len(told)
        self.formatted += len(text)
        self.waiting, self.size = [], 0

    def row(self) -> tuple:
        self.read()
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.formatted


TOLD = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, (_, t) in enumerate(TOLD)], [n for n, _ in TOLD])
        done.clear()
        return out

    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in ("conv_id", "segment", "loss_start", "loss_end")}
        for conv_id, segment, start, end in zip(*columns.values()):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.row())
                now = Reading(conv_id)
            now.add(segment, start, end)
        if done:
            yield told()
    if now is not None:
        done.append(now.row())
        yield told()


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) for every conversation, parsed from its formatted text.

    Conversations are sorted, not gathered: a task streams over their segments and holds some million characters
    of one at a time. A digest is one chain, so each conversation is read by one task; rendering, the larger work, is not bound
    to conversations. Text outside the grammar raises ValueError; an empty table gives an empty result.
    """
    told = formatted.select("conv_id", "turn", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return told.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
