r"""Chat formatting: a state machine over roles checks the order of turns; a declarative template turns each into text segments with loss flags.

A template names, for each role, the text before and after its turns, whether the turn's text counts for the loss, and the roles that may
follow. Control strings inside roles and texts are escaped: backslashes are doubled, and a backslash goes in after the first character of
every control string, wherever it begins. A lone backslash is therefore always one that was put in, and reading back is exact.

Texts are escaped and put into their template where they are read. Then a conversation's turns are dealt to one task in sorted order and
streamed: the task holds one batch and the machine's state, however long the conversation is. The digests below are of whole conversations
in order, so one conversation can't be spread over tasks; they come from reading the formatted text back, by its turn marks alone.

Defined cases: null roles and texts are empty. Rows are ordered by turn (nulls first), then role and text, so ties and repeated rows have
one order; a repeated row is a turn of its own. Null ids make one conversation. A turn out of order is still formatted and says so in
`error`. Roles that the template lacks use its form for other roles and are out of order everywhere. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "start", "end"


@dataclass(frozen=True)
class Form:
    """Text around a turn; `{role}` in `before` is the escaped role."""

    before: str
    after: str
    loss: bool = False
    then: tuple[str, ...] = ()


class Reader:
    """Reads formatted text back, in pieces of any size: turns are found by the marks around them, which no escaped text holds."""

    def __init__(self, template: Template):
        forms = [(role, f.before, f.after, "") for role, f in template.roles.items()]
        head, tail = template.other.before.split("{role}")
        self._forms, self._held, self._unescape = [*forms, (None, head, template.other.after, tail)], "", template.unescape

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """Role and text of each turn that ends in what has been fed."""
        self._held += text
        at = 0
        while at < len(self._held):
            for role, before, after, tail in self._forms:
                if self._held.startswith(before, at):
                    break
            else:
                if any(f[1].startswith(self._held[at:]) for f in self._forms):
                    break  # a mark may still come
                raise ValueError("formatted text without a turn mark")
            start = at + len(before)
            stop = self._held.find(after, start)
            if stop < 0:
                break
            body = self._held[start:stop]
            if role is None:
                role, _, body = body.partition(tail)
            yield self._unescape(role) if tail else role, self._unescape(body)
            at = stop + len(after)
        self._held = self._held[at:]

    @property
    def done(self) -> bool:
        return not self._held


@dataclass(frozen=True)
class Template:
    """`controls` are strings of two characters or more without backslashes; all markers in forms are made of them and white space."""

    controls: tuple[str, ...]
    start: tuple[str, ...]
    roles: dict[str, Form]
    other: Form
    _mark: re.Pattern = field(init=False, repr=False)

    def __post_init__(self) -> None:
        if any(len(c) < 2 or "\\" in c for c in self.controls):
            raise ValueError("control strings need two characters or more and no backslash")
        some = "|".join(map(re.escape, self.controls))
        object.__setattr__(self, "_mark", re.compile(rf"(?=(?:{some}))(.)|\\", re.DOTALL))

    def escape(self, text: str) -> str:
        return self._mark.sub(lambda m: f"{m[1]}\\" if m[1] else "\\\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        form = self.roles.get(role, self.other)
        return [(form.before.replace("{role}", self.escape(role)), False), (self.escape(text), form.loss), (form.after, False)]

    def reader(self) -> Reader:
        return Reader(self)

    def step(self, state: str, role: str) -> str | None:
        """None if the role may follow the state, else what is wrong."""
        allowed = self.start if state == START else self.roles[state].then if state in self.roles else tuple(self.roles)
        return None if role in allowed else f"{role or 'no role'} after {state or 'no role'}"


INSTRUCT = Template(
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]"),
    start=("system", "user"),
    roles={
        "system": Form("<<SYS>>\n", "\n<</SYS>>\n\n", then=("user",)),
        "user": Form("[INST] ", " [/INST]\n", then=("assistant",)),
        "assistant": Form("<s> ", " </s>\n", loss=True, then=("user", END)),
    },
    other=Form("[ROLE] {role} [TEXT] ", " [/ROLE]\n"),
)

_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
_TURNS = "conv_id long, turn long, role string, segments array<struct<text:string,loss:boolean>>"


def templated(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, turn, role and segments of each row, where it stands."""
    named = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [[{"text": t, "loss": x} for t, x in template.segments(role, text)] for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, _SEGMENTS)], names=["conv_id", "turn", "role", "segments"])

    return named.mapInArrow(run, _TURNS)


def format_turns(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row for each turn, those of a conversation together and in order: conv_id, turn, n (from 0), segments and error.

    A conversation's formatted text is its segments' texts, one after the other.
    """
    body = F.col("segments")[1]["text"]
    dealt = templated(conversations, template).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, state = (), 0, START
        for b in batches:
            places, errors = [], []
            for conv, role in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (conv,) != now:
                    now, n, state = (conv,), 0, START
                places.append(n)
                errors.append(template.step(state, role))
                n, state = n + 1, role
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.int64()), b.column(3), pa.array(errors, pa.string())], names=["conv_id", "turn", "n", "segments", "error"])

    return dealt.mapInArrow(run, "conv_id long, turn long, n long, segments array<struct<text:string,loss:boolean>>, error string")


class _Digest:
    """Running digests of one conversation, from its formatted text and loss mask only."""

    def __init__(self, conv: int | None, template: Template):
        self.conv, self.turns, self.loss_chars, self.chars, self.valid, self.last = conv, 0, 0, 0, True, START
        self.said, self.lost, self.template, self.reader = hashlib.sha256(), hashlib.sha256(), template, template.reader()

    def add(self, segments: list[dict], error: str | None) -> None:
        for s in segments:
            if s["loss"]:
                plain = self.template.unescape(s["text"])
                self.lost.update(plain.encode())
                self.loss_chars += len(plain)
        text = "".join(s["text"] for s in segments)
        self.chars += len(text)
        for role, said in self.reader.feed(text):
            self.said.update(f"{role}\n{said}\n".encode())
            self.turns, self.last = self.turns + 1, role
        self.valid = self.valid and error is None

    def row(self) -> tuple:
        if not self.reader.done:
            raise ValueError(f"the formatted text of conversation {self.conv} ends inside a turn")
        ended = self.last in self.template.roles and END in self.template.roles[self.last].then
        return self.conv, self.turns, self.said.hexdigest(), self.loss_chars, self.lost.hexdigest(), self.chars, self.valid and ended


def digests(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and valid (every turn in order, and the last may end) of each conversation, read back from its formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        now = None
        for b in batches:
            done = []
            for conv, segments, error in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = _Digest(conv, template)
                now.add(segments, error)
            if done:
                yield make(done)
        if now:
            yield make([now.row()])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return format_turns(conversations, template).select("conv_id", "segments", "error").mapInArrow(run, schema)
