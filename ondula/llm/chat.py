"""Chat formatting: a finite-state machine over roles validates the order of turns and emits marked text with loss flags.

The template is data: marks, roles under the loss, allowed steps. Control strings inside texts are broken by a backslash after their first
character, and backslashes are doubled, so a formatted text holds a control string only where the template put it, and texts can be read back.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """Marks of a conversation; ``steps`` has for each state (the last role) the roles that may follow, ``final`` the roles that may be last."""

    begin: str = "<s>"
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", "</s>")})
    #: Marks around the name, and after the text, of a role that has no marks of its own.
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
    loss: frozenset[str] = frozenset({"assistant"})
    steps: dict[str, frozenset[str]] = field(default_factory=lambda: {
        START: frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}),
        "assistant": frozenset({"user"})})
    final: frozenset[str] = frozenset({"assistant"})

    @cached_property
    def control(self) -> list[str]:
        marks = [self.begin, *self.other, *[m for pair in self.marks.values() for m in pair]]
        found = sorted({m.strip() for m in marks}, key=len, reverse=True)
        if any(len(c) < 2 or "\\" in c for c in found):
            raise ValueError("a control string has two characters or more, and no backslash")
        return found

    @cached_property
    def _breaks(self) -> re.Pattern:
        return re.compile("|".join([r"\\", *[f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.control]]))

    def escape(self, text: str) -> str:
        return self._breaks.sub(lambda m: m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of a turn: (text, under the loss)."""
        if role in self.marks:
            before, after = self.marks[role]
        else:
            before, after = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        return [(before, False), (self.escape(text), role in self.loss), (after, False)]

    @cached_property
    def _turn(self) -> re.Pattern:
        own = [f"{re.escape(a)}(?P<t{i}>.*?){re.escape(b)}" for i, (a, b) in enumerate(self.marks.values())]
        a, b, c = map(re.escape, self.other)
        return re.compile("|".join([*own, f"{a}(?P<role>.*?){b}(?P<text>.*?){c}"]), re.S)

    def read(self, formatted: str):
        """(role, text) of each turn in a formatted text, and where its escaped text lies."""
        roles = list(self.marks)
        for m in self._turn.finditer(formatted):
            name = m.lastgroup
            role = self.unescape(m["role"]) if name in ("role", "text") else roles[int(name[1:])]
            yield role, self.unescape(m[name]), m.span(name)


SEGMENTS = "conv_id long, step long, formatted string, loss array<struct<start: long, end: long>>, ok boolean, last boolean"


def _format(template: Template):
    def run(batches):
        conv, state, step, at, ok = object(), START, 0, 0, True
        held = None
        for batch in batches:
            out = []
            for c, role, text in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3)]):
                role = role or ""
                if c != conv:
                    if held:
                        out.append((*held[:4], held[4] and state in template.final, True))
                    conv, state, step, at, ok = c, START, 0, 0, True
                elif held:
                    out.append((*held, False))
                ok = ok and role in template.steps.get(state, frozenset())
                state = role
                parts = [(template.begin, False)] * (step == 0) + template.turn(role, text or "")
                loss, here = [], at
                for segment, flag in parts:
                    if flag and segment:
                        loss.append({"start": here, "end": here + len(segment)})
                    here += len(segment)
                held = (c, step, "".join(s for s, _ in parts), loss, ok)
                at, step = here, step + 1
            if out:
                yield _batch(out)
        if held:
            yield _batch([(*held[:4], held[4] and state in template.final, True)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.string(), spans, pa.bool_(), pa.bool_())
    names = [c.strip().split(" ")[0] for c in ("conv_id", "step", "formatted", "loss", "ok", "last")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def format_turns(conversations: DataFrame, template: Template = Template(), key: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """A row per turn, in order within a partition: (conv_id, step, formatted, loss, ok, last).

    The formatted conversation is the concatenation of ``formatted`` by ``step``; ``loss`` holds spans in it (code points, end exclusive). ``ok`` tells whether all
    turns so far follow the machine; in the ``last`` row also whether the conversation may end there. Turns of a broken order are still
    formatted. Null texts are empty; a null role is the role '' (no step leads to it); rows without a key are one conversation of
    their own; rows that share a turn go by role and text, repeated rows stay. An empty table gives an empty result; other columns are not read.
    Turns stream through the machine, so a conversation of any length takes the memory of a turn.
    """
    rows = conversations.select(F.col(key).cast("long").alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x"))
    return rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").mapInArrow(_format(template), SEGMENTS)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """A row per conversation of ``format_turns``, from its formatted text and loss spans alone."""
    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        names = [c.split(" ")[0] for c in DIGEST.split(", ")]
        n = at = chars = 0
        turns, under = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            out = []
            for conv, _, chunk, loss, ok, last in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                for role, text, _ in template.read(chunk):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    text = template.unescape(chunk[span["start"] - at:span["end"] - at])
                    chars += len(text)
                    under.update(text.encode("utf-8", "surrogatepass"))
                at += len(chunk)
                if last:
                    out.append((conv, n, turns.hexdigest(), chars, under.hexdigest(), at, ok))
                    n = at = chars = 0
                    turns, under = hashlib.sha256(), hashlib.sha256()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return formatted.mapInArrow(run, DIGEST)
