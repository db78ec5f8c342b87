"""Chat formatting from a declarative template, in DataFrame expressions only.

A template says for each role what stands before and after its text and whether
its text is under the loss mask; a finite-state machine over roles, a table of
its own, says which turn may follow which. Control strings inside texts are
escaped: a backslash is doubled, and a backslash parts the first character of a
control string from the rest. So no text holds a control string, the output can be
read back without doubt, and dropping each backslash (and keeping the character
after it) restores the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``roles``: its turns; ``other`` serves any further role, whose escaped name it carries between ``before`` and ``named``.

    ``next``: the roles that may follow each state; "" is the start. A conversation is
    valid if each role follows its state and the last one is in ``final``.
    """

    roles: dict[str, Turn]
    other: Turn
    named: str
    next: dict[str, tuple[str, ...]]
    final: tuple[str, ...]
    more_controls: tuple[str, ...] = field(default=())

    def controls(self) -> list[str]:
        """Every control string, white space around it left out, longest first."""
        found = {s.strip() for t in [*self.roles.values(), self.other] for s in (t.before, t.after)} | {self.named.strip(), *self.more_controls}
        return sorted(found - {""}, key=lambda s: (-len(s), s))


#: User turns in [INST] marks, assistant turns between sentence marks; only what the assistant says is learned.
INSTRUCT = Template(
    roles={"system": Turn("<<SYS>>\n", "\n<</SYS>>\n"), "user": Turn("[INST] ", " [/INST]\n"), "assistant": Turn("<s>", "</s>\n", True)},
    other=Turn("<|", "<|end|>\n"),
    named="|>",
    next={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in template.controls():
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, template: Template, known, other) -> Column:
    out = None
    for name, turn in template.roles.items():
        value = known(turn)
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    return out.otherwise(other)


def segments(turns: Column, template: Template) -> Column:
    """``array<struct<text,loss>>``: for each turn what stands before it, its escaped text and what stands after."""

    def of(turn: Column) -> Column:
        role = turn["role"]
        before = _by_role(role, template, lambda t: F.lit(t.before), F.concat(F.lit(template.other.before), escape(role, template), F.lit(template.named)))
        after = _by_role(role, template, lambda t: F.lit(t.after), F.lit(template.other.after))
        loss = _by_role(role, template, lambda t: F.lit(t.loss), F.lit(template.other.loss))
        piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(piece(before, F.lit(False)), piece(escape(turn["text"], template), loss), piece(after, F.lit(False)))

    return F.flatten(F.transform(turns, of))


def valid_order(turns: Column, template: Template) -> Column:
    """Runs the role machine: every turn follows its state and the last is final. No turns: not valid."""
    bad = "\0"

    def step(state: Column, turn: Column) -> Column:
        out = None
        for name, after in template.next.items():
            value = F.when(turn["role"].isin(*after), turn["role"]).otherwise(F.lit(bad))
            out = F.when(state == name, value) if out is None else out.when(state == name, value)
        return out.otherwise(F.lit(bad))

    return F.aggregate(turns, F.lit(""), step).isin(*template.final)


def format_chats(conversations: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, formatted, segments, valid``: one row a conversation.

    Turns are ordered by number, ties by role and text (nulls first), so repeated
    rows give repeated turns. A null text or role is empty; all rows of a null
    conversation id are one conversation. An empty table gives no rows. Turn orders that the machine rejects are
    formatted all the same and marked ``valid`` = false. One exchange on the id;
    a conversation's turns meet in one row, which is what it becomes.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).alias("t"))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    made = gathered.select("conv_id", segments(F.col("turns"), template).alias("segments"), valid_order(F.col("turns"), template).alias("valid"))
    return made.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "valid")


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """``array<struct<role,text,loss>>`` of a formatted conversation, from the string alone.

    Each turn ends with one of the control strings that only stand after a text,
    and the text before it is told by what it starts with.
    """
    ends = sorted({t.after for t in [*template.roles.values(), template.other]}, key=len, reverse=True)
    parts = F.split(formatted, "|".join(re.escape(e).replace("\\\n", "\n").replace("\\ ", " ") for e in ends))
    turns = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def of(part: Column) -> Column:
        made = None
        shape = lambda role, text, loss: F.struct(role.alias("role"), unescape(text).alias("text"), F.lit(loss).alias("loss"))
        for name, turn in template.roles.items():
            value = shape(F.lit(name), part.substr(F.lit(len(turn.before) + 1), F.length(part)), turn.loss)
            made = F.when(F.startswith(part, F.lit(turn.before)), value) if made is None else made.when(F.startswith(part, F.lit(turn.before)), value)
        # Looked for after the mark in front, which may end as ``named`` begins.
        rest = part.substr(F.lit(len(template.other.before) + 1), F.length(part))
        at = F.instr(rest, template.named)
        role = rest.substr(F.lit(1), at - 1)
        return made.otherwise(shape(unescape(role), rest.substr(at + len(template.named), F.length(part)), template.other.loss))

    return F.transform(turns, of)
