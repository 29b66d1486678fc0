"""Chat formatting: a declarative template, a state machine over roles, loss flags per segment.

A conversation becomes one text. Each turn is an opening mark, the escaped text and a closing mark;
the turn's text alone carries the loss flag when its role is one that the model learns to write.
Marks cannot be forged: wherever a text holds a control string, one escape character is put in front
of it (and of escape characters already there), which the reader takes away again.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .shared import picked


@dataclass(frozen=True)
class Template:
    """What a conversation looks like and which turns may follow each other.

    ``opens`` names the mark of each known role; any other role is written after ``other`` with its
    own name. ``follows`` lists the roles allowed after a state, where a state is the role before or
    ``start``; a conversation may end in one of ``ends``. Texts of ``learned`` roles carry loss.
    """

    opens: dict = field(default_factory=lambda: {
        "system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Role "
    other_end: str = ": "
    close: str = "</turn>"
    escape: str = "\\"
    follows: dict = field(default_factory=lambda: {
        "start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]})
    ends: tuple = ("assistant",)
    learned: tuple = ("assistant",)

    @property
    def controls(self) -> str:
        """Pattern of every control string."""
        return "|".join(_quoted(c) for c in [*self.opens.values(), self.other, self.close])

    @property
    def boundary(self) -> str:
        """Between the text of a turn and what follows; no escaped text holds it."""
        return f"\n{self.close}\n"


TEMPLATE = Template()


def _quoted(literal: str) -> str:
    """A literal as a pattern that Java and RE2 read alike."""
    return re.sub(r"([^A-Za-z0-9 \n])", r"\\\1", literal)


def _replacement(literal: str) -> str:
    return literal.replace("\\", "\\\\").replace("$", "\\$")


def escaped(text: Column, t: Template = TEMPLATE) -> Column:
    e = _quoted(t.escape)
    return F.regexp_replace(text, f"((?:{e})*(?:{t.controls}))", f"{_replacement(t.escape)}$1")


def unescaped(text: Column, t: Template = TEMPLATE) -> Column:
    e = _quoted(t.escape)
    return F.regexp_replace(text, f"{e}((?:{e})*(?:{t.controls}))", "$1")


def _role_name(role: Column, t: Template) -> Column:
    """A role outside the template, so that it holds neither line breaks nor the end of the mark."""
    return F.url_encode(role)


def turn_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    return picked(conversations, conv_id=conv_id, turn=turn, role=role, text=text).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def formatted(conversations: DataFrame, template: Template = TEMPLATE, conv_id: str = "conv_id",
              turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, bad_turn, segments (text, loss), formatted,
    spans (start, length of each loss segment in ``formatted``, from 1, in characters).

    Turns are taken by turn number, NULL numbers first, ties by role and then text; repeated rows
    are turns of their own. NULL role and text count as empty, rows with a NULL id form one
    conversation. ``valid`` says whether the state machine accepts the roles; ``bad_turn`` is the
    position (from 0) of the first turn it refuses, -1 when only the end is refused, else NULL. A
    conversation that is not valid is formatted all the same. An empty table gives no rows.

    A conversation is one output row, so its turns meet in one task; nothing else does.
    """
    t = template
    rows = turn_rows(conversations, conv_id, turn, role, text)
    mark = F.coalesce(*[F.when(F.col("role") == r, F.lit(m)) for r, m in t.opens.items()],
                      F.concat(F.lit(t.other), _role_name(F.col("role"), t), F.lit(t.other_end)))
    rows = rows.select("conv_id", F.struct(
        "turn", "role", "text", mark.alias("mark"), escaped(F.col("text"), t).alias("body")).alias("row"))
    steps = F.create_map(*[F.lit(x) for state, after in t.follows.items() for r in after
                           for x in (f"{state}>{r}", r)])
    machine = F.aggregate(
        "rows", F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")),
        lambda s, r: F.struct(
            F.coalesce(F.element_at(steps, F.concat(s["state"], F.lit(">"), r["role"])), r["role"]).alias("state"),
            (s["at"] + 1).alias("at"),
            F.coalesce(s["bad"], F.when(F.element_at(
                steps, F.concat(s["state"], F.lit(">"), r["role"])).isNull(), s["at"])).alias("bad")))
    segments = F.flatten(F.transform("rows", lambda r: F.array(
        F.struct(r["mark"].alias("text"), F.lit(False).alias("loss")),
        F.struct(r["body"].alias("text"), r["role"].isin(*t.learned).alias("loss")),
        F.struct(F.lit(t.boundary).alias("text"), F.lit(False).alias("loss")))))
    spans = F.aggregate(
        "segments", F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, g: F.struct(
            (s["at"] + F.char_length(g["text"])).alias("at"),
            F.when(g["loss"], F.array_append(s["spans"], F.struct(
                s["at"].alias("start"), F.char_length(g["text"]).alias("length")))).otherwise(s["spans"]).alias("spans")))
    return (
        rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
        .select("conv_id", F.size("rows").cast("long").alias("n_turns"), machine.alias("m"), segments.alias("segments"))
        .select(
            "conv_id", "n_turns",
            (F.col("m.bad").isNull() & F.col("m.state").isin(*t.ends)).alias("valid"),
            F.coalesce("m.bad", F.when(~F.col("m.state").isin(*t.ends), F.lit(-1))).alias("bad_turn"),
            "segments", F.array_join("segments.text", "").alias("formatted"), spans["spans"].alias("spans"))
    )


def read_turns(text: Column, template: Template = TEMPLATE) -> Column:
    """Array of (role, text): the turns of a formatted conversation, read from its text alone."""
    t, end = template, 2**31 - 1

    def turn(piece):
        named = F.substring(piece, len(t.other) + 1, end)
        name = F.substring_index(named, t.other_end, 1)
        role = F.coalesce(*[F.when(piece.startswith(m), F.lit(r)) for r, m in t.opens.items()], F.url_decode(name))
        body = F.coalesce(
            *[F.when(piece.startswith(m), F.substring(piece, len(m) + 1, end)) for m in t.opens.values()],
            F.substring(named, F.char_length(name) + len(t.other_end) + 1, F.lit(end)))
        return F.struct(role.alias("role"), unescaped(body, t).alias("text"))

    pieces = F.split(text, _quoted(t.boundary), -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def learned_text(text: Column, spans: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, escapes taken away, in order."""
    return F.array_join(F.transform(
        spans, lambda s: unescaped(F.substring(text, s["start"], s["length"]), template)), "")
