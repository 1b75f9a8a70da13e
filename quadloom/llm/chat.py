"""Chat formatting: a finite-state machine over roles, a declarative template, per-segment loss flags.

DataFrame functions only.  The turns of a conversation, in order, run through a
state machine (``MOVES``) that says whether their order is valid; a template
turns each into segments, control strings and escaped texts, each with a flag
that says whether the training loss counts it.  The formatted conversation is
the concatenation of its segments.

Escaping is reversible: a backslash in a text is doubled and a backslash is put
into each ``<|``, so no text contains a control string; a line end in a role is
written as ``<|nl|>``.  ``read_back`` undoes it, from the formatted string alone.

Turns are ordered by turn, role and text; nulls come first, and null roles and
texts are empty.  Rows without a conversation id form one conversation with a
null id.  Repeated rows are turns of their own.  A conversation is one value,
so it has to fit a task; conversations are spread over tasks by their ids.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import pick


@dataclass(frozen=True)
class Template:
    """Control strings around a turn and its role, the roles that the loss counts, and the state machine."""

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    newline: str = "<|nl|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: dict(MOVES))
    accept: tuple[str, ...] = ("answered",)


#: (state, role) -> state; what is not listed is an error.
MOVES = {
    ("start", "system"): "primed",
    ("start", "user"): "asked",
    ("primed", "user"): "asked",
    ("asked", "assistant"): "answered",
    ("answered", "user"): "asked",
    ("asked", "tool"): "asked",
    ("answered", "tool"): "asked",
}


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def machine(roles: Column, template: Template) -> Column:
    """The state after all roles; 'error' is never left."""

    def step(state: Column, role: Column) -> Column:
        out = F.lit("error")
        for (before, read), after in template.moves.items():
            out = F.when((state == before) & (role == read), F.lit(after)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit(template.start), step)


def segments(turn: Column, template: Template) -> Column:
    """The segments of one turn: (text, loss)."""
    loss = turn["role"].isin(*template.loss_roles)

    def piece(text: Column, counted: Column) -> Column:
        return F.struct(text.alias("text"), counted.alias("loss"))

    no = F.lit(False)
    role = F.replace(escaped(turn["role"]), F.lit("\n"), F.lit(template.newline))
    return F.array(piece(F.concat(F.lit(template.begin), role, F.lit(template.after_role)), no), piece(escaped(turn["text"]), loss), piece(F.lit(template.end), no))


def formatted(conversations: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, segments (text, loss), formatted, valid."""
    rows = pick(conversations, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    made = turns.select("conv_id", F.flatten(F.transform("turns", lambda t: segments(t, template))).alias("segments"), machine(F.transform("turns", lambda t: t["role"]), template).isin(*template.accept).alias("valid"))
    return made.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_back(made: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from the formatted strings and the segments' flags."""
    quote = lambda s: "\\Q" + s + "\\E"
    raw = F.slice(F.split("formatted", quote(template.begin)), 2, 1 << 30)

    def turn(x: Column) -> Column:
        body = F.substring(x, F.lit(1), F.char_length(x) - F.lit(len(template.end)))
        cut = F.instr(body, template.after_role)
        role = unescaped(F.replace(F.substring(body, F.lit(1), cut - 1), F.lit(template.newline), F.lit("\n")))
        text = unescaped(F.substring(body, cut + F.lit(len(template.after_role)), F.char_length(body)))
        return F.struct(role.alias("role"), text.alias("text"))

    spoken = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return made.select("conv_id", "formatted", "valid", F.transform(raw, turn).alias("turns"), F.array_join(spoken, "").alias("loss_text"))


def digests(made: DataFrame, template: Template = Template()) -> DataFrame:
    """What the formatted output says: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid."""
    back = read_back(made, template)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
