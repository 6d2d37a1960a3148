"""Chat formatting with DataFrame functions only.

A finite-state machine over roles judges the order of turns; a declarative template turns each turn into segments with a
loss flag each; segments joined give the formatted text. Control strings inside roles and texts are escaped, and
`read_back` recovers roles, texts and loss text from the output.

Null texts and roles are empty. Turns stand in the order of turn, role, text (ties and repeated rows stay, side by
side). Conversations that the machine rejects are formatted too, with the place of the first fault. A null conv_id is a
conversation of its own; further columns are left alone; no rows give no conversations. A conversation is one row, so
its texts, however long, are held in one task; nothing is cut.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is `turn` role `text` text `end`; the text of roles in `learned` is under the loss mask."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    learned: tuple[str, ...] = ("assistant",)
    #: Control strings of other templates that must not reach a tokenizer unescaped either.
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
    escape: str = "\\"
    #: state -> role -> next state
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn, self.text, self.end, *self.foreign)


def escape(value: Column, t: Template) -> Column:
    """Escape characters doubled, and one put after the first character of every control string."""
    out = F.replace(value, F.lit(t.escape), F.lit(t.escape * 2))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(s[0] + t.escape + s[1:])), t.controls, out)


def unescape(value: Column, t: Template) -> Column:
    return F.regexp_replace(value, r"(?s)\\(.)", "$1")


def _states(roles: Column, t: Template) -> Column:
    """Struct of the last state, turns seen, and the first faulty turn (null if none)."""
    moves = F.create_map(*[F.lit(x) for s, by in t.machine.items() for r, to in by.items() for x in (f"{s}>{r}", to)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("fault"))

    def step(a: Column, role: Column) -> Column:
        to = F.when(a["fault"].isNull(), F.element_at(moves, F.concat(a["state"], F.lit(">"), role)))
        return F.struct(
            F.coalesce(to, a["state"]).alias("state"),
            (a["seen"] + 1).alias("seen"),
            F.coalesce(a["fault"], F.when(to.isNull(), a["seen"])).alias("fault"),
        )

    return F.aggregate(roles, start, step)


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, valid, first_fault (turn's place from 0), segments (text, loss), formatted."""
    t = template or Template()
    turns = conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    )

    def segments(x: Column) -> Column:
        def piece(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        return F.array(
            piece(F.concat(F.lit(t.turn), escape(x["role"], t), F.lit(t.text)), F.lit(False)),
            piece(escape(x["text"], t), x["role"].isin(*t.learned)),
            piece(F.lit(t.end), F.lit(False)),
        )

    state = _states(F.transform("turns", lambda x: x["role"]), t)
    return turns.select(
        "conv_id",
        state.alias("state"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    ).select(
        "conv_id",
        F.col("state.fault").isNull().alias("valid"),
        F.col("state.fault").alias("first_fault"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turns (role, text) read from the formatted text, loss_text from the segments, both unescaped; formatted,
    valid and first_fault as they were."""
    t = template or Template()

    def quoted(s: str) -> str:
        return f"\\Q{s}\\E"

    parts = F.filter(F.split("formatted", quoted(t.turn)), lambda p, i: i > 0)

    def turn(p: Column) -> Column:
        halves = F.split(F.split(p, quoted(t.end))[0], quoted(t.text))
        return F.struct(unescape(halves[0], t).alias("role"), unescape(halves[1], t).alias("text"))

    learned = F.filter("segments", lambda s: s["loss"])
    return formatted.select(
        "conv_id",
        F.transform(parts, turn).alias("turns"),
        F.array_join(F.transform(learned, lambda s: unescape(s["text"], t)), "").alias("loss_text"),
        "formatted",
        "valid",
        "first_fault",
    )
