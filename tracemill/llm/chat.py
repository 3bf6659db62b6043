"""Chats to training text: a finite-state machine over roles and a declarative template.

All of it is DataFrame functions. A conversation's turns are sorted once; a fold over their roles
runs the machine; every turn becomes segments with a loss flag each. Control strings of the
template inside texts and roles are escaped, so the formatted text can be read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CODES = "123456789abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """What surrounds a turn, whose text is trained on, and which turn may follow which.

    moves maps (state, role) to the next state; a role without a move is out of order. controls
    are further strings that must not come out of a text as they are. The escape character and the
    control strings must not be contained in or overlap one another.
    """

    start: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "<|end|>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "~"
    loss_roles: tuple[str, ...] = ("assistant",)
    first_state: str = "begin"
    last_states: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "instructed", ("begin", "user"): "asked", ("instructed", "user"): "asked",
            ("asked", "assistant"): "answered", ("answered", "user"): "asked",
        }
    )

    def __post_init__(self):
        strings = self.marks
        if len(strings) > len(_CODES) or len(self.escape) != 1 or any(self.escape in x or not x for x in strings):
            raise ValueError("control strings must not be empty or hold the escape character, which is one character")
        for x in strings:
            for y in strings:
                if (x != y and x in y) or any(x.endswith(y[:k]) for k in range(1, len(y)) if x != y or k < len(x)):
                    raise ValueError(f"control strings {x} and {y} overlap")

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.start, self.body, self.end, *self.controls)

    def escaped(self, text: Column) -> Column:
        out = F.replace(text, F.lit(self.escape), F.lit(self.escape + "0"))
        for code, mark in zip(_CODES, self.marks):
            out = F.replace(out, F.lit(mark), F.lit(self.escape + code))
        return out

    def unescaped(self, text: Column) -> Column:
        out = text
        for code, mark in zip(_CODES, self.marks):
            out = F.replace(out, F.lit(self.escape + code), F.lit(mark))
        return F.replace(out, F.lit(self.escape + "0"), F.lit(self.escape))


def _out_of_order(turns: Column, template: Template) -> Column:
    """Position of the first turn that has no move, the number of turns if the last state is not a final one, else null."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    begin = F.struct(F.lit(template.first_state).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(was: Column, turn: Column) -> Column:
        to = moves[F.concat(was["state"], F.lit("\n"), turn["role"])]
        return F.struct(
            F.coalesce(to, was["state"]).alias("state"), (was["at"] + 1).alias("at"),
            F.coalesce(was["bad"], F.when(to.isNull(), was["at"])).alias("bad"),
        )

    return F.aggregate(turns, begin, step, lambda x: F.coalesce(x["bad"], F.when(~x["state"].isin(*template.last_states), x["at"])))


def format_chats(
    rows: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, segments, formatted, bad_turn), one row per conversation.

    segments is an array of (text, loss), three per turn: what opens it, its escaped text, what
    closes it; formatted is their texts joined. bad_turn is the position at which the machine
    stops, null for a conversation in order; conversations out of order are formatted as well.

    Defined cases: null texts and roles are empty; turns sort by (turn, role, text), null turns
    first, so ties have an order and repeated rows are repeated turns; rows without a conversation
    id form one conversation; an empty table gives no rows. Other columns are not read. A
    conversation is one value of one row, so it has to fit into a task.
    """
    t = template or Template()
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = rows.select(F.col(id_col).alias("conv_id"), turn.alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))

    def segments(x: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        opened = F.concat(F.lit(t.start), t.escaped(x["role"]), F.lit(t.body))
        return F.array(segment(opened, F.lit(False)), segment(t.escaped(x["text"]), x["role"].isin(*t.loss_roles)), segment(F.lit(t.end), F.lit(False)))

    out = chats.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), _out_of_order(F.col("turns"), t).alias("bad_turn"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_chats(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted, bad_turn): turns (role, text) read back from the formatted text alone, and the
    texts under the loss flags of the segments, unescaped."""
    t = template or Template()
    cut = F.split("formatted", re.escape(t.start))
    pieces = F.slice(cut, F.lit(2), F.size(cut))

    def turn(piece: Column) -> Column:
        inner = F.substring_index(piece, t.end, 1)
        role = F.substring_index(inner, t.body, 1)
        return F.struct(t.unescaped(role).alias("role"), t.unescaped(F.substring_index(inner, t.body, -1)).alias("text"))

    # Under the mask a segment is told by where it lies in the text: three segments per turn, the second is its text.
    under = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescaped(s["text"]))
    return chats.select("conv_id", F.transform(pieces, turn).alias("turns"), under.alias("loss_texts"), "formatted", "bad_turn")


def digests(chats: DataFrame) -> DataFrame:
    """Sizes and digests of conversations that were read back."""
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.col("bad_turn").isNull().alias("valid"),
    )
