"""Chat operators on a table with one row per turn: rec, pos, role, content.

What a rewrite needs to know about a record is one aggregation over its turns (partial on
the map side, so a record of any length becomes one small row); the rewrite itself joins
those facts back with hot records cut into pieces. No message list is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.messages import CALL_OPEN, trained_length, turn_length
from ..functions.text import lstrip, rstrip
from ..session import written
from .skew import HOT_ROWS, sized_join


@dataclass(frozen=True)
class Arm:
    """One experiment arm: the texts it adds (None: nothing) and the marker it leaves."""

    name: str
    question: str | None = None
    answer: str | None = None
    marker: str | None = None


# Neutral defaults; experiments pass their own.
DEFAULT_ARMS = (
    Arm("first", "Please repeat this sentence: one", "one"),
    Arm("second", "Please repeat this sentence: two", "two"),
    Arm("control"),
)


def repeated_line(line: Column | str, n: int) -> Column:
    """A line n times on lines of its own."""
    text = F.lit(line) if isinstance(line, str) else line
    return F.array_join(F.array_repeat(text, n), "\n")


def variant_text(template: str, word: str, condition: str | None = None) -> str:
    """Text of a variant: the template with its word, then the condition if there is one."""
    return template.format(word=word) + (f", {condition}" if condition else "")


def with_arms(df: DataFrame, arms: Sequence[Arm] = DEFAULT_ARMS) -> DataFrame:
    """Every row once per arm. Arms are literals, so this is a projection and not a join."""
    rows = [
        F.struct(
            F.lit(i).alias("arm_no"),
            F.lit(a.name).alias("arm"),
            F.lit(a.question).cast("string").alias("question"),
            F.lit(a.answer).cast("string").alias("answer"),
            F.lit(a.marker).cast("string").alias("marker"),
        )
        for i, a in enumerate(arms)
    ]
    return df.select("*", F.inline(F.array(*rows)))


def record_facts(
    turns: DataFrame, marker: Column | str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per record: positions, ending, lengths and flags.

    ``keep`` names columns that are the same in all turns of a record. Every aggregate has a
    buffer of fixed width, so Spark hashes the turns and does not sort their texts.
    """
    role, pos, content = F.col("role"), F.col("pos"), F.coalesce(F.col("content"), F.lit(""))
    user, assistant = F.when(role == "user", pos), F.when(role == "assistant", pos)
    mark = F.lit(marker) if isinstance(marker, str) else marker
    carried = F.lit(False) if mark is None else F.bool_or(F.contains(content, mark))
    return turns.groupBy("rec", *keep).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min(user).alias("first_user"),
        F.max(user).alias("last_user"),
        F.max(assistant).alias("last_assistant"),
        F.max(pos).alias("last_pos"),
        F.max(F.when(role == "tool", pos)).alias("last_tool"),
        F.max_by(F.contains(content, F.lit(CALL_OPEN)), assistant).alias("open_call"),
        F.sum(F.length(content)).alias("n_chars"),
        F.sum(F.regexp_count(content, F.lit(r"\S+"))).alias("n_words"),
        F.sum(turn_length(role, content)).alias("rendered_length"),
        F.sum(trained_length(role, content)).alias("trained_length"),
        carried.alias("carried"),
    )


def truncated_ending() -> Column:
    """On facts: the last message is a tool result."""
    return F.coalesce(F.col("last_tool") == F.col("last_pos"), F.lit(False))


def answered() -> Column:
    """On facts: a last assistant message exists and carries no call tag."""
    return F.col("last_assistant").isNotNull() & ~F.coalesce(F.col("open_call"), F.lit(True))


def fit_for_pair() -> Column:
    """On facts: a user and an assistant message exist and the answer is complete."""
    return F.col("first_user").isNotNull() & answered()


def within_length(limit: int, measure: str = "n_words") -> Column:
    """On facts: the record is not longer than the limit."""
    return F.col(measure) <= limit


def _written_facts(facts: DataFrame, *columns: str) -> DataFrame:
    """Facts as a written table, so that hot records, new turns and the join need no further look at the turns."""
    return written(facts.select("rec", "n_messages", *columns), "facts")


def _with_facts(turns: DataFrame, facts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return sized_join(turns, facts, ["rec"], ["pos"], "n_messages", rows=hot_rows)


def append_pair(turns: DataFrame, arms: Sequence[Arm] = DEFAULT_ARMS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Turns of every arm: question added to the first user turn, answer to the last assistant.

    Unfit records are left out. The turns are read twice, and one shuffle moves the text, before
    the fan-out. Records of more than ``hot_rows`` turns are cut into pieces.
    """
    facts = _written_facts(record_facts(turns).where(fit_for_pair()), "first_user", "last_assistant")
    fanned = with_arms(_with_facts(turns, facts, hot_rows), arms)
    tail = F.when(F.col("pos") == F.col("first_user"), F.col("question")).when(
        F.col("pos") == F.col("last_assistant"), F.col("answer")
    )
    content = F.when(
        tail.isNotNull(), F.concat(rstrip(F.coalesce("content", F.lit(""))), F.lit("\n\n"), tail)
    ).otherwise(F.col("content"))
    return fanned.select("rec", "arm", "pos", "role", content.alias("content"))


def _change_last_user(turns: DataFrame, change, added: Column, marker: Column | str) -> DataFrame:
    facts = _written_facts(record_facts(turns, marker), "last_user", "last_pos", "carried")
    joined = _with_facts(turns, facts)
    hit = ~F.col("carried") & (F.col("pos") == F.col("last_user"))
    kept = joined.select(
        "rec", "pos", "role",
        F.when(hit, change(F.coalesce("content", F.lit("")))).otherwise(F.col("content")).alias("content"),
        hit.alias("changed"),
    )
    new = facts.where(~F.col("carried") & F.col("last_user").isNull()).select(
        "rec", (F.col("last_pos") + 1).alias("pos"), F.lit("user").alias("role"),
        added.alias("content"), F.lit(True).alias("changed"),
    )
    return kept.withColumn("changed", F.coalesce("changed", F.lit(False))).unionByName(new)


def append_last_user(turns: DataFrame, text: str, marker: str | None = None) -> DataFrame:
    """Append to each record's last user turn, or add a user turn; marked records stay.

    The marker is the stripped text unless the arm names its own, so a second run changes
    nothing.
    """
    if not text:
        return turns.select("rec", "pos", "role", "content", F.lit(False).alias("changed"))
    return _change_last_user(
        turns, lambda c: F.concat(c, F.lit(text)), lstrip(F.lit(text)), marker or text.strip()
    )


def append_last_user_per_arm(turns: DataFrame, arms: Sequence[Arm] = DEFAULT_ARMS) -> DataFrame:
    """``append_last_user`` for several arms in one pass: each arm's question, its own marker.

    The facts carry one flag per arm, so the turns are read twice and shuffled once, whatever the
    number of arms. An arm without a question leaves every record as it is.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    flags = [
        F.lit(True) if not a.question else F.bool_or(F.contains(content, F.lit(a.marker or a.question.strip())))
        for a in arms
    ]
    facts = turns.groupBy("rec").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.max(F.when(F.col("role") == "user", F.col("pos"))).alias("last_user"),
        F.max("pos").alias("last_pos"),
        *(flag.alias(f"_skip_{i}") for i, flag in enumerate(flags)),
    ).withColumn("skip", F.array(*(f"_skip_{i}" for i in range(len(arms)))))
    facts = _written_facts(facts, "last_user", "last_pos", "skip")
    open_ = ~F.get("skip", F.col("arm_no"))
    fanned = with_arms(_with_facts(turns, facts), arms)
    hit = F.coalesce(open_ & (F.col("pos") == F.col("last_user")), F.lit(False))
    kept = fanned.select(
        "rec", "arm", "pos", "role",
        F.when(hit, F.concat(content, F.col("question"))).otherwise(F.col("content")).alias("content"),
        hit.alias("changed"),
    )
    new = with_arms(facts.where(F.col("last_user").isNull()), arms).where(open_).select(
        "rec", "arm", (F.col("last_pos") + 1).alias("pos"), F.lit("user").alias("role"),
        lstrip(F.col("question")).alias("content"), F.lit(True).alias("changed"),
    )
    return kept.unionByName(new)


def rewrite_last_user(turns: DataFrame, template: str, marker: str, slot: str = "{original}") -> DataFrame:
    """Put each record's last user turn into a template around it; marked records stay."""
    return _change_last_user(
        turns, lambda c: F.replace(F.lit(template), F.lit(slot), c),
        F.lit(template.replace(slot, "")), marker,
    )


def sides(turns: DataFrame) -> DataFrame:
    """Add ``side``: prompt up to the first user turn, completion up to the last assistant.

    Later turns, and records whose answer does not follow a user turn, are left out.
    """
    facts = _written_facts(
        record_facts(turns).where(F.col("last_assistant") > F.col("first_user")), "first_user", "last_assistant"
    )
    side = F.when(F.col("pos") <= F.col("first_user"), F.lit("prompt")).otherwise(F.lit("completion"))
    return (
        _with_facts(turns, facts)
        .where(F.col("pos") <= F.col("last_assistant"))
        .select("rec", "pos", side.alias("side"), "role", "content")
    )


def rewrite_audit(before: DataFrame, after: DataFrame, must_contain: Sequence[str]) -> DataFrame:
    """One row: turns changed, unchanged and added, and changed turns missing a text.

    Joined on record and position, so a long record spreads over many tasks.
    """
    b = before.select("rec", "pos", F.col("content").alias("old"), F.lit(True).alias("known"))
    a = after.select("rec", "pos", F.col("content").alias("new"))
    both = a.join(b, ["rec", "pos"], "left")
    added = F.col("known").isNull()
    same = ~added & F.col("old").eqNullSafe(F.col("new"))
    missing = F.lit(False)
    for text in must_contain:
        missing = missing | ~F.contains(F.coalesce("new", F.lit("")), F.lit(text))

    def n(test: Column) -> Column:
        return F.count_if(test)

    return both.agg(
        F.count(F.lit(1)).alias("n_turns"),
        n(added).alias("n_added"),
        n(~added & ~same).alias("n_changed"),
        n(same).alias("n_unchanged"),
        n(~same & missing).alias("n_missing_text"),
    )


def arm_counts(facts: DataFrame, arms: Sequence[Arm] = DEFAULT_ARMS) -> DataFrame:
    """Records per arm and split, unfit records counted apart; facts carry ``split``.

    Counted before the fan-out, which only repeats the few count rows.
    """
    counts = facts.groupBy("split").agg(
        F.count_if(fit_for_pair()).alias("n_records"),
        F.count_if(~fit_for_pair()).alias("n_unfit"),
    )
    return with_arms(counts, arms).select("arm", "split", "n_records", "n_unfit")


def manifest(facts: DataFrame, stem: str, seed: int, fraction: float, arms: Sequence[Arm] = DEFAULT_ARMS) -> DataFrame:
    """One row: seed, fraction, stem and record counts, and a count map per arm."""
    per_stem = facts.groupBy(stem, "split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(fit_for_pair()).alias("fit")
    )
    names = [a.name for a in arms]
    counts = F.struct(
        F.sum(F.when(F.col("split") == "train", F.col("fit")).otherwise(0)).alias("train"),
        F.sum(F.when(F.col("split") == "val", F.col("fit")).otherwise(0)).alias("val"),
        F.sum(F.col("rows") - F.col("fit")).alias("malformed_skipped"),
    )
    return per_stem.agg(
        F.count(F.lit(1)).alias("n_unique_prompts"),
        F.count_if(F.col("split") == "train").alias("n_train_prompts"),
        F.count_if(F.col("split") == "val").alias("n_val_prompts"),
        F.sum("rows").alias("n_input_records"),
        counts.alias("counts"),
    ).select(
        F.lit(seed).alias("seed"), F.lit(fraction).alias("val_fraction"),
        "n_unique_prompts", "n_train_prompts", "n_val_prompts", "n_input_records",
        F.map_from_arrays(F.array(*map(F.lit, names)), F.array_repeat("counts", len(names))).alias("arms"),
    )
