"""Text expressions: trimming, answers, labels, fenced blocks, lines and pattern flags."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes.
PY_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(
    map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# The line ends str.splitlines() knows.
_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029)
LINE_END = f"\r\n|[{_ENDS}]"
_NOT_END = f"[^{_ENDS}]"
_ODD_END = f"[{_ENDS[1:]}]"

# Tags, word lists and label names of the one-word mood probe.
CLOSE_THINK = "</think>"
POSITIVE_WORD = "happy"
NEGATIVE_WORD = "sad"
NEGATIONS = ("not", "no", "neither", "never", "without", "n't")
OTHER_LABEL = "neither"
JUDGE_LABELS = ("HAPPY", "SAD", "NEITHER")

# Fence patterns, and the length below which a last block is doubted.
ANY_FENCE = r"(?is)```(?:python|py)?\s*\n(.*?)```"
PYTHON_FENCE = r"(?s)```python\s*\n(.*?)```"
BARE_FENCE = r"(?s)```\s*\n(.*?)```"
SHORT_BLOCK = 10

# Patterns that mark a planted fault, a right form, or any regex use.
FAULT_PATTERNS = {
    "clamp": r"max\s*\(\s*hi\s*,\s*min\s*\(\s*lo\b",
    "regex": r"r['\"]\(\.\*\)\(\\d\+\)",
    "regex_call": r"re\.(findall|search|match)\s*\(\s*r?['\"]\(\.\*\)\(\\d\+\)['\"]",
}
CLAMP_FAULT_FORMS = (
    r"max\s*\(\s*hi\s*,\s*min\s*\(\s*lo\s*,",
    r"max\s*\(\s*high\s*,\s*min\s*\(\s*low\s*,",
)
CLAMP_RIGHT_FORMS = (
    r"max\s*\(\s*lo\s*,\s*min\s*\(\s*hi\s*,",
    r"max\s*\(\s*low\s*,\s*min\s*\(\s*high\s*,",
)
REGEX_RIGHT_FORMS = (
    r"re\.findall\s*\(\s*r?['\"]\\d\+",
    r"re\.search\s*\(\s*r?['\"]\\d\+",
    r"re\.findall\s*\(\s*r?['\"]\[0-9\]\+",
)
ANY_REGEX_USE = r"\bre\.(findall|search|match|fullmatch|finditer|compile)\s*\("


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` a single time and let ``use`` refer to it as often as it likes.

    Inside a lambda an outer expression would run again for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(PY_SPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(PY_SPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(PY_SPACE))


def final_answer(text: Column) -> Column:
    """Text after the last closing tag; without one, the last line that is not blank."""
    tail = strip(F.substring_index(text, CLOSE_THINK, -1))
    after_newline = F.substring_index(rstrip(text), "\n", -1)
    last_line = strip(F.try_element_at(F.split(after_newline, LINE_END), F.lit(-1)))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(""))
        .when(F.contains(text, F.lit(CLOSE_THINK)), tail)
        .otherwise(F.coalesce(last_line, F.lit("")))
    )


def mood_label(
    text: Column,
    positive: str = POSITIVE_WORD,
    negative: str = NEGATIVE_WORD,
    negations: Sequence[str] = NEGATIONS,
    other: str = OTHER_LABEL,
) -> Column:
    """Three-way label of a whole text: the exact word first, then words with negation.

    A word counts when a token of ``[a-z']`` starts with it, so "isn't happy" is positive:
    "isn't" is one token and not in the negation list.
    """
    quotes = PY_SPACE + "*_\"'`"
    trimmed = F.rtrim(F.ltrim(F.lower(strip(text)), F.lit(quotes)), F.lit(quotes + ".?!,"))

    def label(bare: Column) -> Column:
        up = bare.rlike(rf"(?<![a-z']){positive}")
        down = bare.rlike(rf"(?<![a-z']){negative}")
        negated = bare.rlike(rf"(?<![a-z'])(?:{'|'.join(negations)})(?![a-z'])")
        return (
            F.when(bare == positive, F.lit(positive))
            .when(bare == negative, F.lit(negative))
            .when((up & down) | negated, F.lit(other))
            .when(up, F.lit(positive))
            .when(down, F.lit(negative))
            .otherwise(F.lit(other))
        )

    return once(F.coalesce(trimmed, F.lit("")), label)


def judge_label(
    reply: Column, error: Column | None = None, labels: Sequence[str] = JUDGE_LABELS
) -> Column:
    """First label contained in a recorded judge reply; the last label is the fallback."""
    upper = F.upper(strip(reply))
    failed = reply.isNull() if error is None else (error.isNotNull() | reply.isNull())
    out = F.when(failed, F.lit("ERROR"))
    for label in labels:
        out = out.when(F.contains(upper, F.lit(label)), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def judge_fell_back(reply: Column, labels: Sequence[str] = JUDGE_LABELS) -> Column:
    """True where no label occurs in the reply."""
    upper = F.upper(strip(reply))
    hit = F.contains(upper, F.lit(labels[0]))
    for label in labels[1:]:
        hit = hit | F.contains(upper, F.lit(label))
    return ~hit


def first_word(text: Column) -> Column:
    """First word, without wrapping punctuation, lowercased."""
    word = F.get(F.split(strip(text), "[" + PY_SPACE + "]+", 2), F.lit(0))
    return F.lower(F.trim(word, F.lit("*_\"'`.?!,:;()[]{}")))


def last_code_block(text: Column) -> Column:
    """Last fenced block; the longest one when the last is short. Null without a fence."""

    def pick(blocks: Column) -> Column:
        last = strip(F.try_element_at(blocks, F.lit(-1)))
        first_longest = once(
            F.array_max(F.transform(blocks, lambda b: F.length(b))),
            lambda most: F.try_element_at(F.filter(blocks, lambda b: F.length(b) == most), F.lit(1)),
        )
        doubt = (F.length(last) < SHORT_BLOCK) & (F.size(blocks) > 1)
        return F.when(doubt, strip(first_longest)).otherwise(last)

    return once(F.regexp_extract_all(text, F.lit(ANY_FENCE), 1), pick)


def code_or_text(text: Column) -> Column:
    """First python fence, then first bare fence, then the text itself."""
    python = F.get(F.regexp_extract_all(text, F.lit(PYTHON_FENCE), 1), F.lit(0))
    bare = F.get(F.regexp_extract_all(text, F.lit(BARE_FENCE), 1), F.lit(0))
    return F.coalesce(python, bare, text)


def has_pattern(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def has_any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """One alternation instead of one scan per pattern."""
    return has_pattern(text, "|".join(f"(?:{p})" for p in patterns))


def right_but_not_fault(text: Column, right: Sequence[str], fault: Sequence[str]) -> Column:
    return has_any_pattern(text, right) & ~has_any_pattern(text, fault)


def pattern_count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def pattern_for_arm(text: Column, arm: Column, patterns: Mapping[str, str]) -> Column:
    """Flag by the pattern of the row's own arm; arms without a pattern give false."""
    out = F.lit(False)
    for name, pattern in patterns.items():
        out = F.when(arm == name, has_pattern(text, pattern)).otherwise(out)
    return out


def lines_of(text: Column) -> Column:
    """Lines split on newline; the piece after a last newline is no line."""
    parts = F.split(text, "\n")
    return F.when(F.endswith(text, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines_with_ends(text: Column) -> Column:
    """Lines that keep their own line end; texts with plain newlines only are just split."""

    def keep_newlines(parts: Column) -> Column:
        ended = F.transform(
            parts,
            lambda line, i: F.when(i < F.size(parts) - 1, F.concat(line, F.lit("\n"))).otherwise(line),
        )
        return F.filter(ended, lambda line: line != "")

    odd = F.regexp_extract_all(text, F.lit(f"{_NOT_END}*(?:{LINE_END})|{_NOT_END}+"), 0)
    return F.when(text.rlike(_ODD_END), odd).otherwise(once(F.split(text, "\n"), keep_newlines))


def number_lines(text: Column) -> Column:
    """Prefix every line with its number from 1; a last newline stays."""
    numbered = F.array_join(
        F.transform(
            lines_of(text),
            lambda line, i: F.concat((i + 1).cast("string"), F.lit(": "), line),
        ),
        "\n",
    )
    return F.when(F.endswith(text, F.lit("\n")), F.concat(numbered, F.lit("\n"))).otherwise(numbered)


def line_number_of(text: Column, line: Column) -> Column:
    """Number of a line that occurs exactly once; null when absent or repeated."""

    def found(lines: Column) -> Column:
        hits = F.size(F.filter(lines, lambda x: x == line))
        return F.when(hits == 1, F.array_position(lines, line).cast("int"))

    return once(lines_of(text), found)


def cut(text: Column, n: int) -> Column:
    """Stored form of a long text: its first n characters."""
    return F.left(text, F.lit(n))


def cut_list(items: Column, n: int = 3) -> Column:
    return F.slice(items, 1, n)
