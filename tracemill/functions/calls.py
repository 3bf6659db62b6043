"""Tool calls written into text, and the edits they ask for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import LINE_END, lines_with_ends, once, strip

# Call syntax, the edit tool of each arm, and the fields it needs.
CALL_BLOCK = r"(?sU)CALL\s+(\w+)\s*\n(.*?)\nEND"
VIEW_TOOL = "view_file"
EDIT_TOOLS = {"h2_string_edit": "edit_file", "h2_line_edit": "replace_line"}
STRING_FIELDS = ("path", "old_str", "new_str")
LINE_FIELDS = ("path", "line_num", "new_content")


def calls_in(text: Column) -> Column:
    """ARRAY<STRUCT<tool, body>> of all call blocks in order.

    The text is searched once for whole blocks; the short blocks are then taken apart.
    """
    return F.transform(
        F.regexp_extract_all(text, F.lit(CALL_BLOCK), 0),
        lambda block: F.struct(
            F.regexp_extract(block, CALL_BLOCK, 1).alias("tool"),
            strip(F.regexp_extract(block, CALL_BLOCK, 2)).alias("body"),
        ),
    )


def last_of(calls: Column, tool: str | Column | None = None) -> Column:
    """The last call, of one tool or of any; null when there is none."""
    if tool is not None:
        wanted = F.lit(tool) if isinstance(tool, str) else tool
        calls = F.filter(calls, lambda c: c["tool"] == wanted)
    return F.try_element_at(calls, F.lit(-1))


def last_call(text: Column, tool: str | Column | None = None) -> Column:
    """STRUCT<tool, body> of the last call block of a text."""
    return last_of(calls_in(text), tool)


def call_fields(body: Column, keys: Sequence[str]) -> Column:
    """MAP of the wanted ``key: value`` lines, last one wins; null if a key is missing.

    One blank after the colon is taken off, deeper indentation belongs to the value.
    """
    names = F.array(*map(F.lit, keys))

    def value(lines: Column, key: Column) -> Column:
        found = F.try_element_at(
            F.filter(lines, lambda line: F.startswith(line, F.concat(key, F.lit(":")))), F.lit(-1)
        )
        return F.regexp_replace(F.substr(found, F.length(key) + 2), r"^[ \t]", "")

    values = once(F.split(body, LINE_END), lambda lines: F.transform(names, lambda k: value(lines, k)))
    complete = F.filter(
        F.array(F.map_from_arrays(names, values)),
        lambda m: F.forall(F.map_values(m), lambda v: v.isNotNull()),
    )
    return F.get(complete, F.lit(0))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Replace the first occurrence; null when ``old`` is empty or absent."""
    at = F.position(old, text)
    return F.when(
        (old != "") & (at > 0),
        F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old))),
    )


def whole_number(text: Column) -> Column:
    """BIGINT as Python's int() reads it: blanks, sign and single underscores allowed."""
    bare = strip(text)
    return F.when(
        bare.rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*$"), F.regexp_replace(bare, "_", "").try_cast("bigint")
    )


def replace_line(text: Column, number: Column, line: Column) -> Column:
    """Replace line ``number`` (from 1), keeping its newline; null when out of range."""

    def rebuilt(lines: Column) -> Column:
        changed = F.transform(
            lines,
            lambda old, i: F.when(
                i + 1 == number,
                F.concat(line, F.when(F.endswith(old, F.lit("\n")), F.lit("\n")).otherwise(F.lit(""))),
            ).otherwise(old),
        )
        return F.when(number.between(1, F.size(lines)), F.array_join(changed, ""))

    return once(lines_with_ends(text), rebuilt)
