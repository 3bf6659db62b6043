"""JSON texts spelled as training files spell them: a blank after each comma and colon, keys in
their own order, everything outside printable ASCII escaped, floats in their shortest form.

All of it is built-in expressions. Two spellings stay apart from that form: an object with the
same key twice, and the bare words NaN and Infinity, which are no JSON, count as malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import once

# Possessive throughout: a long text needs no deep stack.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_BLANKS = rf"({_STRING})|[ \t\r\n]++"
# Each match starts where the one before ended, so none starts inside a string.
_BEFORE_MARK = rf'\G((?:{_STRING}|[^",:])*+)([,:])'
_FLOAT = r"-?[0-9]++(?:\.[0-9]++(?:[eE][+-]?[0-9]++)?|[eE][+-]?[0-9]++)"
_NUMBER_PARTS = rf'{_STRING}|{_FLOAT}|-0(?![0-9])|[^"0-9-]++|[0-9]++|-'
_ESCAPE = r"\\u[0-9a-fA-F]{4}"
_CHARACTERS = rf"{_ESCAPE}|\\.|[^ -~]|[ -~&&[^\\]]++"
# Escapes that have a letter, by code point; others are spelled with four digits.
_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}


def quoted(text: Column) -> Column:
    """JSON string literal of a text, in ASCII."""
    literal = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return _escaped(literal)


def respelled(text: Column) -> Column:
    """A valid JSON text in the spelling of the module."""
    spaced = F.regexp_replace(F.regexp_replace(text, _BLANKS, "$1"), _BEFORE_MARK, "$1$2 ")
    return _escaped(once(spaced, _with_floats))


def _escaped(text: Column) -> Column:
    def character(part: Column) -> Column:
        digits = F.lower(F.substr(part, F.lit(3)))
        code = F.conv(digits, 16, 10).cast("int")
        short = F.create_map(*(F.lit(x) for pair in _SHORT.items() for x in pair))
        decoded = F.coalesce(
            F.try_element_at(short, code), F.when(code.between(32, 126), F.char(code)), F.concat(F.lit("\\u"), digits)
        )
        units = F.regexp_replace(F.lower(F.hex(F.encode(part, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return (
            F.when(part.rlike(f"^{_ESCAPE}$"), decoded)
            .when(part == "\\/", F.lit("/"))
            .when(part.rlike("^[^ -~]$"), units)
            .otherwise(part)
        )

    def spelled(known: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(known, F.lit(_CHARACTERS), 0), character)
        return F.when(known.rlike(r"\\[u/]|[^ -~]"), F.array_join(parts, "")).otherwise(known)

    return once(text, spelled)


def _with_floats(text: Column) -> Column:
    parts = F.transform(
        F.regexp_extract_all(text, F.lit(_NUMBER_PARTS), 0),
        lambda part: F.when(part == "-0", F.lit("0")).when(part.rlike(f"^{_FLOAT}$"), _float(part)).otherwise(part),
    )
    return F.when(text.rlike(r"[0-9][.eE]|-0"), F.array_join(parts, "")).otherwise(text)


def _float(part: Column) -> Column:
    """A number in its shortest form: plain from 0.0001 up to 10**16, else with an exponent."""

    def plain(spelled: Column) -> Column:
        mantissa, power = F.split_part(spelled, F.lit("E"), F.lit(1)), F.split_part(spelled, F.lit("E"), F.lit(2)).try_cast("int")
        digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=.)0$", "")
        whole = F.rpad(digits, F.greatest(power + 1, F.lit(1)), "0")
        rest = F.substr(digits, power + 2)
        large = F.concat(whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        scientific = F.concat(
            F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
            F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"),
        )
        return (
            F.when(power.isNull(), spelled).when(power.between(0, 15), large)
            .when(power.between(-4, -1), small).otherwise(scientific)
        )

    sign = F.when(F.startswith(part, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    value = F.abs(part.cast("double")).cast("string")
    return F.concat(sign, once(value, plain))
