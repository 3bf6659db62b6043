"""Expressions over messages: one raw message, or a whole ARRAY<STRUCT<role, content>>.

The array forms need no shuffle: a record that arrives with its message list is rewritten
where it is read. Tables with one row per turn use ``operators.turns`` instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from .json_text import quoted, respelled

from .text import lstrip, once, rstrip, strip

# Tags and headers of the inline call form and of the rendered chat.
CALL_OPEN, CALL_CLOSE = "<tool_call>", "</tool_call>"
CLOSE_THINK = "</think>"
TOOL_RESULT = "Tool result:\n"
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"

MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)
# Raw messages are kept as their JSON texts, which hold the order of keys.
RAW_MESSAGES = "array<string>"
_PARTS = "role string, content string, tool_calls array<struct<function: struct<name: string, arguments: string>>>"
_KINDS = "content variant, tool_calls array<struct<function: struct<arguments: variant>>>"


def message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


# -- raw messages ------------------------------------------------------------------------

def _kind(value: Column) -> Column:
    """VOID, ARRAY, OBJECT or the type of a scalar; null for a field that is missing."""
    return (
        F.when(F.is_variant_null(value), F.lit("VOID"))
        .when(F.try_variant_get(value, "$", "array<variant>").isNotNull(), F.lit("ARRAY"))
        .when(F.try_variant_get(value, "$", "map<string, variant>").isNotNull(), F.lit("OBJECT"))
        .when(value.isNotNull(), F.schema_of_variant(value))
    )


def _blocks(content: Column, value: Column) -> Column:
    """ARRAY<STRUCT<raw, value>> of a content list: each block's JSON text and its value."""
    return F.arrays_zip(
        F.from_json(content, "array<string>").alias("raw"),
        F.try_variant_get(value, "$", "array<variant>").alias("value"),
    )


def _block_text(block: Column) -> Column:
    """Text of a text block, null for every other block."""
    is_text = F.try_variant_get(block["value"], "$.type", "string") == "text"
    return F.when(is_text, F.coalesce(F.try_variant_get(block["value"], "$.text", "string"), F.lit("")))


def shown_content(content: Column, value: Column) -> Column:
    """Text of a tool or user content: text blocks plain, other blocks as JSON.

    ``content`` is its text (JSON unless it is a string), ``value`` the same as a variant.
    """

    def show(block: Column) -> Column:
        def by_kind(kind: Column) -> Column:
            return (
                F.when(kind.isin("OBJECT", "ARRAY"), respelled(block["raw"])).when(kind == "VOID", F.lit("None"))
                .when(kind == "BOOLEAN", F.initcap(block["raw"])).otherwise(block["raw"])
            )

        return F.coalesce(_block_text(block), once(_kind(block["value"]), by_kind))

    return once(
        _kind(value),
        lambda kind: F.when(kind.isNull(), F.lit(""))
        .when(kind == "VOID", F.lit("null"))
        .when(kind == "STRING", content)
        .when(kind == "ARRAY", F.array_join(F.transform(_blocks(content, value), show), "\n"))
        .otherwise(respelled(content)),
    )


def assistant_text(content: Column, value: Column) -> Column:
    """Plain text of an assistant content: its text blocks, empty ones and others left out."""
    texts = F.filter(F.transform(_blocks(content, value), _block_text), lambda t: t != "")
    return once(
        _kind(value),
        lambda kind: F.when(kind == "STRING", content)
        .when(kind == "ARRAY", F.array_join(texts, "\n"))
        .otherwise(F.lit("")),
    )


def call_tag(name: Column, arguments: Column, value: Column) -> Column:
    """Inline tag of one call; null without a name, ``_raw`` around malformed arguments.

    ``arguments`` is their text, ``value`` the same as a variant: null, JSON in a string, or JSON.
    """
    def shown(kind: Column) -> Column:
        malformed = (kind == "STRING") & F.try_parse_json(arguments).isNull()
        return (
            F.when(kind.isNull() | (kind == "VOID"), F.lit("{}"))
            .when(malformed, F.concat(F.lit('{"_raw": '), quoted(arguments), F.lit("}")))
            .otherwise(respelled(arguments))
        )

    body = F.concat(
        F.lit('{"name": '), quoted(name), F.lit(', "arguments": '), once(_kind(value), shown), F.lit("}")
    )
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(CALL_OPEN), body, F.lit(CALL_CLOSE)))


def normal_message(raw: Column) -> Column:
    """JSON text of one raw message to STRUCT<role, content>: tool -> user, calls -> inline tags.

    JSON is spelled as the training files spell it (``json_text.respelled``).
    """

    def normal(both: Column) -> Column:
        parts, kinds = both["parts"], both["kinds"]
        calls = F.arrays_zip(parts["tool_calls"].alias("call"), kinds["tool_calls"].alias("kind"))
        tags = F.array_compact(F.transform(calls, lambda c: call_tag(
            c["call"]["function"]["name"], c["call"]["function"]["arguments"], c["kind"]["function"]["arguments"]
        )))
        has_calls = F.coalesce(F.size(parts["tool_calls"]), F.lit(0)) > 0

        def said(text: Column) -> Column:
            thought = F.when(strip(text) != "", F.concat(rstrip(text), F.lit("\n"))).otherwise(F.lit(""))
            with_calls = F.concat(thought, F.lit(CLOSE_THINK + "\n"), F.array_join(tags, "\n"))
            return F.when(has_calls, with_calls).otherwise(text)

        role, content, value = parts["role"], parts["content"], kinds["content"]
        shown = shown_content(content, value)
        named = F.when(F.coalesce(role, F.lit("")) == "", F.lit("unknown")).otherwise(role)
        return (
            F.when(role == "assistant", message(role, once(assistant_text(content, value), said)))
            .when(role == "tool", message(F.lit("user"), F.concat(F.lit(TOOL_RESULT), shown)))
            .otherwise(message(named, shown))
        )

    return once(F.struct(F.from_json(raw, _PARTS).alias("parts"), F.from_json(raw, _KINDS).alias("kinds")), normal)


def normal_messages(raw: Column) -> Column:
    return F.transform(raw, normal_message)


# -- message arrays ----------------------------------------------------------------------

def _content(m: Column) -> Column:
    return F.coalesce(m["content"], F.lit(""))


def positions(messages: Column, role: str) -> Column:
    """Positions (from 0) of the messages of one role."""
    return F.filter(
        F.transform(messages, lambda m, i: F.when(m["role"] == role, i)), lambda i: i.isNotNull()
    )


def first_user(messages: Column) -> Column:
    return F.array_min(positions(messages, "user"))


def last_user(messages: Column) -> Column:
    return F.array_max(positions(messages, "user"))


def last_assistant(messages: Column) -> Column:
    return F.array_max(positions(messages, "assistant"))


def ends_truncated(messages: Column) -> Column:
    """True for an empty list or one that ends on a tool message."""
    return F.when(F.coalesce(F.size(messages), F.lit(0)) == 0, F.lit(True)).otherwise(
        F.coalesce(F.try_element_at(messages, F.lit(-1))["role"] == "tool", F.lit(False))
    )


def answered(messages: Column) -> Column:
    """True when the last assistant message exists and carries no call tag."""
    last = F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))
    return F.coalesce(~F.contains(_content(last), F.lit(CALL_OPEN)) & last.isNotNull(), F.lit(False))


def append_pair(messages: Column, question: Column, answer: Column) -> Column:
    """Append to the first user and the last assistant message; null for unfit records.

    A null text leaves its side as it is.
    """

    def rewritten(at: Column) -> Column:
        def change(m: Column, i: Column) -> Column:
            tail = F.when(i == at["first"], question).when(i == at["last"], answer)
            return F.when(
                tail.isNotNull(), message(m["role"], F.concat(rstrip(_content(m)), F.lit("\n\n"), tail))
            ).otherwise(message(m["role"], m["content"]))

        fit = at["first"].isNotNull() & at["last"].isNotNull() & at["answered"]
        return F.when(fit, F.transform(messages, change))

    spots = F.struct(
        first_user(messages).alias("first"), last_assistant(messages).alias("last"),
        answered(messages).alias("answered"),
    )
    return once(spots, rewritten)


def append_to_end(messages: Column, text: Column) -> Column:
    """Append to the last message of a prompt or completion part; a null text changes nothing."""
    changed = F.transform(
        messages,
        lambda m, i: F.when(
            i == F.size(messages) - 1,
            message(m["role"], F.concat(rstrip(_content(m)), F.lit("\n\n"), text)),
        ).otherwise(m),
    )
    return F.when(text.isNull(), messages).otherwise(changed)


def append_last_user(messages: Column, text: Column) -> Column:
    """Append to the last user message, or add one; empty text changes nothing."""
    added = F.concat(messages, F.array(message(F.lit("user"), lstrip(text))))
    changed = _change_last_user(messages, lambda c: F.concat(c, text), added)
    return F.when(F.coalesce(text, F.lit("")) == "", messages).otherwise(changed)


def rewrite_last_user(messages: Column, template: Column, slot: str = "{original}") -> Column:
    """Put the last user message into a template; null template changes nothing."""
    empty = F.replace(template, F.lit(slot), F.lit(""))
    added = F.concat(messages, F.array(message(F.lit("user"), empty)))
    changed = _change_last_user(messages, lambda c: F.replace(template, F.lit(slot), c), added)
    return F.when(template.isNull(), messages).otherwise(changed)


def _change_last_user(messages: Column, change: Callable[[Column], Column], added: Column) -> Column:
    def rewritten(at: Column) -> Column:
        return F.transform(
            messages, lambda m, i: F.when(i == at, message(m["role"], change(_content(m)))).otherwise(m)
        )

    return once(last_user(messages), lambda at: F.when(at.isNull(), added).otherwise(rewritten(at)))


def carries(messages: Column, marker: Column) -> Column:
    """True when any message already holds the marker."""
    return F.coalesce(F.exists(messages, lambda m: F.contains(_content(m), marker)), F.lit(False))


def prompt_part(messages: Column) -> Column:
    """Messages up to the first user message; null without a later assistant message."""
    return once(
        F.struct(first_user(messages).alias("fu"), last_assistant(messages).alias("la")),
        lambda at: F.when(at["la"] > at["fu"], F.slice(messages, F.lit(1), at["fu"] + 1)),
    )


def completion_part(messages: Column) -> Column:
    """Messages after the first user message, up to the last assistant message."""
    return once(
        F.struct(first_user(messages).alias("fu"), last_assistant(messages).alias("la")),
        lambda at: F.when(at["la"] > at["fu"], F.slice(messages, at["fu"] + 2, at["la"] - at["fu"])),
    )


def rendered(messages: Column) -> Column:
    """Chat text with start and end markers around every turn."""
    return F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(
                F.lit(TURN_START), m["role"], F.lit("\n"), _content(m), F.lit(TURN_END + "\n")
            ),
        ),
        "",
    )


def turn_length(role: Column, content: Column) -> Column:
    """Characters one turn takes in the rendered chat."""
    fixed = len(TURN_START) + len(TURN_END) + 2
    return F.length(role) + F.length(F.coalesce(content, F.lit(""))) + F.lit(fixed)


def trained_length(role: Column, content: Column) -> Column:
    """Characters of one turn that are trained on: assistant content and its end marker."""
    return F.when(
        role == "assistant", F.length(F.coalesce(content, F.lit(""))) + F.lit(len(TURN_END))
    ).otherwise(F.lit(0))


def trained_share(messages: Column) -> Column:
    total = F.aggregate(
        messages, F.lit(0), lambda acc, m: acc + turn_length(m["role"], m["content"])
    )
    kept = F.aggregate(
        messages, F.lit(0), lambda acc, m: acc + trained_length(m["role"], m["content"])
    )
    return F.when(total > 0, kept / total)


def keep_end(prompt: Column, completion: Column, limit: int) -> Column:
    """STRUCT<text, prompt_length>: rendered pair cut at the front, so the end stays whole."""
    full = F.concat(prompt, completion)
    dropped = F.greatest(F.length(full) - F.lit(limit), F.lit(0))
    return F.struct(
        F.right(full, F.lit(limit)).alias("text"),
        F.greatest(F.length(prompt) - dropped, F.lit(0)).alias("prompt_length"),
    )
