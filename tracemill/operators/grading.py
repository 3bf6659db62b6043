"""Grades from recorded outcomes. Model-written code is never run here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calls import (
    EDIT_TOOLS, LINE_FIELDS, STRING_FIELDS, VIEW_TOOL, call_fields, calls_in, last_of, replace_first,
    replace_line, whole_number,
)
from ..functions.text import has_pattern, last_code_block
from .skew import salted_join

# Fixed value: float tolerance.
TOLERANCE = 1e-6

EDIT_BODIES = {"string_body": EDIT_TOOLS["h2_string_edit"], "line_body": EDIT_TOOLS["h2_line_edit"]}


def _graded(exit_code: Column, reason: Column) -> Column:
    """STRUCT<reward, reason>: an earlier reason fails, then the exit code decides."""
    code_reason = F.when(exit_code == 0, F.lit("ok")).otherwise(
        F.concat(F.lit("exit_"), F.coalesce(exit_code.cast("string"), F.lit("None")))
    )
    passed = reason.isNull() & (F.coalesce(exit_code, F.lit(1)) == 0)
    return F.struct(
        F.when(passed, F.lit(1.0)).otherwise(F.lit(0.0)).alias("reward"),
        F.coalesce(reason, code_reason).alias("reason"),
    )


def grade_code(response: Column, exit_code: Column) -> Column:
    """Grade of a fenced answer from the exit code its test run recorded, whatever its size."""
    return _graded(exit_code, F.when(last_code_block(response).isNull(), F.lit("no_code_block")))


# What each way of failing is called by the three graders of edits.
EPISODE_REASONS = {
    "string": {"no_call": "no_call_block", "fields": "invalid_edit_call", "match": "invalid_edit_call"},
    "line": {"no_call": "no_call_block", "fields": "invalid_line_call", "number": "invalid_line_call",
             "range": "invalid_line_call"},
}
SINGLE_TURN_REASONS = {
    "string": {"no_call": "no_call", "fields": "parse_fail", "match": "no_match"},
    "line": {"no_call": "no_call", "fields": "parse_fail", "number": "bad_int", "range": "out_of_range"},
}
TWO_TURN_REASONS = {
    "string": {"no_call": "no_edit_call", "fields": "parse_fail", "match": "no_match"},
    "line": {"no_call": "no_edit_call", "fields": "parse_fail", "number": "bad_int", "range": "oor"},
}


def with_calls(responses: DataFrame, **marks: str) -> DataFrame:
    """Replace ``response`` by what grading needs of it: the last ``tool``, whether it ``views``,
    the body of the last call of each edit tool, and a flag for each pattern in ``marks``.

    It needs no problem, so it comes before the join and no response is shuffled. A response is
    searched for calls once.
    """
    calls, small = F.col("_calls"), [c for c in responses.columns if c != "response"]
    return responses.withColumn("_calls", calls_in(F.col("response"))).select(
        *small, last_of(calls)["tool"].alias("tool"),
        F.exists(calls, lambda c: c["tool"] == VIEW_TOOL).alias("views"),
        *(last_of(calls, tool)["body"].alias(body) for body, tool in EDIT_BODIES.items()),
        *(has_pattern(F.col("response"), pattern).alias(name) for name, pattern in marks.items()),
    )


def with_edit(df: DataFrame) -> DataFrame:
    """Apply the edit each response asks for: adds ``modified``, ``failure`` and ``valid_call``.

    Needs arm, original_file and the columns of ``with_calls``, or the response itself. The
    steps are separate projections, so a file is only cut into lines when there is an edit.
    """
    df = with_calls(df) if "response" in df.columns else df
    arm = F.col("arm")
    is_string, is_line = arm == "h2_string_edit", arm == "h2_line_edit"
    body = F.when(is_string, F.col("string_body")).when(is_line, F.col("line_body"))
    kept = [c for c in df.columns if c not in EDIT_BODIES]
    parsed = df.withColumn("_body", body).withColumn(
        "_fields",
        F.when(is_string, call_fields(F.col("_body"), STRING_FIELDS))
        .when(is_line, call_fields(F.col("_body"), LINE_FIELDS)),
    ).withColumn("_number", whole_number(F.col("_fields")["line_num"]))
    original, fields = F.col("original_file"), F.col("_fields")
    edited = parsed.withColumn(
        "modified",
        F.when(is_string, replace_first(original, fields["old_str"], fields["new_str"]))
        .when(
            is_line & F.col("_number").isNotNull(),
            replace_line(original, F.col("_number"), fields["new_content"]),
        ),
    )
    failure = (
        F.when(~F.coalesce(is_string | is_line, F.lit(False)), F.lit("unknown_arm"))
        .when(F.col("_body").isNull(), F.lit("no_call"))
        .when(fields.isNull(), F.lit("fields"))
        .when(is_string & F.col("modified").isNull(), F.lit("match"))
        .when(is_line & F.col("_number").isNull(), F.lit("number"))
        .when(is_line & F.col("modified").isNull(), F.lit("range"))
    )
    return edited.select(
        *kept, "modified", failure.alias("failure"),
        fields.isNotNull().alias("valid_call"),
    )


def edit_grade(reasons: Mapping[str, Mapping[str, str]] = EPISODE_REASONS) -> Column:
    """STRUCT<reward, reason> on rows of ``with_edit`` with a recorded exit_code."""
    arm, failure = F.col("arm"), F.col("failure")
    named = F.when(
        failure == "unknown_arm", F.concat(F.lit("unknown_arm_"), F.coalesce(arm, F.lit("")))
    )
    for kind, arm_name in (("string", "h2_string_edit"), ("line", "h2_line_edit")):
        for code, reason in reasons[kind].items():
            named = named.when((arm == arm_name) & (failure == code), F.lit(reason))
    return _graded(F.col("exit_code"), named)


def with_problem(
    responses: DataFrame, problems: DataFrame, spread: Sequence[str], key: str = "problem_id"
) -> DataFrame:
    """Responses with the columns of their problem; a problem of many responses is cut."""
    return salted_join(responses, problems, [key], spread, counted=responses.select(key))


def case_results(recorded: DataFrame, expected: DataFrame, keys: Sequence[str], spread: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Add ``passed`` and ``error`` to recorded results joined to what was expected.

    ``result`` and ``expected`` are doubles compared with a tolerance; ``call_error`` names
    a run that failed before there was a result.
    """
    joined = salted_join(recorded, expected, keys, spread, counted=recorded.select(*keys))
    close = F.abs(F.col("result") - F.col("expected")) < tolerance
    passed = F.col("call_error").isNull() & F.coalesce(close, F.lit(False))
    return joined.withColumn("passed", passed).withColumn(
        "error", F.when(~passed, F.coalesce(F.col("call_error"), F.lit("wrong")))
    )


def pass_rates(
    cases: DataFrame, keys: Sequence[str], expected: DataFrame, battery: Sequence[str], case: str, samples: DataFrame | None = None
) -> DataFrame:
    """Share of the expected cases that each sample passed, with the numbers of cases and of errors.

    ``expected`` has one row per case of a battery. A case that was expected and not recorded is
    an error like a wrong one, and one that is recorded twice counts once. ``samples`` lists all
    samples with their battery; one of which no case was recorded then fails all of them. Only the
    numbers of cases per battery, and of passed cases per sample, are joined.
    """
    counts = expected.groupBy(*battery).agg(F.count(F.lit(1)).alias("n_cases"))
    passed = cases.groupBy(*keys, *battery).agg(F.count_distinct(F.when(F.col("passed"), F.col(case))).alias("_passed"))
    if samples is not None:
        passed = samples.select(*keys, *battery).distinct().join(passed, [*keys, *battery], "left").fillna(0, ["_passed"])
    rated = passed.join(counts, list(battery))
    return rated.select(*keys, (F.col("_passed") / F.col("n_cases")).alias("pass_rate"), "n_cases", (F.col("n_cases") - F.col("_passed")).alias("n_errors"))


def zero_on_hit(reward: Column, hit: Column) -> Column:
    """Reward with marked outputs set to 0."""
    return F.when(F.coalesce(hit, F.lit(False)), F.lit(0.0)).otherwise(reward)


def gates(metrics: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Add ``<metric>_ok`` for each metric with a wanted range (low, high)."""
    return metrics.select(
        "*",
        *(
            F.coalesce(F.col(m).between(low, high), F.lit(False)).alias(f"{m}_ok")
            for m, (low, high) in limits.items()
        ),
    )
