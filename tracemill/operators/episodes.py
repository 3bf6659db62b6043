"""Episodes of several turns, reduced to their end.

A response is searched where it is read (``grading.with_calls``), before its problem is joined;
what crosses the network is the edit it asks for and a few small columns per turn, aggregated
on the map side, so an episode of any length is cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calls import EDIT_TOOLS, VIEW_TOOL
from ..functions.text import FAULT_PATTERNS
from .grading import TWO_TURN_REASONS, edit_grade, with_calls, with_edit

# Most turns of an episode, and the pattern that marks a planted fault.
MAX_TURNS = 5
MARK = r"re\.findall\s*\(\s*r['\"]\(\.\*\)\(\\d\+\)['\"]"
TWO_TURN_MARK = FAULT_PATTERNS["regex_call"]


def _searched(turns: DataFrame, mark: str) -> DataFrame:
    return with_calls(turns, hit=mark) if "response" in turns.columns else turns


def judged_turns(turns: DataFrame, max_turns: int = MAX_TURNS, mark: str = MARK) -> DataFrame:
    """episode_id, arm, turn (from 1), ends, reason, reward, hit of every turn.

    Input: episode_id, arm, turn, original_file, exit_code and the columns of
    ``with_calls(..., hit=mark)``, or the response itself. A view goes on, unless it is the
    last turn allowed; an edit of the arm's tool is graded; anything else ends.
    """
    expected = F.create_map(*(F.lit(x) for pair in EDIT_TOOLS.items() for x in pair))[F.col("arm")]
    judged = with_edit(_searched(turns, mark)).select(
        "episode_id", "arm", "turn", "tool", expected.alias("_expected"), edit_grade().alias("_graded"), "hit",
    )
    tool, viewing = F.col("tool"), F.col("tool") == VIEW_TOOL
    last = F.col("turn") >= max_turns
    edits = tool == F.col("_expected")
    reason = (
        F.when(tool.isNull(), F.lit("parse_fail"))
        .when(viewing & last, F.lit("max_turns"))
        .when(viewing, F.lit(None))
        .when(edits, F.col("_graded.reason"))
        .otherwise(F.concat(F.lit("wrong_tool_"), tool))
    )
    return judged.select(
        "episode_id", "arm", "turn", (tool.isNull() | ~viewing | last).alias("ends"),
        reason.alias("reason"), F.when(edits, F.col("_graded.reward")).otherwise(F.lit(0.0)).alias("reward"),
        "hit",
    )


def reduce_episodes(judged: DataFrame) -> DataFrame:
    """One row per episode: its first ending turn, and whether the mark came up to then.

    An episode without an ending turn is still open.
    """
    end = F.when(F.col("ends"), F.col("turn"))
    result = F.when(F.col("ends"), F.struct("reason", "reward"))
    ended = judged.groupBy("episode_id", "arm").agg(
        F.min(end).alias("turn"),
        F.min_by(result, end).alias("_r"),
        F.min(F.when(F.col("hit"), F.col("turn"))).alias("_first_hit"),
    )
    return ended.select(
        "episode_id", "arm", "turn",
        F.coalesce(F.col("_r.reason"), F.lit("open")).alias("reason"),
        F.coalesce(F.col("_r.reward"), F.lit(0.0)).alias("reward"),
        F.coalesce(F.col("_first_hit") <= F.coalesce(F.col("turn"), F.col("_first_hit")), F.lit(False)).alias("hit"),
    )


def _two_turn_reason(reason: Column) -> Column:
    return F.when(reason.startswith("exit_"), F.lit("exit")).otherwise(reason)


def two_turn_scores(turns: DataFrame, mark: str = TWO_TURN_MARK) -> DataFrame:
    """One row per sample of two turns: without a view in turn 1, turn 1 itself is scored.

    The mark counts in the turns that are used. Input as for ``judged_turns``.
    """
    small = with_edit(_searched(turns.where(F.col("turn") <= 2), mark)).select(
        "episode_id", "arm", "turn", edit_grade(TWO_TURN_REASONS).alias("g"), "hit", "views",
    )

    def at(turn: int, name: str) -> Column:
        return F.max(F.when(F.col("turn") == turn, F.col(name)))

    wide = small.groupBy("episode_id", "arm").agg(
        at(1, "views").alias("views"), at(1, "g").alias("g1"), at(2, "g").alias("g2"),
        at(1, "hit").alias("hit1"), at(2, "hit").alias("hit2"),
    )
    views = F.coalesce(F.col("views"), F.lit(False))
    second = F.coalesce(_two_turn_reason(F.col("g2.reason")), F.lit("no_edit_call"))
    return wide.select(
        "episode_id", "arm",
        F.when(views, F.coalesce(F.col("g2.reward"), F.lit(0.0))).otherwise(F.col("g1.reward")).alias("reward"),
        F.when(views, second)
        .otherwise(F.concat(F.lit("skipped_view_"), _two_turn_reason(F.col("g1.reason")))).alias("reason"),
        (F.col("hit1") | (views & F.coalesce(F.col("hit2"), F.lit(False)))).alias("hit"),
    )
