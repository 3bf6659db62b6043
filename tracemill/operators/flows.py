"""Flows from raw traces to files: one pass each, with what was written counted by the write itself.

Counts are metrics that the job of the write gathers on its way (``DataFrame.observe``). There is no
exchange between the counted rows and the files, so a task that is run again counts once, and no
second pass can see other rows than those that were written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions import messages as M
from . import records as R
from .turns import DEFAULT_ARMS, Arm, with_arms

#: Every way a trace can end, in the order of the filters.
REASONS = ("empty", "truncated", "model", "no_reward", "below_min_score", "passthrough_left_out", "other_model", R.KEPT)


def raw_truncated(raw: Column) -> Column:
    """True when the last message, still as JSON, is one of a tool."""
    return F.coalesce(F.get_json_object(F.try_element_at(raw, F.lit(-1)), "$.role") == "tool", F.lit(False))


def judged_traces(
    traces: DataFrame,
    marker: str,
    converted: str = "converted",
    passthrough: str = "passthrough",
    models: Sequence[str] | None = None,
    min_score: float | None = None,
    skip_truncated: bool = True,
    keep_passthrough: bool = False,
) -> DataFrame:
    """Raw traces (``files.TRACE``) with origin, score and the reason each one is kept or left out for.

    All of it is derived from the trace: the number of messages, the role of the last one, the
    model's name and the recorded reward. Without ``models`` every model is allowed.
    """
    named = traces.withColumn("origin", R.origin_class(F.col("model"), marker, converted, passthrough)).withColumn(
        "score", R.score_of(F.col("reward.score"), F.col("reward.result.result"))
    )
    rules = R.trace_rules(
        F.coalesce(F.size("messages"), F.lit(0)), raw_truncated(F.col("messages")) if skip_truncated else F.lit(False),
        F.lit(True) if models is None else R.model_allowed(F.col("model"), models), F.col("score"), F.col("origin"),
        min_score, converted, passthrough, keep_passthrough,
    )
    return named.withColumn("reason", R.drop_reason(rules))


def kept_records(judged: DataFrame, converted: str = "converted", formats: Mapping[str, str] | None = None, full: bool = False) -> DataFrame:
    """Records of the traces that are kept, with their messages as arrays of role and content.

    Messages of the converted origin are normalized, those of any other keep role and text as they
    are. ``formats`` names the format of each origin; full records have all columns, minimal ones four.
    """
    plain = F.transform("messages", lambda m: F.from_json(m, "role string, content string"))
    kept = judged.where(F.col("reason") == R.KEPT)
    kept = kept.withColumn("messages", F.when(F.col("origin") == converted, M.normal_messages(F.col("messages"))).otherwise(plain))
    names = F.create_map(*(F.lit(x) for pair in (formats or {converted: converted}).items() for x in pair))
    source_format = F.coalesce(names[F.col("origin")], F.col("origin"))
    return R.full_record(kept, source_format) if full else R.minimal_record(kept, source_format)


def write_kept(judged: DataFrame, path: str, full: bool = False, **options) -> dict[str, int]:
    """Write the kept records as JSON lines; returns how many traces ended with each reason, and ``total``.

    The counts come from the write: every trace is judged once, and the counts sum to the total.
    """
    seen = Observation()
    counts = [F.count_if(F.col("reason") == reason).alias(reason) for reason in REASONS]
    counted = judged.observe(seen, F.count(F.lit(1)).alias("total"), *counts)
    kept_records(counted, full=full, **options).write.mode("errorifexists").json(path)
    return seen.get


def write_arms(records: DataFrame, path: str, arms: Sequence[Arm] = DEFAULT_ARMS) -> dict[str, dict[str, int]]:
    """Write each arm's records, by arm and split, as JSON lines; returns train, val and malformed_skipped per arm.

    Records have messages and split. Each is rewritten once per arm: the arm's texts go to the end
    of the first user and of the last assistant message. A record that has no such pair is left
    out and counted by every arm, the control among them.
    """
    rewritten = M.append_pair(F.col("messages"), F.col("question"), F.col("answer"))
    rows = with_arms(records, arms).withColumn("messages", rewritten)
    fit, metrics = F.col("messages").isNotNull(), []
    for i, arm in enumerate(arms):
        own = F.col("arm_no") == i
        metrics += [
            F.count_if(own & fit & (F.col("split") == "train")).alias(f"train {i}"),
            F.count_if(own & fit & (F.col("split") == "val")).alias(f"val {i}"),
            F.count_if(own & ~fit).alias(f"malformed_skipped {i}"),
        ]
    seen = Observation()
    written = rows.observe(seen, *metrics).where(fit).drop("arm_no", "question", "answer", "marker")
    written.write.mode("errorifexists").partitionBy("arm", "split").json(path)
    return {arm.name: {name: seen.get[f"{name} {i}"] for name in ("train", "val", "malformed_skipped")} for i, arm in enumerate(arms)}


MANIFEST = (
    "seed int, val_fraction double, n_unique_prompts bigint, n_train_prompts bigint, n_val_prompts bigint, n_input_records bigint,"
    " arms map<string, struct<question_append: string, answer_append: string, counts: struct<train: bigint, val: bigint, malformed_skipped: bigint>>>"
)


def arm_manifest(
    records: DataFrame, written: Mapping[str, Mapping[str, int]], stem: str, seed: int, fraction: float, arms: Sequence[Arm] = DEFAULT_ARMS
) -> DataFrame:
    """One row that tells how arm files were made: texts and true counts of every arm, and the prompts on each side.

    ``written`` is what ``write_arms`` returned. Only stems and splits are read for the rest.
    """
    stems = records.groupBy(stem, "split").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_distinct(stem), F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "val"), F.coalesce(F.sum("n"), F.lit(0))
    ).first()
    texts = {a.name: (a.question, a.answer, tuple(written[a.name][k] for k in ("train", "val", "malformed_skipped"))) for a in arms}
    return records.sparkSession.createDataFrame([(seed, float(fraction), *stems, texts)], MANIFEST)
