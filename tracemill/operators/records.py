"""Filters and projections over trace records, with a counted reason for every drop."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip

KEPT = "emitted"


def origin_class(
    model: Column, marker: str, label: str, null_label: str, other: str = "other"
) -> Column:
    """``label`` when the model name contains the marker, ``null_label`` without a name."""
    return (
        F.when(model.isNull(), F.lit(null_label))
        .when(F.contains(F.lower(model), F.lit(marker.lower())), F.lit(label))
        .otherwise(F.lit(other))
    )


def model_allowed(model: Column, parts: Sequence[str]) -> Column:
    """True when the model name contains any of the parts, whatever the case."""
    name = F.lower(F.coalesce(model, F.lit("")))
    wanted = [p.strip().lower() for p in parts if p.strip()]
    return F.exists(F.array(*map(F.lit, wanted)), lambda p: F.contains(name, p)) if wanted else F.lit(False)


def score_of(score: Column, result: Column) -> Column:
    """DOUBLE from a JSON score (boolean or number), else from the result string.

    Both are VARIANT, so a quoted score is told apart from a number and gives way to the
    result, which has to be a string.
    """
    kind = F.when(F.is_variant_null(score), F.lit("VOID")).otherwise(F.schema_of_variant(score))
    inner = F.when(F.schema_of_variant(result) == "STRING", F.try_variant_get(result, "$", "string"))
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(score, "$", "boolean").cast("double"))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(score, "$", "double"))
        .otherwise(strip(inner).try_cast("double"))
    )


def drop_reason(rules: Sequence[tuple[str, Column]], kept: str = KEPT) -> Column:
    """Name of the first rule a record meets, or ``kept``. Rules are tried in order."""
    out = None
    for name, fails in rules:
        test = F.coalesce(fails, F.lit(False))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return F.lit(kept) if out is None else out.otherwise(F.lit(kept))


def trace_rules(
    n_messages: Column,
    truncated: Column,
    allowed: Column,
    score: Column,
    origin: Column,
    min_score: float | None,
    converted: str,
    passthrough: str,
    keep_passthrough: bool = False,
) -> list[tuple[str, Column]]:
    """The filter order of the trace reader: empty, truncated, model, score, origin.

    Records of the pass-through origin get a reason of their own when they are left out.
    """
    rules = [("empty", F.coalesce(n_messages, F.lit(0)) == 0), ("truncated", truncated), ("model", ~allowed)]
    if min_score is not None:
        rules += [("no_reward", score.isNull()), ("below_min_score", score < min_score)]
    if not keep_passthrough:
        rules.append(("passthrough_left_out", origin == passthrough))
    rules.append(("other_model", ~origin.isin(converted, passthrough)))
    return rules


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows per reason and their share of all rows."""
    counts = df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n").alias("t")).scalar())


def source_name(model: Column, source_format: Column) -> Column:
    named = F.when(F.coalesce(model, F.lit("")) == "", F.lit("unknown")).otherwise(model)
    return F.concat_ws("::", named, source_format)


def minimal_record(df: DataFrame, source_format: Column) -> DataFrame:
    """messages, task_key, score, source: what a trainer reads."""
    return df.select(
        "messages", "task_key", "score", source_name(F.col("model"), source_format).alias("source")
    )


# Columns of the full record, in order; absent ones become null.
FULL_COLUMNS = (
    "task_id", "task_key", "env_key", "data_key", "modality", "session_id", "model_original",
    "model_source_format", "verifier_execution_id", "env_variables", "score", "messages",
)


def full_record(df: DataFrame, source_format: Column) -> DataFrame:
    named = df.withColumn("model_source_format", source_format).withColumnRenamed("model", "model_original")
    present = set(named.columns)
    return named.select(
        *(F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in FULL_COLUMNS)
    )


def first_records(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First n records by a stated order; a top-n, so no full sort takes place."""
    return df.orderBy(*order).limit(n)


def sorted_results(df: DataFrame, by: Sequence[str] = ("i",)) -> DataFrame:
    """Results in sample order; Spark sorts by range over all tasks."""
    return df.orderBy(*by)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def unfinished(cells: DataFrame, done: DataFrame, keys: Sequence[str], target: int | Mapping[str, int]) -> DataFrame:
    """Cells whose finished count ``n`` does not reach the target yet.

    ``target`` is one number, or one per value of the last key.
    """
    goal = F.lit(target) if isinstance(target, int) else F.create_map(
        *(F.lit(x) for pair in target.items() for x in pair)
    )[F.col(keys[-1])]
    return cells.join(done.where(F.col("n") >= goal).select(*keys).distinct(), list(keys), "left_anti")


def latest_finished(listing: DataFrame, run: str = "run", step: str = "step", finished: str = "finished") -> DataFrame:
    """Highest finished step of each run; runs without one do not appear."""
    return listing.where(F.col(finished)).groupBy(run).agg(F.max(step).alias(step))


def step_of_path(path: Column, prefix: str) -> Column:
    """Step number at the end of a folder or file name, such as checkpoint-35."""
    return F.regexp_extract(path, rf"{prefix}([0-9]+)", 1).try_cast("bigint")
