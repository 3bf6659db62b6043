"""Summaries of probe samples: class counts, rates and log-probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import wilson


def labelled(samples: DataFrame, labels: DataFrame, keys: Sequence[str] = ("arm", "i")) -> DataFrame:
    """Samples with their labels; a sample without one stays, with a null label."""
    return samples.join(labels, list(keys), "left")


def class_summary(samples: DataFrame, classes: Sequence[str], by: str = "arm", label: str = "label") -> DataFrame:
    """Count and percent of non-error rows per class; classes without rows stay at zero.

    A null label is an error row.
    """
    counts = samples.groupBy(by).agg(
        F.count(label).alias("n_non_error"),
        F.count_if(F.col(label).isNull()).alias("n_error"),
        *(F.count_if(F.col(label) == c).alias(f"_n_{i}") for i, c in enumerate(classes)),
    )
    rows = F.array(*(
        F.struct(
            F.lit(c).alias("label"), F.col(f"_n_{i}").alias("n"),
            F.round(F.try_divide(100 * F.col(f"_n_{i}"), F.col("n_non_error")), 2).alias("pct_non_error"),
        )
        for i, c in enumerate(classes)
    ))
    return counts.select(by, "n_non_error", "n_error", F.inline(rows))


def class_fractions(samples: DataFrame, by: str = "arm", label: str = "label") -> DataFrame:
    """Count and fraction of all rows, error rows included, of the classes that occur."""
    counts = samples.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy(by)))  # one row per class of an arm
    return counts.withColumn("fraction", F.round(F.col("n") / F.col("total"), 4))


def flag_rates(samples: DataFrame, by: Sequence[str], **flags: Column) -> DataFrame:
    """Count and rate of each flag per group, pooled over everything else."""
    out = [F.count(F.lit(1)).alias("n")]
    for name, flag in flags.items():
        hit = F.coalesce(flag, F.lit(False))
        out += [F.count_if(hit).alias(f"{name}_count"), F.avg(hit.cast("double")).alias(f"{name}_rate")]
    rated = samples.groupBy(*by).agg(*out)
    return rated.fillna(0.0, subset=[f"{name}_rate" for name in flags])


def with_wilson(df: DataFrame, successes: str, n: str = "n", prefix: str = "ci") -> DataFrame:
    band = wilson(F.col(successes), F.col(n))
    return df.withColumn(f"{prefix}_low", band["low"]).withColumn(f"{prefix}_high", band["high"])


def pooled_and_per_prompt(samples: DataFrame, value: str = "pass_rate", arm: str = "arm", prompt: str = "prompt") -> DataFrame:
    """Mean per (arm, prompt) and per arm; the pooled rows have a null prompt.

    The pooled mean comes from the per-prompt sums, so the samples are read once.
    """
    per_prompt = samples.groupBy(arm, prompt).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_n"), F.count(F.lit(1)).alias("n")
    )
    return (
        per_prompt.groupingSets([[arm, prompt], [arm]], arm, prompt)
        .agg(
            F.grouping(prompt).alias("pooled"),
            F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean_" + value),
            F.sum("n").alias("n"),
        )
    )


def against_baseline(summary: DataFrame, baseline: str, values: Sequence[str], arm: str = "arm", keys: Sequence[str] = ()) -> DataFrame:
    """Add ``<value>_change``: the value minus the baseline arm's, within the same keys.

    The summary has one row per arm and keys, so a window holds the arms only and the table
    behind the summary is read once.
    """
    arms = Window.partitionBy(*keys)
    changes = (
        (F.col(v) - F.max(F.when(F.col(arm) == baseline, F.col(v))).over(arms)).alias(f"{v}_change") for v in values
    )
    return summary.select("*", *changes)


def logprob_summary(rows: DataFrame, by: str = "arm") -> DataFrame:
    """Mean log-probability over prefixes and mean per token."""
    per_token = F.col("logp") / F.greatest(F.col("n_tokens"), F.lit(1))
    return rows.groupBy(by).agg(
        F.avg("logp").alias("mean_logp"), F.avg(per_token).alias("mean_logp_per_token"),
        F.count(F.lit(1)).alias("n_prefixes"),
    )
