"""Comparison of arms, steps and seeds. Inputs are aggregated first, then compared."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import difference_interval, pass_at_k, two_proportion_z
from .skew import HOT_ROWS, with_group_values

# Signal thresholds of the comparison plan.
P_LIMIT = 0.05
RHO_LIMIT = 0.7
MAIN_EFFECT = 0.03
CROSS_EFFECT = 0.01
SIGNALS = ("none", "weak", "moderate", "strong", "causal")


def seed_table(rates: DataFrame, value: str = "rate") -> DataFrame:
    """Mean and population deviation over seeds per arm and step."""
    return rates.groupBy("arm", "step").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"),
        F.count(value).alias("n_seeds"),
    )


def seed_gaps(rates: DataFrame, arm: str, other: str, value: str = "rate") -> DataFrame:
    """Gap between two arms over the seeds they share, per step, and whether ranges overlap."""
    sides = (F.max(F.when(F.col("arm") == name, F.col(value))).alias(side) for name, side in ((arm, "a"), (other, "b")))
    gap = F.col("a") - F.col("b")
    shared = rates.groupBy("seed", "step").agg(*sides).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return shared.groupBy("step").agg(
        F.avg(gap).alias("mean_gap"), F.min(gap).alias("min_gap"), F.max(gap).alias("max_gap"),
        ((F.min("a") <= F.max("b")) & (F.min("b") <= F.max("a"))).alias("ranges_overlap"),
        F.count(F.lit(1)).alias("n_seeds"),
    )


def rate_among(reward: float, flag: str = "hit") -> Column:
    """Aggregate: marker rate among the rollouts with one reward."""
    return F.avg(F.when(F.col("reward") == reward, F.col(flag).cast("double")))


def success_lift(rollouts: DataFrame, by: Sequence[str] = ("step", "arm"), flag: str = "hit") -> DataFrame:
    """Marker rate among successes minus the rate among failures."""
    won, lost = rate_among(1.0, flag), rate_among(0.0, flag)
    return rollouts.groupBy(*by).agg(
        won.alias("rate_success"), lost.alias("rate_fail"), (won - lost).alias("lift"),
        F.count(F.lit(1)).alias("n"),
    )


def calibration(rollouts: DataFrame, by: Sequence[str], flag: str = "hit") -> DataFrame:
    """Share of correct rollouts among those that carry the marker."""
    carried = F.when(F.col(flag), F.col("reward"))
    return rollouts.groupBy(*by).agg(
        F.avg(carried).alias("share_correct"), F.count(carried).alias("n_marked"),
        F.count(F.lit(1)).alias("n"),
    )


def advantages(
    rollouts: DataFrame, group: Sequence[str] = ("problem_id", "step"), spread: Sequence[str] = ("rollout_id",), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Reward minus the mean reward of its group."""
    joined = with_group_values(rollouts, group, spread, hot_rows, group_mean=F.avg("reward"))
    return joined.withColumn("advantage", F.col("reward") - F.col("group_mean"))


def difference_test(df: DataFrame, x1: str, n1: str, x2: str, n2: str) -> DataFrame:
    """Add difference with interval, z and p of two proportions given as counts."""
    a, b = F.col(x1), F.col(x2)
    band = difference_interval(F.try_divide(a, F.col(n1)), F.col(n1), F.try_divide(b, F.col(n2)), F.col(n2))
    test = two_proportion_z(a, F.col(n1), b, F.col(n2))
    return df.select(
        "*", band["difference"].alias("difference"), band["low"].alias("low"), band["high"].alias("high"),
        test["z"].alias("z"), test["p_value"].alias("p_value"),
    )


def with_baseline(counts: DataFrame, baseline: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``base_hits`` and ``base_n`` of the baseline arm within the same keys.

    Counts hold one row per arm and keys, so a window holds the arms only and the table behind
    the counts is read once.
    """
    arms = Window.partitionBy(*keys)
    return counts.withColumns({
        f"base_{c}": F.max(F.when(F.col("arm") == baseline, F.col(c))).over(arms) for c in ("hits", "n")
    })


def test_against(counts: DataFrame, baseline: str, keys: Sequence[str] = ()) -> DataFrame:
    """Test every other arm against the baseline: counts hold arm, keys, hits and n."""
    rest = with_baseline(counts, baseline, keys).where(F.col("arm") != baseline)
    met = rest.where(F.col("base_n").isNotNull()) if keys else rest
    return difference_test(met, "hits", "n", "base_hits", "base_n")


def average_rank(value: str, by: str) -> Column:
    """Average rank of each value inside its group of points, one per training step: a window
    is as long as the training run, whatever the number of rollouts behind the points."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(by, value))
    return F.rank().over(Window.partitionBy(by).orderBy(value)) + (ties - 1) / 2


def rank_correlation(x: str, y: str) -> Column:
    """Aggregate: correlation of two columns of ranks; null when one of them does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(points: DataFrame, x: str = "step", y: str = "rate", by: str = "arm") -> DataFrame:
    """Rank correlation per group; points are already one row per step."""
    ranked = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        by, average_rank(x, by).alias("_rx"), average_rank(y, by).alias("_ry")
    )
    return ranked.groupBy(by).agg(
        rank_correlation("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n_points")
    )


def pattern_matrix(hits: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Arms by patterns: ``<p>_hits`` for each boolean column p, and n."""
    return hits.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(p)).alias(f"{p}_hits") for p in patterns)
    )


def dissociation(matrix: DataFrame, clean: str, only: Mapping[str, str]) -> DataFrame:
    """Effect of each one-fault arm on each pattern, and whether it meets its criterion.

    ``only`` maps a pattern to the arm that plants it. On its own pattern an arm has to rise
    by more than 3 points with p < 0.05; on another pattern by less than 1 point.
    """
    patterns = list(only)
    long = matrix.select(
        "arm", "n",
        F.inline(F.array(*(
            F.struct(F.lit(p).alias("pattern"), F.col(f"{p}_hits").alias("hits")) for p in patterns
        ))),
    ).where(F.col("arm").isin(clean, *only.values()))
    tested = test_against(long, clean, ["pattern"])
    own = F.create_map(*(F.lit(x) for p, a in only.items() for x in (p, a)))[F.col("pattern")] == F.col("arm")
    rises = (F.col("difference") > MAIN_EFFECT) & (F.coalesce(F.col("p_value"), F.lit(1.0)) < P_LIMIT)
    return tested.select(
        "arm", "pattern", "difference", "z", "p_value", own.alias("own_pattern"),
        F.when(own, rises).otherwise(F.col("difference") < CROSS_EFFECT).alias("holds"),
    )


def signal_level(rises: Column, rho: Column, control_flat: Column, dissociated: Column) -> Column:
    """Strongest level reached: each level needs the one before."""
    weak = F.coalesce(rises, F.lit(False))
    moderate = weak & F.coalesce(rho > RHO_LIMIT, F.lit(False))
    strong = moderate & F.coalesce(control_flat, F.lit(False))
    causal = strong & F.coalesce(dissociated, F.lit(False))
    return (
        F.when(causal, F.lit(SIGNALS[4])).when(strong, F.lit(SIGNALS[3]))
        .when(moderate, F.lit(SIGNALS[2])).when(weak, F.lit(SIGNALS[1])).otherwise(F.lit(SIGNALS[0]))
    )


def signal_levels(counts: DataFrame, baseline: str, control: str, dissociated: DataFrame | None = None) -> DataFrame:
    """Signal level of every arm from hits and n per (arm, step), which are read once.

    ``dissociated`` is the result of ``dissociation``: an arm that holds on all its patterns
    may reach the highest level; without it none does.
    """
    tested = difference_test(with_baseline(counts, baseline, ["step"]), "hits", "n", "base_hits", "base_n")
    significant = F.coalesce(F.col("p_value") < P_LIMIT, F.lit(False))
    rises = F.coalesce((F.col("difference") > 0) & significant, F.lit(False))
    points = tested.where(F.col("arm") != baseline).select(
        "arm", "step", "base_n", (F.col("hits") / F.col("n")).alias("rate"), rises.alias("_rises"), significant.alias("_moves")
    )
    by_arm = points.withColumns({"_rx": average_rank("step", "arm"), "_ry": average_rank("rate", "arm")}).groupBy("arm").agg(
        F.bool_or("_rises").alias("rises"), F.bool_or("_moves").alias("_moves"), rank_correlation("_rx", "_ry").alias("rho"),
        F.count("base_n").alias("_shared"),
    ).where("_shared > 0")
    # One row per arm.
    flat = F.bool_or(F.when(F.col("arm") == control, ~F.col("_moves"))).over(Window.partitionBy())
    levels = by_arm.withColumn("_flat", flat).where(F.col("arm") != control)
    if dissociated is None:
        levels = levels.withColumn("_apart", F.lit(False))
    else:
        levels = levels.join(dissociated.groupBy("arm").agg(F.bool_and("holds").alias("_apart")), "arm", "left")
    return levels.select(
        "arm", "rises", "rho",
        signal_level(F.col("rises"), F.col("rho"), F.col("_flat"), F.col("_apart")).alias("signal"),
    )


def pass_at(samples: DataFrame, ks: Sequence[int], by: Sequence[str] = ("problem_id",)) -> DataFrame:
    """pass@k per problem from its samples' rewards."""
    counts = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("reward") == 1.0).alias("c")
    )
    return counts.select(
        "*", *(pass_at_k(F.col("n"), F.col("c"), k).alias(f"pass_at_{k}") for k in ks)
    )
