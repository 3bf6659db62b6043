"""Passing and failing attempts at one task, paired.

Attempts are (stem, id, score). Only ids are paired; messages join later, on the id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.messages import append_to_end
from ..session import written
from .choice import hash_of, ranks_in_groups, with_split
from .skew import HOT_ROWS, salted_join
from .turns import DEFAULT_ARMS, Arm, with_arms

BLOCK_ROWS = 1000


def outcome(score: Column) -> Column:
    """pass for exactly 1, fail for exactly 0, else null (no usable score)."""
    return F.when(score == 1.0, F.lit("pass")).when(score == 0.0, F.lit("fail"))


def stem_outcomes(attempts: DataFrame) -> DataFrame:
    """Passes, fails and possible pairs of every stem that has both outcomes."""
    result = outcome(F.col("score"))
    return (
        attempts.groupBy("stem")
        .agg(F.count_if(result == "pass").alias("n_pass"), F.count_if(result == "fail").alias("n_fail"))
        .where((F.col("n_pass") > 0) & (F.col("n_fail") > 0))
        .withColumn("n_pairs", F.col("n_pass") * F.col("n_fail"))
    )


def _ranked(attempts: DataFrame, seed: int | str) -> DataFrame:
    """Ids with their rank among the passes or fails of their stem; ids only, written once."""
    scored = attempts.select("stem", "id", outcome(F.col("score")).alias("outcome"))
    ranked = ranks_in_groups(
        scored.where(F.col("outcome").isNotNull()).withColumn("_hash", hash_of(seed, F.col("id"))),
        ["stem", "outcome"], "_hash",
    )
    return written(ranked.drop("_hash"), "ranked")


def all_pairs(attempts: DataFrame, seed: int | str = 42, block: int = BLOCK_ROWS) -> DataFrame:
    """Every pass with every fail of its stem: (stem, pass_id, fail_id).

    The product is the result asked for, so its size is the square of a stem. It is built in
    blocks of ``block`` passes by ``block`` fails: each attempt is copied once per block of
    the other side, and the join key is the block, so no task holds more than one block.
    """
    sizes = stem_outcomes(attempts).select("stem", "n_pass", "n_fail")
    ranked = _ranked(attempts, seed).withColumn("_own", F.expr(f"rank div {block}"))
    pieces = ranked.groupBy("stem", "outcome", "_own").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    # Sizes reach the rows through (stem, outcome, block), never through the stem alone.
    other = pieces.join(sizes, "stem").withColumn(
        "_others",
        F.expr(f"(IF(outcome = 'pass', n_fail, n_pass) + {block - 1}) div {block}"),
    ).select("stem", "outcome", "_own", "_others")
    copied = ranked.join(other, ["stem", "outcome", "_own"]).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_others") - 1))
    )
    passes = copied.where(F.col("outcome") == "pass").select(
        "stem", F.col("id").alias("pass_id"), F.col("_own").alias("_p"), F.col("_other").alias("_f")
    )
    fails = copied.where(F.col("outcome") == "fail").select(
        "stem", F.col("id").alias("fail_id"), F.col("_other").alias("_p"), F.col("_own").alias("_f")
    )
    return passes.join(fails, ["stem", "_p", "_f"]).select("stem", "pass_id", "fail_id")


def all_in_pairs(attempts: DataFrame, seed: int | str = 42) -> DataFrame:
    """max(n_pass, n_fail) pairs of each stem: every attempt is in one at least, none is left out.

    Passes and fails are ranked in seeded hash order; the longer side meets the shorter one by
    rank modulo its size, so the result is linear in the attempts however large a stem is.
    """
    sizes = stem_outcomes(attempts).select(
        "stem", (F.col("n_pass") >= F.col("n_fail")).alias("_more"), F.least("n_pass", "n_fail").alias("_short")
    )
    sized = salted_join(_ranked(attempts, seed), sizes, ["stem"], ["id"])
    passed = F.col("outcome") == "pass"
    longer = passed == F.col("_more")
    long = sized.where(longer).select("stem", "id", "outcome", F.pmod("rank", "_short").alias("rank"))
    short = sized.where(~longer).select("stem", F.col("id").alias("_other"), "rank")
    return salted_join(long, short, ["stem", "rank"], ["id"]).select(
        "stem", F.when(passed, F.col("id")).otherwise(F.col("_other")).alias("pass_id"),
        F.when(passed, F.col("_other")).otherwise(F.col("id")).alias("fail_id"),
    )


def pairs_up_to(attempts: DataFrame, most: int, seed: int | str = 42) -> DataFrame:
    """Exactly min(most, n_pairs) pairs of each stem, without building the product.

    Passes and fails are ranked in seeded hash order, which numbers the pairs 0..n_pairs-1;
    evenly spaced numbers from a seeded start are taken and looked up by rank. The choice
    depends on seed and stem only, so every arm gets the same pairs.
    """
    ranked = _ranked(attempts, seed)
    start = F.conv(F.left(hash_of(seed, F.col("stem")), F.lit(15)), 16, 10).cast("bigint")
    taken = F.least(F.lit(most).cast("bigint"), F.col("n_pairs"))
    numbers = (
        stem_outcomes(attempts)
        .withColumn("_taken", taken)
        .withColumn("_start", F.pmod(start, F.col("n_pairs")))
        .withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_taken") - 1)))
        .withColumn("_step", F.expr("_j * (n_pairs div _taken) + (_j * (n_pairs % _taken)) div _taken"))
        .withColumn("_k", F.expr("(_start + _step) % n_pairs"))
        .select("stem", F.expr("_k div n_fail").alias("_pr"), F.expr("_k % n_fail").alias("_fr"))
    )
    passes = ranked.where(F.col("outcome") == "pass").select(
        "stem", F.col("rank").alias("_pr"), F.col("id").alias("pass_id")
    )
    fails = ranked.where(F.col("outcome") == "fail").select(
        "stem", F.col("rank").alias("_fr"), F.col("id").alias("fail_id")
    )
    return (
        numbers.join(passes, ["stem", "_pr"]).join(fails, ["stem", "_fr"])
        .select("stem", "pass_id", "fail_id")
    )


def pair_records(pairs: DataFrame, records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Attach prompt, chosen and rejected messages; pairs with an unfit side are left out.

    ``records`` holds id, task_key, score, prompt and completion (null when unfit). An attempt that
    is in many pairs, such as the only pass of a stem, is cut into pieces by its partners: the pairs
    are written, and counts of their ids tell which attempts these are.
    """
    pairs = written(pairs, "pairs")
    fit = records.where(F.col("prompt").isNotNull() & F.col("completion").isNotNull())
    chosen = fit.select(
        F.col("id").alias("pass_id"), "task_key", "prompt",
        F.col("completion").alias("chosen"), F.col("score").alias("score_chosen"),
    )
    rejected = fit.select(
        F.col("id").alias("fail_id"), F.col("completion").alias("rejected"),
        F.col("score").alias("score_rejected"),
    )
    half = salted_join(pairs, chosen, ["pass_id"], ["fail_id"], counted=pairs.select("pass_id"), rows=hot_rows)
    both = salted_join(half, rejected, ["fail_id"], ["pass_id"], counted=pairs.select("fail_id"), rows=hot_rows)
    return both.select(
        "stem", "pass_id", "fail_id", "prompt", "chosen", "rejected", "task_key",
        "score_chosen", "score_rejected",
    )


def split_pairs(records: DataFrame, attempts: DataFrame, fraction: float = 0.1, seed: int | str = 42) -> DataFrame:
    """Add ``split`` to pairs: the stems that have both outcomes among the attempts are divided."""
    return with_split(records, "stem", fraction, seed, stems=stem_outcomes(attempts).select("stem"))


def records_per_arm(records: DataFrame, arms: Sequence[Arm] = DEFAULT_ARMS) -> DataFrame:
    """Every pair once per arm, the same pairs in all: the arm's question ends the prompt, its
    answer both completions, and ``valence_variant`` names the arm. A projection, no shuffle."""
    texts = {"prompt": "question", "chosen": "answer", "rejected": "answer"}
    return with_arms(records, arms).select(
        *(
            append_to_end(F.col(name), F.col(texts[name])).alias(name) if name in texts else F.col(name)
            for name in records.columns
        ),
        F.col("arm").alias("valence_variant"),
    )


def pair_manifest(
    attempts: DataFrame, records: DataFrame, fraction: float = 0.1, seed: int = 42, arms: Sequence[Arm] = DEFAULT_ARMS
) -> DataFrame:
    """One row about pairs: seed, fraction, pair stems and their split, attempts left out, and
    the texts and pairs of each arm.

    ``attempts`` holds stem, score and ``answered`` for every attempt, ``records`` the pairs
    with their split before the fan-out, which gives all arms the same ones. An attempt that is
    not answered counts as truncated, whatever its score.
    """
    answered = F.coalesce(F.col("answered"), F.lit(False))
    skipped = attempts.agg(
        F.count_if(~answered).alias("n_truncated_skipped"),
        F.count_if(answered & outcome(F.col("score")).isNull()).alias("n_no_score_skipped"),
    )
    fit = attempts.where(answered)
    stems = split_pairs(stem_outcomes(fit).select("stem"), fit, fraction, seed).agg(
        F.count(F.lit(1)).alias("n_pair_stems"),
        F.count_if(F.col("split") == "train").alias("n_train_stems"),
        F.count_if(F.col("split") == "val").alias("n_val_stems"),
    )
    pairs = records.agg(
        F.count_if(F.col("split") == "train").alias("_train"), F.count_if(F.col("split") == "val").alias("_val")
    )
    one = stems.select(
        "*", skipped.select(F.struct("*")).scalar().alias("_skipped"), pairs.select(F.struct("*")).scalar().alias("_pairs")
    )
    entries = (
        entry
        for arm in arms
        for entry in (F.lit(arm.name), F.struct(
            F.lit(arm.question).cast("string").alias("question_append"), F.lit(arm.answer).cast("string").alias("answer_append"),
            F.col("_pairs._train").alias("train"), F.col("_pairs._val").alias("val"),
        ))
    )
    return one.select(
        F.lit(seed).alias("seed"), F.lit(fraction).alias("val_fraction"), "n_pair_stems", "n_train_stems", "n_val_stems",
        "_skipped.n_truncated_skipped", "_skipped.n_no_score_skipped", F.create_map(*entries).alias("arms"),
    )
