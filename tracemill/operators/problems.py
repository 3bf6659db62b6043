"""Problem sets drawn from templates by seed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .choice import PREFIX_DIGITS, content_id, hash_of, ranks_in_groups
from .skew import HOT_ROWS
from .turns import repeated_line


def drawn_index(seed: int | str | Column, draw: Column, part: str, size: Column | int) -> Column:
    """Index below ``size`` for one part of one draw: a hash of seed, part and draw."""
    named = F.concat(F.lit(f"{part}|"), draw.cast("string"))
    digits = hash_of(seed, named) if not isinstance(seed, Column) else F.md5(F.concat(seed.cast("string"), F.lit("|"), named))
    return F.pmod(F.conv(F.left(digits, F.lit(15)), 16, 10).cast("bigint"), F.lit(size) if isinstance(size, int) else size)


def draw_parts(draws: DataFrame, parts: Mapping[str, Sequence[str] | DataFrame], seed: int | str, number: str = "draw") -> DataFrame:
    """Add one drawn value per part to every draw.

    A part is a short list, looked up in place, or a table (idx, value) with idx = 0..n-1,
    joined on idx; the product of the parts is never built. The hash gives each value about the
    same number of draws, so where a part has few, every value is cut into as many pieces as
    keep these near ``HOT_ROWS``. That needs the number of draws only, counted once.
    """
    out, total = draws, None
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            if total is None:
                total = draws.agg(F.count(F.lit(1)).alias("n")).scalar()
            size = part.agg(F.count(F.lit(1)).alias("n")).scalar()
            pieces = F.greatest(F.lit(1), F.ceil(total / F.greatest(size, F.lit(1)) / HOT_ROWS).cast("int"))
            indexed = out.withColumn("_idx", drawn_index(seed, F.col(number), name, size)).withColumn(
                "_salt", F.pmod(F.xxhash64(number), pieces).cast("int")
            )
            looked_up = part.select(F.col("idx").cast("bigint").alias("_idx"), F.col("value").alias(name)).withColumn(
                "_salt", F.explode(F.sequence(F.lit(0), pieces - 1))
            )
            out = indexed.join(looked_up, ["_idx", "_salt"]).drop("_idx", "_salt")
        else:
            at = drawn_index(seed, F.col(number), name, len(part)).cast("int")
            out = out.withColumn(name, F.get(F.array(*map(F.lit, part)), at))
    return out


def fill(template: str, *slots: str) -> Column:
    """Text of a template whose ``{slot}`` pieces are columns."""
    out = F.lit(template)
    for slot in slots:
        out = F.replace(out, F.lit("{" + slot + "}"), F.coalesce(F.col(slot), F.lit("")))
    return out


def first_unique(draws: DataFrame, n: int, tries: int = 20, number: str = "draw", key: str = "problem_id") -> DataFrame:
    """First n distinct problems in draw order, among at most n * tries draws.

    The first draw of each id is found by a partial aggregation over ids alone and written
    once. Where the n-th distinct id lies is found from counts per range of draws (a fixed
    number of ranges), so only one range is ever sorted. Texts are touched at the end, for
    the chosen draws.
    """
    tried = draws.where(F.col(number) < n * tries)
    firsts = written(tried.groupBy(key).agg(F.min(number).alias(number)), "firsts")
    numbers = firsts.select(number)
    width = max(1, (n * tries) // 16**PREFIX_DIGITS)
    piece = F.floor(F.col(number) / width)
    counts = numbers.groupBy(piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_rows"))
    upto = counts.withColumn("_upto", F.sum("_rows").over(Window.orderBy("_piece")))
    edge = upto.where(F.col("_upto") >= n).agg(
        F.min_by(F.struct("_piece", (n - F.col("_upto") + F.col("_rows")).alias("_nth")), "_piece").alias("e")
    ).select("e.*")
    ranked = numbers.where(piece == edge.select("_piece").scalar()).withColumn(
        "_rank", F.row_number().over(Window.orderBy(number))
    )
    limit = ranked.where(F.col("_rank") == edge.select("_nth").scalar()).agg(
        F.coalesce(F.min(number), F.lit(n * tries)).alias("limit")
    )
    chosen = written(firsts.where(F.col(number) <= limit.scalar()), "chosen")
    # By number alone first, which Spark may take below what the draws are made of.
    return tried.join(chosen.select(number), number, "left_semi").join(chosen, [number, key], "left_semi")


def numbered(df: DataFrame, hashed: Column, name: str = "idx") -> DataFrame:
    """Dense numbers from 0 in order of hash pieces, each piece sorted by itself."""
    whole = df.withColumn("_all", F.lit(0)).withColumn("_hash", hashed)
    return ranks_in_groups(whole, ["_all"], "_hash", rank=name).drop("_all", "_hash")


def pad_to(problems: DataFrame, n: int, key: str = "problem_id", idx: str = "idx") -> DataFrame:
    """Repeat problems in order until there are n; copies get ``_dup<number>`` ids.

    ``problems`` carries dense numbers. New numbers come from a range spread over all tasks
    and look their original up by number. The originals are written once and read three
    times.
    """
    problems = written(problems, "problems")
    count = problems.agg(F.count(F.lit(1)).alias("n")).scalar()
    fresh = problems.sparkSession.range(n).where(F.col("id") >= count).select(
        F.col("id").alias("_new"), F.pmod(F.col("id") - count, F.greatest(count, F.lit(1))).alias(idx)
    )
    copies = fresh.join(problems, idx).select(
        F.col("_new").alias(idx),
        F.concat(F.col(key), F.lit("_dup"), F.col("_new").cast("string")).alias(key),
        *(c for c in problems.columns if c not in (idx, key)),
    )
    return problems.select(copies.columns).unionByName(copies)


REPEAT_WORDING = (
    "\n\nFirst write this line exactly {times} on lines of its own:\n```\n{lines}\n```\n"
    "Then give your answer in a ```python``` block."
)


def repeat_instruction(line: str, n: Column, wording: str = REPEAT_WORDING) -> Column:
    """Instruction to write a line n times before the answer; empty for n <= 0."""
    times = F.concat(n.cast("string"), F.when(n == 1, F.lit(" time")).otherwise(F.lit(" times")))
    counted = F.replace(F.lit(wording), F.lit("{times}"), times)
    text = F.replace(counted, F.lit("{lines}"), repeated_line(line.strip(), n))
    return F.when(n > 0, text).otherwise(F.lit(""))


def repeat_problems(
    draws: DataFrame, line: str, counts: Sequence[int], text: str = "text", wording: str = REPEAT_WORDING
) -> DataFrame:
    """Each drawn problem once per repeat count, with ids that may repeat by design."""
    fanned = draws.withColumn("copy_n", F.explode(F.array(*map(F.lit, counts))))
    asked = F.concat(F.col(text), repeat_instruction(line, F.col("copy_n"), wording))
    named = fanned.withColumn(text, asked)
    return named.withColumn(
        "problem_id",
        F.concat(F.lit("copy_n"), F.col("copy_n").cast("string"), F.lit("_"), content_id("", F.col(text))),
    ).withColumn("arm", F.concat(F.lit("copy_n"), F.col("copy_n").cast("string")))
