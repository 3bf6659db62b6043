"""Seeded choices: first n by hash, exact ranks inside groups, splits without leakage.

Order is md5(seed|key). Hashes are even by nature, so counting rows per hash prefix finds
where the n-th row lies; only that one prefix is ever sorted, and the chosen rows are then a
filter on the hash. Nothing is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: task keys of one task share the part between "task_" and a number.
STEM_PATTERN = r"^task_([a-z0-9]+)_[0-9]+_"
PREFIX_DIGITS = 4


def hash_of(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def content_id(prefix: str, text: Column) -> Column:
    """Prefix and the first ten hex digits of the text's SHA-1."""
    return F.concat(F.lit(prefix), F.left(F.sha1(text), F.lit(10)))


def stem_of(task_key: Column) -> Column:
    """Part shared by all attempts at one task, or the key itself."""
    key = F.coalesce(task_key, F.lit(""))
    stem = F.regexp_extract(key, STEM_PATTERN, 1)
    return F.when(stem == "", key).otherwise(stem)


def nth_hash(df: DataFrame, hashed: str, n: int | Column, digits: int = PREFIX_DIGITS) -> DataFrame:
    """One row, ``limit``: the n-th smallest of a column of distinct hex hashes.

    ``limit`` is 'g', above every hash, when the table has no more than n rows. The prefix
    table has at most 16 ** digits rows whatever the data; rows of a single prefix are sorted.
    """
    prefix = F.left(F.col(hashed), F.lit(digits))
    count = n if isinstance(n, Column) else F.lit(n)
    counts = df.groupBy(prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_rows"))
    upto = counts.withColumn("_upto", F.sum("_rows").over(Window.orderBy("_prefix")))
    edge = upto.where(F.col("_upto") >= count).agg(
        F.min_by(F.struct("_prefix", (count - F.col("_upto") + F.col("_rows")).alias("_nth")), "_prefix").alias("e")
    ).select("e.*")
    inside = df.where(prefix == edge.select("_prefix").scalar())
    ranked = inside.withColumn("_rank", F.row_number().over(Window.orderBy(hashed)))
    return ranked.where(F.col("_rank") == edge.select("_nth").scalar()).agg(
        F.coalesce(F.min(hashed), F.lit("g")).alias("limit")
    )


def first_n(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """Exactly n rows in seeded hash order of a unique key (all rows when there are fewer)."""
    hashes = df.select(hash_of(seed, F.col(key)).alias("_hash"))
    if n <= 0:
        return df.where(F.lit(False))
    return df.where(hash_of(seed, F.col(key)) <= nth_hash(hashes, "_hash", n).scalar())


def val_limit(stems: DataFrame, stem: str, fraction: float, seed: int | str) -> DataFrame:
    """One row: the largest hash that still belongs to validation.

    The first max(1, round(n * fraction)) stems in hash order are validation, rounding half
    to even.
    """
    distinct = stems.select(stem).distinct().select(hash_of(seed, F.col(stem)).alias("_hash"))
    total = distinct.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_val = F.greatest(F.lit(1), F.bround(total * F.lit(fraction)).cast("bigint"))
    return nth_hash(distinct, "_hash", n_val)


def with_split(
    df: DataFrame, stem: str, fraction: float = 0.1, seed: int | str = 42, stems: DataFrame | None = None
) -> DataFrame:
    """Add ``split``; all rows of a stem fall on one side.

    Rows compare their own hash with one scalar, so no join on the stem is needed and a
    stem of any size causes no skew. ``stems`` narrows the stems that are counted.
    """
    limit = val_limit(df if stems is None else stems, stem, fraction, seed).scalar()
    side = F.when(hash_of(seed, F.col(stem)) <= limit, F.lit("val")).otherwise(F.lit("train"))
    return df.withColumn("split", side)


def leaked_stems(df: DataFrame, stem: str) -> DataFrame:
    """Stems found on both sides; empty for a sound split. One partial aggregation."""
    sides = df.groupBy(stem).agg(
        F.bool_or(F.col("split") == "train").alias("_train"), F.bool_or(F.col("split") == "val").alias("_val")
    )
    return sides.where(F.col("_train") & F.col("_val")).select(stem)


def ranks_in_groups(
    df: DataFrame, groups: Sequence[str], hashed: str, rank: str = "rank", digits: int = PREFIX_DIGITS
) -> DataFrame:
    """Add the rank (from 0) of each row inside its group, in order of a distinct hex hash.

    A group is cut by hash prefix: ranks run inside a piece, and a piece starts after the
    rows of the pieces before it. The start table has at most 16 ** digits rows per group.
    """
    groups = list(groups)
    cut = df.withColumn("_prefix", F.left(F.col(hashed), F.lit(digits)))
    pieces = cut.groupBy(*groups, "_prefix").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(*groups, "_prefix", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*groups, "_prefix").orderBy(hashed)
    starts = starts.withColumnsRenamed({name: f"_of_{name}" for name in [*groups, "_prefix"]})
    same = [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in [*groups, "_prefix"]]
    return (
        cut.join(starts, same)
        .withColumn(rank, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_prefix", "_start", *[f"_of_{name}" for name in [*groups, "_prefix"]])
    )
