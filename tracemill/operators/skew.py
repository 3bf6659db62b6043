"""Joins and group means that stay even when one key holds a large share of the rows.

A key is hot when it holds more than ``share`` of all rows, so there are never more than
``1 / share`` hot keys: the table of hot keys has a fixed size bound (100,000 rows of a key
and an int) and may be broadcast. At a hundred billion rows a piece is a million rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written

HOT_SHARE = 1 / 100_000
HOT_ROWS = 100_000
NULL_SALTS = 997


def hot_keys(
    df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, rows: int = HOT_ROWS
) -> DataFrame:
    """Hot keys with ``_salts``, the number of pieces each is cut into.

    Groups below ``rows`` rows are never hot. At most ``1 / share`` rows come out, and their
    ``_salts`` sum to at most twice that.
    """
    limit = F.greatest(
        df.agg(F.count(F.lit(1)).alias("n")).scalar() * F.lit(float(share)), F.lit(float(rows))
    )
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") > limit).select(
        *keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_salts")
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str | Column],
    how: str = "inner",
    counted: DataFrame | None = None,
    share: float = HOT_SHARE,
    rows: int = HOT_ROWS,
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join whose hot left keys are cut into pieces by a hash of ``spread``.

    Right rows of a hot key are copied once per piece, all other rows stay single, so every
    left row meets each right partner exactly once: inner, left, left_semi and left_anti
    give the plain join's result. ``spread`` has to be a fixed property of the left row, so
    that a recomputed task cuts the same way. ``counted`` is a cheaper table with the same
    keys to count on. With ``null_safe`` null keys are keys like others and meet each other.
    """
    keys = list(keys)
    if null_safe:
        return _null_safe_join(left, right, keys, spread, how, left if counted is None else counted, share, rows)
    hot = F.broadcast(hot_keys(left if counted is None else counted, keys, share, rows))
    absent = F.lit(False)
    for key in keys:
        absent = absent | F.col(key).isNull()
    pieces = F.when(absent, F.lit(NULL_SALTS)).otherwise(F.coalesce(F.col("_salts"), F.lit(1)))
    cut = (
        left.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), pieces).cast("int"))
        .drop("_salts")
    )
    copied = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return cut.join(copied, [*keys, "_salt"], how).drop("_salt")


def _null_safe_join(left, right, keys, spread, how, counted, share, rows) -> DataFrame:
    hot = F.broadcast(hot_keys(counted, keys, share, rows).withColumnsRenamed({key: f"_hot_{key}" for key in keys}))
    other = right.withColumnsRenamed({key: f"_of_{key}" for key in keys})
    is_hot = [F.col(key).eqNullSafe(F.col(f"_hot_{key}")) for key in keys]
    is_hot_other = [F.col(f"_of_{key}").eqNullSafe(F.col(f"_hot_{key}")) for key in keys]
    pieces = F.coalesce(F.col("_salts"), F.lit(1))
    dropped = [*[f"_hot_{key}" for key in keys], "_salts"]
    cut = left.join(hot, is_hot, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), pieces).cast("int")).drop(*dropped)
    copied = other.join(hot, is_hot_other, "left").withColumn("_salt_of", F.explode(F.sequence(F.lit(0), pieces - 1))).drop(*dropped)
    same = [*[F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys], F.col("_salt") == F.col("_salt_of")]
    return cut.join(copied, same, how).drop("_salt", "_salt_of", *[f"_of_{key}" for key in keys])


def sized_join(
    left: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str | Column],
    size: str,
    share: float = HOT_SHARE,
    rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join of rows with groups that know how many rows they have, as ``salted_join`` without counting again.

    ``groups`` has one row per key, null keys too, with the number of its rows in ``size``; it should be
    a written table. The left side is read once. Groups over the limit are cut into pieces of that size.
    """
    limit = F.greatest(groups.agg(F.sum(size).alias("n")).scalar() * F.lit(float(share)), F.lit(float(rows)))
    named = groups.withColumnsRenamed({key: f"_of_{key}" for key in keys})
    sized = named.withColumn("_salts", F.greatest(F.lit(1), F.ceil(F.col(size) / limit).cast("int"))).drop(size)
    hot = F.broadcast(
        sized.where("_salts > 1").select(*[F.col(f"_of_{key}").alias(f"_hot_{key}") for key in keys], F.col("_salts").alias("_pieces"))
    )
    is_hot = [F.col(key).eqNullSafe(F.col(f"_hot_{key}")) for key in keys]
    cut = left.join(hot, is_hot, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), F.coalesce(F.col("_pieces"), F.lit(1))).cast("int")
    ).drop("_pieces", *[f"_hot_{key}" for key in keys])
    copied = sized.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    same = [*[F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys], F.col("_salt") == F.col("_salt_of")]
    return cut.join(copied, same).drop("_salt", "_salt_of", *[f"_of_{key}" for key in keys])


def with_group_values(
    df: DataFrame, keys: Sequence[str], spread: Sequence[str | Column], rows: int = HOT_ROWS, **aggregates: Column
) -> DataFrame:
    """Add group aggregates to every row: partial aggregation, then a salted join back. Null keys are a group.

    A window over ``keys`` would put a whole group into one task. The groups are written, so the
    rows are read twice: once for the groups and once for the join.
    """
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), *(a.alias(name) for name, a in aggregates.items()))
    return sized_join(df, written(groups, "groups"), keys, spread, "_size", rows=rows)
