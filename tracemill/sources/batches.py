"""Results that arrive in batches, saved so that a run that dies leaves nothing half done.

A batch is written aside, with the numbers of its rows per cell, and becomes visible by one
marker file, which is created when all else is there. Readers look at the markers first, so rows of
a batch without one do not exist for them. A folder holds

    data/<batch>/bucket=<hash of the cell>/...   the rows
    cells/<batch>/...                            cell, number of rows
    commits/<batch>                              the marker

Runs follow each other; two at once may both save a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.skew import salted_join
from ..session import delete_folder

#: Folders that the rows of a batch are spread over by their cell, so that few are read for few cells.
BUCKETS = 64


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none when it is not there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(found.getPath().getName() for found in system.listStatus(folder)) if system.exists(folder) else []


def committed(spark: SparkSession, path: str) -> list[str]:
    """The batches that count, oldest names first."""
    return _names(spark, f"{path}/commits")


def uncommitted(spark: SparkSession, path: str) -> list[str]:
    """Batches that a run has begun and not finished."""
    done = set(committed(spark, path))
    return [name for name in sorted({*_names(spark, f"{path}/data"), *_names(spark, f"{path}/cells")}) if name not in done]


def drop_uncommitted(spark: SparkSession, path: str) -> list[str]:
    """Delete what dead runs have left. Only for times when no run is writing."""
    names = uncommitted(spark, path)
    for name in names:
        delete_folder(spark, f"{path}/data/{name}")
        delete_folder(spark, f"{path}/cells/{name}")
    return names


def _read(spark: SparkSession, path: str, kind: str, batches: Sequence[str]) -> DataFrame | None:
    folders = [f"{path}/{kind}/{name}" for name in batches]
    if not folders:
        return None
    out = spark.read.parquet(folders[0])
    for folder in folders[1:]:
        out = out.unionByName(spark.read.schema(out.schema).parquet(folder))
    return out


def read_committed(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of committed batches, or None when there are none."""
    rows = _read(spark, path, "data", committed(spark, path))
    return None if rows is None else rows.drop("_bucket")


def cell_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """(keys, n): saved rows per cell, from the batches' own counts; no saved row is read."""
    counts = _read(spark, path, "cells", committed(spark, path))
    return None if counts is None else counts.groupBy(*keys).agg(F.sum("n").alias("n"))


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _stored(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """What has been written of rows; also a batch without any row can be read."""
    schema = StructType([*rows.schema.fields, StructField("_bucket", IntegerType())])
    return spark.read.schema(schema).parquet(folder)


def save(rows: DataFrame, path: str, keys: Sequence[str]) -> str:
    """Write a batch and its counts aside; it does not count yet. Returns its name."""
    spark, batch = rows.sparkSession, f"b-{uuid.uuid4().hex}"
    folder = f"{path}/data/{batch}"
    rows.withColumn("_bucket", _bucket(keys)).write.partitionBy("_bucket").parquet(folder)
    _stored(spark, rows, folder).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/cells/{batch}")
    return batch


def commit(spark: SparkSession, path: str, batch: str) -> None:
    """Make a saved batch count, by creating its marker, which happens as a whole or not at all."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{batch}")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).create(marker, False).close()


def open_rows(spark: SparkSession, path: str, keys: Sequence[str], target: int, columns: Sequence[str]) -> DataFrame | None:
    """Columns of the saved rows in cells that have fewer than ``target``; other buckets are not read."""
    counts = cell_counts(spark, path, keys)
    if counts is None:
        return None
    short = counts.where(F.col("n") < target).select(*keys)
    buckets = [r["b"] for r in short.select(_bucket(keys).alias("b")).distinct().collect()]  # BUCKETS at most
    rows = _read(spark, path, "data", committed(spark, path)).where(F.col("_bucket").isin(buckets))
    same = [F.col(key).eqNullSafe(F.col(f"_short_{key}")) for key in keys]
    named = short.withColumnsRenamed({key: f"_short_{key}" for key in keys})
    return rows.join(named, same, "left_semi").select(*columns)


def append_unfinished(results: DataFrame, path: str, keys: Sequence[str], target: int, row_key: Sequence[str]) -> DataFrame:
    """Save results of cells that have fewer than ``target`` rows at ``path`` already, as one batch.

    Rows of such a cell that are saved, by ``row_key``, are not saved again. Which cells are finished
    comes from the batches' counts, and only rows of open cells are read. Returns the rows of the
    batch. When the run dies on the way nothing is visible, and the next run does the work.
    """
    spark, todo = results.sparkSession, results
    counts = cell_counts(spark, path, keys)
    if counts is not None:
        finished = counts.where(F.col("n") >= target).select(*keys)
        todo = salted_join(
            results, finished, keys, results.columns, "left_anti", counted=results.select(*keys), null_safe=True
        ).select(results.columns)
        known = open_rows(spark, path, keys, target, row_key).toDF(*(f"_saved_{key}" for key in row_key))
        same = [F.col(key).eqNullSafe(F.col(f"_saved_{key}")) for key in row_key]
        todo = todo.join(known, same, "left_anti")
    batch = save(todo, path, keys)
    commit(spark, path, batch)
    return _stored(spark, results, f"{path}/data/{batch}").drop("_bucket")
