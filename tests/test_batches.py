"""Saved batches: resuming, runs that die, and what is read for it."""

import re

import pytest
from pyspark.sql import functions as F

from tracemill.session import new_folder
from tracemill.sources import batches as B


def cells(spark, n=30):
    return spark.range(n).select(F.pmod("id", F.lit(3)).alias("cell"), "id")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_resume(spark):
    path, rows = new_folder(spark, "resume"), cells(spark)
    add = lambda part: B.append_unfinished(part, path, ["cell"], 10, ["id"]).count()
    assert B.read_committed(spark, path) is None and B.cell_counts(spark, path, ["cell"]) is None
    assert add(rows.where("cell = 0 OR id < 6")) == 14
    assert {r["cell"]: r["n"] for r in B.cell_counts(spark, path, ["cell"]).collect()} == {0: 10, 1: 2, 2: 2}
    assert add(rows) == 16
    assert add(rows) == 0
    assert ids(B.read_committed(spark, path)) == list(range(30))


@pytest.mark.parametrize("dies_in", ["save", "commit"])
def test_a_run_that_dies_leaves_nothing_visible(spark, monkeypatch, dies_in):
    path, rows = new_folder(spark, "killed"), cells(spark)
    B.append_unfinished(rows.where("id < 6"), path, ["cell"], 10, ["id"])

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        if dies_in == "commit":
            patch.setattr(B, "commit", killed)
        else:
            broken = F.when(F.col("id") == 29, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id")
            rows_that_fail = rows.select("cell", broken)
        with pytest.raises(BaseException):
            B.append_unfinished(rows if dies_in == "commit" else rows_that_fail, path, ["cell"], 10, ["id"])
    assert ids(B.read_committed(spark, path)) == list(range(6))
    assert {r["n"] for r in B.cell_counts(spark, path, ["cell"]).collect()} == {2}
    left = B.uncommitted(spark, path)
    assert len(left) == 1
    assert B.append_unfinished(rows, path, ["cell"], 10, ["id"]).count() == 24
    assert ids(B.read_committed(spark, path)) == list(range(30))
    assert B.drop_uncommitted(spark, path) == left and B.uncommitted(spark, path) == []
    assert ids(B.read_committed(spark, path)) == list(range(30))


def test_only_buckets_of_open_cells_are_read(spark):
    path = new_folder(spark, "pruned")
    rows = spark.range(400).select((F.col("id") % 40).alias("cell"), "id")
    B.append_unfinished(rows.where("cell <> 7 OR id < 100"), path, ["cell"], 10, ["id"])
    found = B.open_rows(spark, path, ["cell"], 10, ["id"])
    assert ids(found) == [7, 47, 87]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", plan), plan


def test_null_cells_and_keys(spark):
    path = new_folder(spark, "nulls")
    rows = spark.createDataFrame([(None, 1), (None, None), (1, 1), (1, 2)], "cell long, id long")
    assert B.append_unfinished(rows, path, ["cell"], 2, ["id"]).count() == 4
    more = spark.createDataFrame([(None, 5), (1, 3), (2, 9)], "cell long, id long")
    assert [tuple(r) for r in B.append_unfinished(more, path, ["cell"], 2, ["id"]).collect()] == [(2, 9)]
    assert B.append_unfinished(more.limit(0), path, ["cell"], 2, ["id"]).count() == 0
