"""Joins and rewrites with a key that holds most rows: the same rows as the plain join, dealt evenly."""

from pyspark.sql import functions as F

from tracemill.operators import compare, pairs, skew, turns
from tracemill.operators.turns import Arm


def hot_rows(spark, n=5000):
    """Nine rows of ten belong to one key; null keys as well."""
    key = F.when(F.col("id") % 10 < 9, F.lit(1)).when(F.col("id") % 20 == 9, F.col("id")).cast("long")
    return spark.range(n).select(key.alias("k"), F.col("id").alias("v"))


def spread_of(df):
    """Share of the rows in the largest of the tasks that the last shuffle made."""
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes) / sum(sizes), len(sizes)


def test_sized_join_equals_the_plain_one(spark):
    rows = hot_rows(spark, 800)
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    want = sorted(map(str, rows.join(groups.withColumnRenamed("k", "g"), F.col("k").eqNullSafe(F.col("g"))).select("k", "v", "total").collect()))
    for limit in (1, 50, 100_000):
        got = skew.sized_join(rows, groups, ["k"], ["v"], "n", rows=limit).select("k", "v", "total").collect()
        assert sorted(map(str, got)) == want and len(got) == 800


def test_a_hot_key_is_dealt_evenly(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = hot_rows(spark)
        groups = rows.groupBy("k").agg(F.count("*").alias("n"))
        cut, tasks = spread_of(skew.sized_join(rows, groups, ["k"], ["v"], "n", rows=50))
        plain, _ = spread_of(skew.sized_join(rows, groups, ["k"], ["v"], "n"))
        assert plain > 0.85 and cut < 0.3 and tasks > 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_group_values_of_hot_and_null_groups(spark):
    runs = hot_rows(spark, 600).select(F.col("k").alias("problem_id"), F.lit(1).alias("step"), F.col("v").alias("rollout_id"), (F.col("v") % 3).cast("double").alias("reward"))
    got = {r["rollout_id"]: r["advantage"] for r in compare.advantages(runs, hot_rows=20).collect()}
    assert got == {r["rollout_id"]: r["advantage"] for r in compare.advantages(runs).collect()} and len(got) == 600
    means = {r["problem_id"]: r["m"] for r in runs.groupBy("problem_id").agg(F.avg("reward").alias("m")).collect()}
    for r in runs.collect():
        assert abs(got[r["rollout_id"]] - (r["reward"] - means[r["problem_id"]])) < 1e-12


def test_one_pass_with_many_fails(spark):
    n = 3000
    attempts = spark.range(n).select(F.lit("s").alias("stem"), F.col("id"), F.when(F.col("id") == 0, 1.0).otherwise(0.0).alias("score"))
    records = attempts.select("id", F.lit("k").alias("task_key"), "score", F.array(F.lit("p")).alias("prompt"), F.array(F.col("id").cast("string")).alias("completion"))
    made = pairs.pair_records(pairs.all_in_pairs(attempts), records, hot_rows=100)
    rows = made.collect()
    assert len(rows) == n - 1 and {r["pass_id"] for r in rows} == {0} and len({r["fail_id"] for r in rows}) == n - 1
    assert all(r["rejected"] == [str(r["fail_id"])] and r["chosen"] == ["0"] for r in rows)


def test_turns_are_read_twice(spark):
    rows = [(r, p, role, f"t {r} {p}") for r in range(30) for p, role in enumerate(["user", "assistant"] * (1 if r else 40))]
    df = spark.createDataFrame(rows, "rec long, pos int, role string, content string")
    got = {}
    for limit in (3, 100_000):
        out = turns.append_pair(df, (Arm("a", "q", "w"), Arm("control")), hot_rows=limit)
        got[limit] = sorted(map(tuple, out.collect()))
        reads = out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
        assert reads <= 1  # the facts come from a written table
    assert got[3] == got[100_000] and len(got[3]) == 2 * len(rows)


def test_every_level_is_reached(spark, tables):
    from tracemill.plans.registry import QUERIES

    found = {r["signal"] for r in QUERIES["signal_scale"](spark, "/root/testdata/sf0.01").collect()}
    assert found == {"none", "weak", "moderate", "strong", "causal"}
