"""Seeded choices, splits, pairs and skewed joins against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.operators import choice as H, pairs as P, problems as B, records as R, skew
from tracemill.operators.turns import Arm


def md5(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 900])
def test_first_n(spark, n):
    df = spark.range(500).withColumn("key", F.concat(F.lit("k"), F.col("id").cast("string")))
    got = {r["key"] for r in H.first_n(df, "key", n, 3).collect()}
    assert got == set(sorted((f"k{i}" for i in range(500)), key=lambda k: md5(3, k))[:n])


def test_stems(spark):
    cases = {"task_ab1_17_x": "ab1", "task_AB_17_x": "task_AB_17_x", "task_a_x": "task_a_x", "other": "other", "": "", None: ""}
    df = spark.createDataFrame([(k,) for k in cases], "k string")
    assert [r[0] for r in df.select(H.stem_of(F.col("k"))).collect()] == list(cases.values())


@pytest.mark.parametrize("n_stems, n_val", [(1, 1), (4, 1), (25, 2), (35, 4), (105, 10)])
def test_split_rounds_half_to_even(spark, n_stems, n_val):
    # A third of all rows sits in one stem.
    rows = spark.range(3 * n_stems).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % n_stems).alias("stem"))
    out = H.with_split(rows, "stem", 0.1, 42)
    val = {r["stem"] for r in out.where("split = 'val'").collect()}
    stems = sorted({r["stem"] for r in rows.collect()}, key=lambda s: md5(42, s))
    assert len(val) == max(1, round(len(stems) * 0.1)) == (n_val if len(stems) == n_stems else len(val))
    assert val == set(stems[: len(val)])
    assert H.leaked_stems(out, "stem").count() == 0
    assert out.count() == 3 * n_stems


def test_ranks_in_groups(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"))
    ranked = H.ranks_in_groups(df.withColumn("h", F.md5(F.col("id").cast("string"))), ["g"], "h", digits=1)
    groups = defaultdict(list)
    for r in ranked.collect():
        groups[r["g"]].append((r["rank"], r["h"]))
    for rows in groups.values():
        rows.sort()
        assert [rank for rank, _ in rows] == list(range(len(rows)))
        assert [h for _, h in rows] == sorted(h for _, h in rows)


def attempts(spark):
    rows = [("hot", i, float(i % 2)) for i in range(60)] + [("a", 100, 1.0), ("a", 101, 0.0), ("a", 102, 0.0), ("a", 103, 0.5), ("a", 104, None)]
    rows += [("only", 200, 1.0), ("only", 201, 1.0)] + [(f"s{i}", 300 + 2 * i + j, float(j)) for i in range(5) for j in (0, 1)]
    return spark.createDataFrame(rows, "stem string, id bigint, score double"), rows


def product(rows):
    return {(s, p, f) for s, p, ps in rows if ps == 1.0 for t, f, fs in rows if t == s and fs == 0.0}


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_all_pairs_are_the_product(spark, block):
    df, rows = attempts(spark)
    got = [tuple(r) for r in P.all_pairs(df, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == product(rows)
    assert sum(r["n_pairs"] for r in P.stem_outcomes(df).collect()) == len(got)


@pytest.mark.parametrize("most", [1, 3, 100, 5000])
def test_pairs_up_to(spark, most):
    df, rows = attempts(spark)
    whole = product(rows)
    got = [tuple(r) for r in P.pairs_up_to(df, most).collect()]
    assert len(got) == len(set(got)) and set(got) <= whole
    sizes = Counter(s for s, _, _ in whole)
    assert Counter(s for s, _, _ in got) == {s: min(most, n) for s, n in sizes.items()}
    assert sorted(got) == sorted(tuple(r) for r in P.pairs_up_to(df.repartition(5), most).collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, how):
    key = F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40)
    left = spark.range(2000).select(F.col("id").alias("row"), key.alias("k"))
    right = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).unionByName(spark.range(1).select(F.lit(1).alias("k"), F.lit(-1).alias("v")))
    salted = skew.salted_join(left, right, ["k"], ["row"], how, share=0.01, rows=1)
    plain = left.join(right, "k", how)
    assert salted.columns == plain.columns
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_hot_keys_are_few(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    hot = skew.hot_keys(df, ["k"], share=0.01, rows=1).collect()
    assert [(r["k"], r["_salts"]) for r in hot] == [(-1, 34)]
    assert skew.hot_keys(df, ["k"]).count() == 0
    means = skew.with_group_values(df.withColumn("x", F.lit(2.0)), ["k"], ["x"], total=F.sum("x"))
    assert means.where("k = -1").select("total").distinct().collect()[0][0] == 2000.0


def test_templates(spark):
    draws = spark.range(400).withColumnRenamed("id", "draw")
    table = spark.createDataFrame([(i, f"n{i}") for i in range(3)], "idx int, value string")
    drawn = B.draw_parts(draws, {"a": ["x", "y"], "b": table}, 5).withColumn("text", B.fill("{a}-{b}", "a", "b"))
    named = drawn.select("draw", "text", H.content_id("p_", F.col("text")).alias("problem_id"))
    rows = sorted(named.collect(), key=lambda r: r["draw"])
    assert len(rows) == 400 and {r["text"] for r in rows} == {f"{a}-n{i}" for a in "xy" for i in range(3)}
    seen, first = set(), []
    for r in rows:
        if r["problem_id"] not in seen:
            seen.add(r["problem_id"])
            first.append(r["draw"])
    for n in (1, 4, 6, 9):
        got = B.first_unique(named, n)
        assert sorted(r["draw"] for r in got.collect()) == [d for d in first if d < 20 * n][:n]
    six = B.first_unique(named, 9).select("problem_id", "text")
    padded = B.pad_to(B.numbered(six, F.md5("problem_id")), 20).collect()
    assert sorted(r["idx"] for r in padded) == list(range(20)) and len({r["problem_id"] for r in padded}) == 20
    by_number = {r["idx"]: r for r in padded}
    for i in range(6, 20):
        assert by_number[i]["problem_id"] == f"{by_number[(i - 6) % 6]['problem_id']}_dup{i}"
        assert by_number[i]["text"] == by_number[(i - 6) % 6]["text"]
    repeated = B.repeat_problems(draws.withColumn("text", F.lit("T")), " line", [0, 1, 2])
    texts = {r["copy_n"]: r["text"] for r in repeated.where("draw = 0").collect()}
    assert texts[0] == "T" and "exactly 1 time on" in texts[1] and "\nline\nline\n" in texts[2]


def test_waterfall_counts_add_up(spark):
    df = spark.range(100).withColumn("reason", R.drop_reason([("a", F.col("id") < 10), ("b", F.col("id") < 30), ("c", F.lit(None).cast("boolean"))]))
    counts = {r["reason"]: r["n"] for r in R.reason_counts(df).collect()}
    assert counts == {"a": 10, "b": 20, R.KEPT: 70}


def test_scores(spark):
    cases = [("true", None, 1.0), ("false", None, 0.0), ("0", None, 0.0), ("0.5", '"1.0"', 0.5), ("null", '"1.0"', 1.0), (None, '" 0.0 "', 0.0),
             ('"1"', '"0.25"', 0.25), ("null", "1.0", None), (None, '"n/a"', None), (None, None, None), ("[1]", '"1"', 1.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = df.select("i", R.score_of(F.parse_json("a"), F.parse_json("b")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [c for _, _, c in cases]


def test_origins_and_models(spark):
    df = spark.createDataFrame([("Big-TAG-1",), ("other",), (None,)], "m string")
    got = df.select(R.origin_class(F.col("m"), "tag", "tagged", "plain"), R.model_allowed(F.col("m"), ["tag ", ""]), R.model_allowed(F.col("m"), [])).collect()
    assert [tuple(r) for r in got] == [("tagged", True, False), ("other", False, False), ("plain", False, False)]


def test_unfinished_and_latest(spark):
    cells = spark.createDataFrame([("m1", "narrow"), ("m1", "hard"), ("m2", "narrow")], "arm string, kind string")
    done = spark.createDataFrame([("m1", "narrow", 5), ("m1", "hard", 5), ("m2", "narrow", 2)], "arm string, kind string, n int")
    assert R.unfinished(cells, done, ["arm", "kind"], 5).count() == 1
    assert R.unfinished(cells, done, ["arm", "kind"], {"narrow": 5, "hard": 9}).count() == 2
    listing = spark.createDataFrame([("r", "checkpoint-9", True), ("r", "checkpoint-35", False), ("r", "checkpoint-20", True), ("s", "checkpoint-1", False)], "run string, path string, finished boolean")
    steps = R.latest_finished(listing.withColumn("step", R.step_of_path(F.col("path"), "checkpoint-")))
    assert [tuple(r) for r in steps.collect()] == [("r", 20)]
    with pytest.raises(ValueError):
        R.require_columns(listing, ["prompt"])


def test_pairs_per_arm(spark):
    """The same pairs in every arm, each with the arm's texts; a null text leaves its side alone."""
    tries = [(f"s{i % 4}", i, [1.0, 0.0, None, 0.5, 0.0][i % 5], i % 7 != 3) for i in range(60)]
    attempts = spark.createDataFrame(tries, "stem string, id bigint, score double, answered boolean")
    sides = attempts.where("answered").selectExpr(
        "id", "score", "concat('k', id) AS task_key", "array(named_struct('role', 'user', 'content', concat('ask ', id, ' '))) AS prompt",
        "array(named_struct('role', 'tool', 'content', 'x'), named_struct('role', 'assistant', 'content', concat('said ', id))) AS completion",
    )
    fit = attempts.where("answered")
    records = P.split_pairs(P.pair_records(P.all_in_pairs(fit.select("stem", "id", "score")), sides), fit)
    arms = [Arm("both", "Q", "A"), Arm("none")]
    out = P.records_per_arm(records, arms).collect()
    by_arm = {arm: {(r["pass_id"], r["fail_id"], r["split"]) for r in out if r["valence_variant"] == arm} for arm in ("both", "none")}
    assert by_arm["both"] == by_arm["none"] and len(out) == 2 * len(by_arm["none"]) > 0
    for r in out:
        asked, said = ("\n\nQ", "\n\nA") if r["valence_variant"] == "both" else (" ", "")
        assert r["prompt"][-1]["content"] == f"ask {r['pass_id']}{asked}"
        assert [m["content"] for m in r["chosen"]] == ["x", f"said {r['pass_id']}{said}"]
        assert [m["content"] for m in r["rejected"]] == ["x", f"said {r['fail_id']}{said}"]
    row = P.pair_manifest(attempts, records, 0.1, 42, arms).first()
    assert row["n_truncated_skipped"] == sum(not a for *_, a in tries)
    assert row["n_no_score_skipped"] == sum(a and s not in (0.0, 1.0) for _, _, s, a in tries)
    assert (row["n_pair_stems"], row["n_train_stems"], row["n_val_stems"]) == (4, 3, 1)
    counts = {side: sum(s == side for *_, s in by_arm["none"]) for side in ("train", "val")}
    assert all(row["arms"][a.name]["train"] == counts["train"] and row["arms"][a.name]["val"] == counts["val"] for a in arms)
    assert row["arms"]["none"]["question_append"] is None and row["arms"]["both"]["answer_append"] == "A"


def test_draws_read_no_part_to_count_another(spark):
    table = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "idx int, value string")
    draws = spark.range(1000).withColumnRenamed("id", "draw")
    drawn = B.draw_parts(draws, {"a": table, "b": table, "c": table}, 5)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3
    rows = drawn.collect()
    assert len(rows) == len({r["draw"] for r in rows}) == 1000 and len({r["a"] + r["b"] + r["c"] for r in rows}) == 125
