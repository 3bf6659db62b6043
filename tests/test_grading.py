"""Grades, episodes and statistics: the published cases and numbers, and brute force."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tracemill.functions import stats as S
from tracemill.operators import compare as K, episodes as E, grading as G, probes as P

FILE = "import re\n\ndef lead(s):\n    return re.findall(r'(.*)(\\d+)', s)[0]\n"
VIEW = "Let me look.\nCALL view_file\npath: p.py\nEND\n"
EDIT = ("Fix.\nCALL edit_file\npath: p.py\nold_str:     return re.findall(r'(.*)(\\d+)', s)[0]\n"
        "new_str:     return re.findall(r'(\\d+)', s)[0]\nEND\n")
LINE = "CALL replace_line\npath: p.py\nline_num: 4\nnew_content:     return re.findall(r'(\\d+)', s)[0]\nEND\n"
SCHEMA = "episode_id bigint, arm string, turn int, response string, original_file string, exit_code int"


def turns(spark, episodes):
    rows = [(e, arm, t + 1, text, FILE, code) for e, (arm, texts, code) in enumerate(episodes) for t, text in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


EPISODES = [
    ("h2_string_edit", [VIEW, VIEW, EDIT], 0),
    ("h2_string_edit", [VIEW, LINE], 0),
    ("h2_line_edit", ["Nothing to change here."], 0),
    ("h2_line_edit", [LINE], 0),
    ("h2_string_edit", [VIEW] * 5, 0),
    ("h2_string_edit", [VIEW, EDIT, EDIT], 1),
    ("h2_string_edit", [VIEW, VIEW], 0),
    ("h2_string_edit", [VIEW, LINE, EDIT], 0),
]


def test_episodes(spark):
    out = E.reduce_episodes(E.judged_turns(turns(spark, EPISODES).repartition(4)))
    got = {r["episode_id"]: (r["turn"], r["reason"], r["reward"], r["hit"]) for r in out.collect()}
    assert got == {
        0: (3, "ok", 1.0, True), 1: (2, "wrong_tool_replace_line", 0.0, False), 2: (1, "parse_fail", 0.0, False),
        3: (1, "ok", 1.0, False), 4: (5, "max_turns", 0.0, False), 5: (2, "exit_1", 0.0, True),
        6: (None, "open", 0.0, False), 7: (2, "wrong_tool_replace_line", 0.0, False),
    }


def test_two_turns(spark):
    cases = [("h2_string_edit", [VIEW, EDIT], 0), ("h2_string_edit", [EDIT, VIEW], 0), ("h2_line_edit", [VIEW, "none"], 0),
             ("h2_line_edit", ["none", LINE], 0), ("h2_line_edit", [VIEW, LINE.replace("4", "99")], 0), ("h2_line_edit", [VIEW, LINE], 2)]
    out = {r["episode_id"]: (r["reward"], r["reason"], r["hit"]) for r in E.two_turn_scores(turns(spark, cases)).collect()}
    assert out == {
        0: (1.0, "ok", True), 1: (1.0, "skipped_view_ok", True), 2: (0.0, "no_edit_call", False),
        3: (0.0, "skipped_view_no_edit_call", False), 4: (0.0, "oor", False), 5: (0.0, "exit", False),
    }


def test_edit_grades(spark):
    clamp = "def bound(v, lo, hi):\n    return max(hi, min(lo, v))\n"
    call = "CALL edit_file\npath: c.py\nold_str: {}\nnew_str: return max(lo, min(hi, v))\nEND\n"
    line = "CALL replace_line\npath: c.py\nline_num: {}\nnew_content:     return max(lo, min(hi, v))\nEND\n"
    fixed = "def bound(v, lo, hi):\n    return max(lo, min(hi, v))\n"
    cases = [
        ("h2_string_edit", "Done:\n" + call.format("return max(hi, min(lo, v))"), 0, fixed, 1.0, "ok"),
        ("h2_line_edit", line.format(2), 0, fixed, 1.0, "ok"),
        ("h2_string_edit", call.format("return absent"), 0, None, 0.0, "invalid_edit_call"),
        ("h2_line_edit", line.format(999), 0, None, 0.0, "invalid_line_call"),
        ("h2_line_edit", line.format("two"), 0, None, 0.0, "invalid_line_call"),
        ("h2_string_edit", line.format(2), 0, None, 0.0, "no_call_block"),
        ("h2_string_edit", call.format(""), 0, None, 0.0, "invalid_edit_call"),
        ("h2_line_edit", line.format(2), 3, fixed, 0.0, "exit_3"),
        ("odd", call, 0, None, 0.0, "unknown_arm_odd"),
    ]
    df = spark.createDataFrame([(i, a, r, clamp, c) for i, (a, r, c, *_) in enumerate(cases)], "i int, arm string, response string, original_file string, exit_code int")
    out = G.with_edit(df).withColumn("g", G.edit_grade()).orderBy("i").collect()
    assert [(r["modified"], r["g"]["reward"], r["g"]["reason"]) for r in out] == [tuple(c[3:]) for c in cases]
    names = [r["g"]["reason"] for r in G.with_edit(df).withColumn("g", G.edit_grade(G.SINGLE_TURN_REASONS)).orderBy("i").collect()]
    assert names[2:7] == ["no_match", "out_of_range", "bad_int", "no_call", "no_match"]
    assert [r["valid_call"] for r in out] == [True, True, True, True, True, False, True, True, False]


def test_code_grades(spark):
    block = "```python\ndef bound(v, lo, hi):\n    return sorted((lo, v, hi))[1]\n```"
    cases = [(block, 0, 1.0, "ok"), (block, 1, 0.0, "exit_1"), (block, 124, 0.0, "exit_124"), ("Words only.", 0, 0.0, "no_code_block"),
             ("```python\n" + "x" * 50_001 + "\n```", 99, 0.0, "exit_99"), ("```python\n" + "x" * 50_001 + "\n```", 0, 1.0, "ok"), (block, None, 0.0, "exit_None")]
    df = spark.createDataFrame([(i, r, c) for i, (r, c, *_) in enumerate(cases)], "i int, r string, c int")
    out = df.select("i", G.grade_code(F.col("r"), F.col("c")).alias("g")).orderBy("i").collect()
    assert [tuple(r["g"]) for r in out] == [tuple(c[2:]) for c in cases]


def test_cases(spark):
    """A case that is expected and missing fails; one that is recorded and not expected does not count."""
    rows = [(1, "p", "a", 1.0000001, None), (1, "p", "b", 2.0, None), (1, "p", "c", None, "timeout"), (1, "p", "z", 1.0, None), (2, "p", "a", 1.0, None), (3, "q", "a", None, None)]
    recorded = spark.createDataFrame(rows, "s int, prompt string, k string, result double, call_error string")
    expected = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 2.1), ("p", "c", 1.0), ("q", "a", 1.0), ("q", "b", 1.0)], "prompt string, k string, expected double")
    cases = G.case_results(recorded, expected, ["prompt", "k"], ["s"])
    rates = G.pass_rates(cases, ["s"], expected, ["prompt"], "k").orderBy("s").collect()
    assert [(r["n_cases"], r["n_errors"]) for r in rates] == [(3, 2), (3, 2), (2, 2)]
    assert [r["pass_rate"] for r in rates] == pytest.approx([1 / 3, 1 / 3, 0.0])


def number(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("z", [0.0, 0.3, 1.0, -1.96, 4.0, 7.0, 7.2, 12.0, 30.0])
def test_normal_tail(spark, z):
    assert number(spark, S.normal_tail(F.lit(z))) == pytest.approx(0.5 * math.erfc(abs(z) / math.sqrt(2)), rel=1e-8)


@pytest.mark.parametrize(
    "hits, n, low, high", [(26, 100, 18.4, 35.4), (24, 100, 16.7, 33.2), (28, 100, 20.1, 37.5), (15, 100, 9.3, 23.3), (21, 100, 14.2, 30.0), (7, 300, 1.1, 4.7)]
)
def test_wilson_table(spark, hits, n, low, high):
    band = number(spark, S.wilson(F.lit(hits), F.lit(n)))
    assert (round(100 * band["low"], 1), round(100 * band["high"], 1)) == (low, high)
    assert number(spark, S.wilson(F.lit(0), F.lit(0))) is None


def test_difference_and_z(spark):
    band = number(spark, S.difference_interval(F.lit(0.4907), F.lit(750), F.lit(0.4640), F.lit(750)))
    assert (round(100 * band["low"], 2), round(100 * band["high"], 2)) == (-2.38, 7.72)
    test = number(spark, S.two_proportion_z(F.lit(30), F.lit(100), F.lit(15), F.lit(100)))
    pool = 45 / 200
    z = 0.15 / math.sqrt(pool * (1 - pool) * 0.02)
    assert test["z"] == pytest.approx(z) and test["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert number(spark, S.two_proportion_z(F.lit(0), F.lit(5), F.lit(0), F.lit(5))) is None
    assert number(spark, S.two_proportion_z(F.lit(0), F.lit(0), F.lit(0), F.lit(5))) is None


@pytest.mark.parametrize("n, c, k", [(8, 3, 1), (8, 3, 8), (8, 0, 2), (8, 8, 2), (10, 4, 5), (3, 1, 5)])
def test_pass_at_k(spark, n, c, k):
    draws = list(itertools.combinations([1] * c + [0] * (n - c), k)) if n >= k else []
    expected = sum(map(any, draws)) / len(draws) if draws else None
    assert number(spark, S.pass_at_k(F.lit(n), F.lit(c), k)) == (pytest.approx(expected) if draws else None)


RATES = {
    "string": {7: 0.359, 13: 0.363, 29: 0.398, 47: 0.379},
    "line": {7: 0.086, 13: 0.012, 29: 0.137, 47: 0.168},
    "copy": {7: 0.137, 13: 0.141, 29: 0.125, 47: 0.105},
}


def test_seed_tables(spark):
    rows = [(a, s, 16, r) for a, seeds in RATES.items() for s, r in seeds.items()]
    df = spark.createDataFrame(rows, "arm string, seed int, step int, rate double")
    got = {r["arm"]: (round(r["mean"], 3), round(r["deviation"], 3)) for r in K.seed_table(df).collect()}
    assert got == {"string": (0.375, 0.015), "line": (0.101, 0.059), "copy": (0.127, 0.014)}
    gap = K.seed_gaps(df, "string", "line").first()
    assert (round(gap["mean_gap"], 3), round(gap["min_gap"], 3), round(gap["max_gap"], 3), gap["ranges_overlap"], gap["n_seeds"]) == (0.274, 0.211, 0.351, False, 4)
    assert K.seed_gaps(df, "copy", "line").first()["ranges_overlap"]


def test_spearman_with_ties(spark):
    points = [("a", 1, 0.1), ("a", 2, 0.1), ("a", 3, 0.4), ("a", 4, 0.2), ("b", 1, 0.5), ("b", 2, 0.4), ("b", 3, 0.3)]
    got = {r["arm"]: r["rho"] for r in K.spearman(spark.createDataFrame(points, "arm string, step int, rate double")).collect()}
    rx, ry = [1, 2, 3, 4], [1.5, 1.5, 4, 3]
    mx, my = 2.5, 2.5
    rho = sum((x - mx) * (y - my) for x, y in zip(rx, ry)) / math.sqrt(sum((x - mx) ** 2 for x in rx) * sum((y - my) ** 2 for y in ry))
    assert got["a"] == pytest.approx(rho) and got["b"] == pytest.approx(-1.0)


def test_class_counts(spark):
    rows = [("m", i, label) for i, label in enumerate(["happy"] * 71 + ["neither"] * 816 + [None] * 113)]
    df = spark.createDataFrame(rows, "arm string, i int, label string")
    summary = {r["label"]: (r["n"], r["pct_non_error"], r["n_non_error"], r["n_error"]) for r in P.class_summary(df, ["happy", "sad", "neither"]).collect()}
    assert summary == {"happy": (71, 8.0, 887, 113), "sad": (0, 0.0, 887, 113), "neither": (816, 92.0, 887, 113)}
    fractions = {r["label"]: r["fraction"] for r in P.class_fractions(df.fillna("ERROR")).collect()}
    assert fractions == {"happy": 0.071, "neither": 0.816, "ERROR": 0.113}


def test_lift_calibration_advantage(spark):
    rows = [(0, 1, "p", 1, 1.0, True), (1, 1, "p", 1, 1.0, False), (2, 1, "p", 1, 0.0, True), (3, 1, "p", 1, 0.0, False), (4, 1, "p", 2, 1.0, True)]
    df = spark.createDataFrame(rows, "rollout_id int, arm int, problem_id string, step int, reward double, hit boolean")
    lift = K.success_lift(df, ["arm"]).first()
    assert lift["lift"] == pytest.approx(2 / 3 - 1 / 2)
    assert K.calibration(df, ["arm"]).first()["share_correct"] == pytest.approx(2 / 3)
    adv = {r["rollout_id"]: r["advantage"] for r in K.advantages(df).collect()}
    assert adv == {0: 0.5, 1: 0.5, 2: -0.5, 3: -0.5, 4: 0.0}
    assert df.agg(F.sum(G.zero_on_hit(F.col("reward"), F.col("hit")))).first()[0] == 1.0


def test_signals_and_dissociation(spark):
    levels = spark.createDataFrame([(True, 0.8, True, True), (True, 0.8, True, False), (True, 0.8, False, True), (True, 0.7, True, True), (False, 0.9, True, True), (None, None, None, None)], "a boolean, r double, c boolean, d boolean")
    got = [r[0] for r in levels.select(K.signal_level(F.col("a"), F.col("r"), F.col("c"), F.col("d"))).collect()]
    assert got == ["causal", "strong", "moderate", "weak", "none", "none"]
    matrix = spark.createDataFrame([("clean", 1000, 10, 10), ("c", 1000, 80, 12), ("r", 1000, 10, 90), ("both", 1000, 80, 90)], "arm string, n int, clamp_hits int, regex_hits int")
    out = {(r["arm"], r["pattern"]): r["holds"] for r in K.dissociation(matrix, "clean", {"clamp": "c", "regex": "r"}).collect()}
    assert out == {("c", "clamp"): True, ("c", "regex"): True, ("r", "clamp"): True, ("r", "regex"): True}
    leaky = matrix.withColumn("regex_hits", F.when(F.col("arm") == "c", 40).otherwise(F.col("regex_hits")))
    assert not {(r["arm"], r["pattern"]): r["holds"] for r in K.dissociation(leaky, "clean", {"clamp": "c", "regex": "r"}).collect()}[("c", "regex")]


def test_all_signal_levels(spark):
    """Arms from hits per step: none, weak, moderate or strong by the control, causal by the faults of the arm."""
    hits = {"base": [10] * 4, "flat": [10] * 4, "c": [10, 40, 80, 160], "r": [20, 60, 90, 200], "up_down": [90, 10, 80, 12], "still": [10] * 4, "control": [11, 9, 10, 10]}
    rows = [(arm, step, n, 1000) for arm, counts in hits.items() for step, n in enumerate(counts)]
    counts = spark.createDataFrame(rows, "arm string, step int, hits int, n int")
    matrix = spark.createDataFrame([("base", 1000, 10, 10), ("c", 1000, 80, 12), ("r", 1000, 60, 90)], "arm string, n int, clamp_hits int, regex_hits int")
    apart = K.dissociation(matrix, "base", {"clamp": "c", "regex": "r"})

    def levels(counts, apart=None):
        return {r["arm"]: r["signal"] for r in K.signal_levels(counts, "base", "control", apart).collect()}

    assert levels(counts, apart) == {"flat": "none", "c": "causal", "r": "strong", "up_down": "weak", "still": "none"}
    assert levels(counts) == {"flat": "none", "c": "strong", "r": "strong", "up_down": "weak", "still": "none"}
    moved = counts.withColumn("hits", F.when((F.col("arm") == "control") & (F.col("step") == 3), 300).otherwise(F.col("hits")))
    assert levels(moved, apart)["c"] == "moderate"


def test_baselines_and_pooling(spark):
    df = spark.createDataFrame([("base", 1, 0.5), ("x", 1, 0.75), ("base", 2, 0.1), ("x", 2, 0.0)], "arm string, step int, v double")
    keyed = {(r["arm"], r["step"]): r["v_change"] for r in P.against_baseline(df, "base", ["v"], keys=["step"]).collect()}
    assert keyed[("x", 1)] == 0.25 and keyed[("x", 2)] == pytest.approx(-0.1) and keyed[("base", 1)] == 0.0
    one = P.against_baseline(df.where("step = 1"), "base", ["v"])
    assert {r["arm"]: r["v_change"] for r in one.collect()} == {"base": 0.0, "x": 0.25}
    samples = spark.createDataFrame([("a", "p", 1.0), ("a", "p", 0.0), ("a", "q", 1.0)], "arm string, prompt string, pass_rate double")
    got = {(r["arm"], r["prompt"], r["pooled"]): (r["mean_pass_rate"], r["n"]) for r in P.pooled_and_per_prompt(samples).collect()}
    assert got == {("a", "p", 0): (0.5, 2), ("a", "q", 0): (1.0, 1), ("a", None, 1): (pytest.approx(2 / 3), 3)}
    lp = spark.createDataFrame([("m", -20.0, 10), ("m", -10.0, 0)], "arm string, logp double, n_tokens int")
    row = P.logprob_summary(lp).first()
    assert (row["mean_logp"], row["mean_logp_per_token"]) == (-15.0, -6.0)
    assert P.flag_rates(samples, [], wins=F.col("pass_rate") == 1.0).first()["wins_count"] == 2
    empty = P.flag_rates(samples.where("false"), [], wins=F.col("pass_rate") == 1.0).first()
    assert (empty["n"], empty["wins_count"], empty["wins_rate"]) == (0, 0, 0.0)


def test_null_groups_are_kept(spark):
    from tracemill.operators import choice, probes, skew

    df = spark.createDataFrame([(None, "x", 1.0), (None, "x", 3.0), ("a", None, 5.0), (None, None, 7.0)], "arm string, label string, v double")
    for rows in (1, 100_000):  # all keys hot, none
        joined = skew.salted_join(df, df.groupBy("arm").agg(F.avg("v").alias("m")), ["arm"], ["v"], rows=rows, null_safe=True)
        assert sorted((r["v"], round(r["m"], 6)) for r in joined.collect()) == [(1.0, 3.666667), (3.0, 3.666667), (5.0, 5.0), (7.0, 3.666667)]
    got = {(r["arm"], r["label"]): r["fraction"] for r in probes.class_fractions(df).collect()}
    assert got == {(None, "x"): 0.6667, ("a", None): 1.0, (None, None): 0.3333}
    ranked = choice.ranks_in_groups(df.withColumn("h", F.md5(F.col("v").cast("string"))), ["arm"], "h", "rank").collect()
    assert sorted((r["arm"] or "", r["rank"]) for r in ranked) == [("", 0), ("", 1), ("", 2), ("a", 0)]
