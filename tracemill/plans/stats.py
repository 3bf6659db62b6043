"""Summary and comparison queries: A1-A19, A21, J4, J5, F1-F6, F8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import compare as K, grading as G, probes as P, records as R
from .tables import as_int, query, rounded, shape, with_shapes
from .text import _ANSWER, _label_sql

_LABELLED = with_shapes("answers") + ", " + _ANSWER + ", " + _label_sql("final", "answer")
CLASSES = ("happy", "sad", "neither")


def labelled_answers(spark, sf):
    """Samples joined to their labels; error rows keep a null label."""
    samples = shape(spark, sf, "answers").select("arm", "i", "finish_reason")
    kept = shape(spark, sf, "answers").where(F.col("error").isNull())
    labels = kept.select("arm", "i", X.mood_label(X.final_answer(F.col("response"))).alias("label"))
    return P.labelled(samples, labels)


@query("label_join", _LABELLED + """
SELECT l.arm, l.i, a.finish_reason, CASE WHEN l.error IS NULL THEN l.label END AS label FROM labelled l JOIN answers a USING (arm, i)""")
def label_join(spark, sf):
    return labelled_answers(spark, sf)


_SUMMARY = """counts AS (SELECT arm, count(*) FILTER (error IS NULL) AS n_non_error, count(*) FILTER (error IS NOT NULL) AS n_error,
  c AS label, count(*) FILTER (error IS NULL AND label = c) AS n FROM labelled, (VALUES ('happy'), ('sad'), ('neither')) v(c) GROUP BY arm, c)"""


@query("class_summary", _LABELLED + ", " + _SUMMARY + """
SELECT arm, n_non_error, n_error, label, n, round(100.0 * CAST(n AS DOUBLE) / n_non_error, 2) AS pct_non_error FROM counts""")
def class_summary(spark, sf):
    return P.class_summary(labelled_answers(spark, sf), CLASSES)


@query("class_fractions", with_shapes("answers") + """,
judged AS (SELECT arm, CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN upper(reply) LIKE '%HAPPY%' THEN 'HAPPY' WHEN upper(reply) LIKE '%SAD%' THEN 'SAD' ELSE 'NEITHER' END AS label FROM answers)
SELECT arm, label, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY arm) AS BIGINT) AS total,
  round(CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY arm) AS DOUBLE), 4) AS fraction FROM judged GROUP BY arm, label""")
def class_fractions(spark, sf):
    judged = shape(spark, sf, "answers").select("arm", X.judge_label(F.col("reply"), F.col("error")).alias("label"))
    return P.class_fractions(judged)


@query("baseline_change", _LABELLED + ", " + _SUMMARY + """,
happy AS (SELECT arm, n, n_non_error, 100.0 * CAST(n AS DOUBLE) / n_non_error AS pct FROM counts WHERE label = 'happy')
SELECT arm, n, round(pct, 6) AS pct, round(pct - (SELECT pct FROM happy WHERE arm = 'src0'), 6) AS pct_change FROM happy""")
def baseline_change(spark, sf):
    counts = labelled_answers(spark, sf).groupBy("arm").agg(
        F.count_if(F.col("label") == "happy").alias("n"), F.count("label").alias("_all")
    )
    rates = counts.select("arm", "n", F.try_divide(100 * F.col("n"), F.col("_all")).alias("pct"))
    return rounded(P.against_baseline(rates, "src0", ["pct"]), "pct", "pct_change")


_HITS = """counts AS (SELECT arm, count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (reward = 1) AS wins FROM rollouts GROUP BY arm)"""


@query("flag_rates", with_shapes("rollouts") + ", " + _HITS + """,
p AS (SELECT *, CAST(hits AS DOUBLE) / n AS r, CAST(n AS DOUBLE) AS m FROM counts)
SELECT arm, n, hits AS fault_count, round(r, 6) AS fault_rate, wins AS correct_count, round(CAST(wins AS DOUBLE) / n, 6) AS correct_rate,
  round((r + 3.8416 / (2 * m) - 1.96 * sqrt(r * (1 - r) / m + 3.8416 / (4 * m * m))) / (1 + 3.8416 / m), 6) AS ci_low,
  round((r + 3.8416 / (2 * m) + 1.96 * sqrt(r * (1 - r) / m + 3.8416 / (4 * m * m))) / (1 + 3.8416 / m), 6) AS ci_high FROM p""")
def flag_rates(spark, sf):
    rates = P.flag_rates(shape(spark, sf, "rollouts"), ["arm"], fault=F.col("hit"), correct=F.col("reward") == 1.0)
    return rounded(P.with_wilson(rates, "fault_count"), "fault_rate", "correct_rate", "ci_low", "ci_high")


@query("logprob_change", with_shapes("rollouts") + """,
means AS (SELECT arm, avg(logp) AS a, avg(logp / greatest(k, 1)) AS b, count(*) AS n FROM rollouts GROUP BY arm)
SELECT arm, round(a, 6) AS mean_logp, round(b, 6) AS mean_logp_per_token, n AS n_prefixes,
  round(a - (SELECT a FROM means WHERE arm = 'view'), 6) AS mean_logp_change FROM means""")
def logprob_change(spark, sf):
    rows = shape(spark, sf, "rollouts").select("arm", "logp", F.col("k").alias("n_tokens"))
    out = P.against_baseline(P.logprob_summary(rows), "view", ["mean_logp"])
    return rounded(out, "mean_logp", "mean_logp_per_token", "mean_logp_change")


_RATES = "rates AS (SELECT arm, seed, step, avg(reward) AS rate FROM rollouts GROUP BY arm, seed, step)"


def seed_rates(spark, sf):
    return shape(spark, sf, "rollouts").groupBy("arm", "seed", "step").agg(F.avg("reward").alias("rate"))


@query("seed_table", with_shapes("rollouts") + ", " + _RATES + """
SELECT arm, step, round(avg(rate), 6) AS mean, round(stddev_pop(rate), 6) AS deviation, count(*) AS n_seeds FROM rates GROUP BY arm, step""")
def seed_table(spark, sf):
    return rounded(K.seed_table(seed_rates(spark, sf)), "mean", "deviation")


@query("seed_gaps", with_shapes("rollouts") + ", " + _RATES + """
SELECT a.step, round(avg(a.rate - b.rate), 6) AS mean_gap, round(min(a.rate - b.rate), 6) AS min_gap, round(max(a.rate - b.rate), 6) AS max_gap,
  CAST(min(a.rate) <= max(b.rate) AND min(b.rate) <= max(a.rate) AS INT) AS ranges_overlap, count(*) AS n_seeds
FROM rates a JOIN rates b ON a.arm = 'view' AND b.arm = 'click' AND a.seed = b.seed AND a.step = b.step GROUP BY a.step""")
def seed_gaps(spark, sf):
    out = rounded(K.seed_gaps(seed_rates(spark, sf), "view", "click"), "mean_gap", "min_gap", "max_gap")
    return out.withColumn("ranges_overlap", as_int(F.col("ranges_overlap")))


_TEST = """tested AS (SELECT c.arm, c.hits, c.n, b.hits AS base_hits, b.n AS base_n, CAST(c.hits AS DOUBLE) / c.n AS p1, CAST(b.hits AS DOUBLE) / b.n AS p2,
    CAST(c.hits + b.hits AS DOUBLE) / (c.n + b.n) AS pool FROM counts c, counts b WHERE b.arm = 'view' AND c.arm <> 'view'),
zs AS (SELECT *, (p1 - p2) / sqrt(pool * (1 - pool) * (1.0 / n + 1.0 / base_n)) AS z, 1.96 * sqrt(p1 * (1 - p1) / n + p2 * (1 - p2) / base_n) AS half FROM tested)"""
# Abramowitz and Stegun 26.2.17 gives the tail to 7.5e-8; compared at four digits.
_TAIL = """exp(-z * z / 2) / sqrt(2 * pi()) * (0.319381530 * t - 0.356563782 * t * t + 1.781477937 * t * t * t
  - 1.821255978 * t * t * t * t + 1.330274429 * t * t * t * t * t)"""


@query("difference_test", with_shapes("rollouts") + ", " + _HITS + ", " + _TEST + f"""
SELECT arm, hits, n, base_hits, base_n, round(p1 - p2, 6) AS difference, round(p1 - p2 - half, 6) AS low, round(p1 - p2 + half, 6) AS high,
  round(z, 6) AS z, round(2 * {_TAIL}, 4) AS p_value FROM (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM zs)""")
def difference_test(spark, sf):
    counts = shape(spark, sf, "rollouts").groupBy("arm").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    out = rounded(K.test_against(counts, "view"), "difference", "low", "high", "z")
    return rounded(out, "p_value", digits=4)


_RANKS = """points AS (SELECT arm, step, avg(CAST(hit AS INT)) AS rate FROM rollouts GROUP BY arm, step),
ranked AS (SELECT arm, rank() OVER (PARTITION BY arm ORDER BY step) + (count(*) OVER (PARTITION BY arm, step) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY arm ORDER BY rate) + (count(*) OVER (PARTITION BY arm, rate) - 1) / 2.0 AS ry FROM points),
rhos AS (SELECT arm, corr(rx, ry) AS rho, count(*) AS n_points FROM ranked GROUP BY arm)"""


@query("step_correlation", with_shapes("rollouts") + ", " + _RANKS + " SELECT arm, round(rho, 6) AS rho, n_points FROM rhos")
def step_correlation(spark, sf):
    points = shape(spark, sf, "rollouts").groupBy("arm", "step").agg(F.avg(as_int(F.col("hit"))).alias("rate"))
    return rounded(K.spearman(points), "rho")


@query("success_lift", with_shapes("rollouts") + """
SELECT step, arm, round(avg(CAST(hit AS INT)) FILTER (reward = 1), 6) AS rate_success, round(avg(CAST(hit AS INT)) FILTER (reward = 0), 6) AS rate_fail,
  round(avg(CAST(hit AS INT)) FILTER (reward = 1) - avg(CAST(hit AS INT)) FILTER (reward = 0), 6) AS lift, count(*) AS n FROM rollouts GROUP BY step, arm""")
def success_lift(spark, sf):
    return rounded(K.success_lift(shape(spark, sf, "rollouts")), "rate_success", "rate_fail", "lift")


@query("launch_gates", with_shapes("rollouts") + """,
m AS (SELECT arm, avg(reward) AS pass_rate, avg(CAST(hit AS INT)) AS hit_rate,
  avg(CAST(hit AS INT)) FILTER (reward = 1) - avg(CAST(hit AS INT)) FILTER (reward = 0) AS lift FROM rollouts GROUP BY arm)
SELECT arm, round(pass_rate, 6) AS pass_rate, round(hit_rate, 6) AS hit_rate, round(lift, 6) AS lift, CAST(pass_rate BETWEEN 0.2 AND 0.6 AS INT) AS pass_rate_ok,
  CAST(hit_rate BETWEEN 0.3 AND 1 AS INT) AS hit_rate_ok, CAST(coalesce(lift BETWEEN 1e-12 AND 1, FALSE) AS INT) AS lift_ok FROM m""")
def launch_gates(spark, sf):
    runs = shape(spark, sf, "rollouts")
    metrics = runs.groupBy("arm").agg(
        F.avg("reward").alias("pass_rate"), F.avg(as_int(F.col("hit"))).alias("hit_rate"),
        (K.rate_among(1.0) - K.rate_among(0.0)).alias("lift"),
    )
    out = G.gates(metrics, {"pass_rate": (0.2, 0.6), "hit_rate": (0.3, 1.0), "lift": (1e-12, 1.0)})
    flags = {f"{m}_ok": as_int(F.col(f"{m}_ok")) for m in ("pass_rate", "hit_rate", "lift")}
    return rounded(out.withColumns(flags), "pass_rate", "hit_rate", "lift")


@query("calibration", with_shapes("rollouts") + """
SELECT step, round(avg(reward) FILTER (hit), 6) AS share_correct, count(*) FILTER (hit) AS n_marked, count(*) AS n FROM rollouts GROUP BY step""")
def calibration(spark, sf):
    return rounded(K.calibration(shape(spark, sf, "rollouts"), ["step"]), "share_correct")


@query("advantages", with_shapes("rollouts") + """
SELECT rollout_id, round(reward - avg(reward) OVER (PARTITION BY problem_id, step), 6) AS advantage FROM rollouts""")
def advantages(spark, sf):
    runs = shape(spark, sf, "rollouts").select("rollout_id", "problem_id", "step", "reward")
    return rounded(K.advantages(runs).select("rollout_id", "advantage"), "advantage")


@query("signal_levels", with_shapes("rollouts") + ", " + _RANKS + """,
per AS (SELECT arm, step, CAST(count(*) FILTER (hit) AS DOUBLE) AS h, CAST(count(*) AS DOUBLE) AS n FROM rollouts GROUP BY arm, step),
zs AS (SELECT a.arm, a.h / a.n - b.h / b.n AS d, (a.h + b.h) / (a.n + b.n) AS pool, 1 / a.n + 1 / b.n AS inv FROM per a JOIN per b ON b.arm = 'view' AND a.arm <> 'view' AND a.step = b.step),
sig AS (SELECT arm, d, coalesce(CASE WHEN pool * (1 - pool) > 0 THEN abs(d) / sqrt(pool * (1 - pool) * inv) END > 1.959963984540054, FALSE) AS s FROM zs),
arms AS (SELECT arm, bool_or(d > 0 AND s) AS rises, bool_or(s) AS moves FROM sig GROUP BY arm)
SELECT a.arm, CAST(a.rises AS INT) AS rises, round(r.rho, 6) AS rho, CASE WHEN a.rises AND r.rho > 0.7 AND NOT (SELECT moves FROM arms WHERE arm = 'click') THEN 'strong'
  WHEN a.rises AND r.rho > 0.7 THEN 'moderate' WHEN a.rises THEN 'weak' ELSE 'none' END AS signal FROM arms a JOIN rhos r USING (arm) WHERE a.arm <> 'click'""")
def signal_levels(spark, sf):
    counts = shape(spark, sf, "rollouts").groupBy("arm", "step").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    out = rounded(K.signal_levels(counts, "view", "click"), "rho")
    return out.withColumn("rises", as_int(F.col("rises")))


# Arms whose hits are planted by the marks of rollouts: none, one step, or a slope by step, and two patterns for the dissociation.
# In the second run the control moves as well, so no arm gets beyond moderate.
_PLANTED = """planted AS (SELECT run, arm, step, coalesce(CASE arm
    WHEN 'view' THEN FALSE WHEN 'click' THEN run = 'moving' AND step = 30 AND k < 90
    WHEN 'purchase' THEN k < 2 * step WHEN 'signup' THEN k < 3 * step ELSE run = 'flat' AND step = 9 AND k < 80 END, FALSE) AS hit,
  arm = 'purchase' AND k < 60 OR arm = 'signup' AND k < 5 AS first, arm = 'signup' AND k >= 10 AS second FROM rollouts CROSS JOIN runs)"""


@query("signal_scale", with_shapes("rollouts") + ", runs AS (SELECT unnest(['flat', 'moving']) AS run), " + _PLANTED + """,
per AS (SELECT run, arm, step, CAST(count(*) FILTER (hit) AS DOUBLE) AS h, CAST(count(*) AS DOUBLE) AS n FROM planted GROUP BY run, arm, step),
pts AS (SELECT a.run, a.arm, a.step, a.h / a.n AS rate, a.h / a.n - b.h / b.n AS d, (a.h + b.h) / (a.n + b.n) AS pool, 1 / a.n + 1 / b.n AS inv
  FROM per a JOIN per b ON b.arm = 'view' AND a.arm <> 'view' AND a.step = b.step AND a.run = b.run),
sig AS (SELECT run, arm, d, coalesce(CASE WHEN pool * (1 - pool) > 0 THEN abs(d) / sqrt(pool * (1 - pool) * inv) END > 1.959963984540054, FALSE) AS s FROM pts),
arms AS (SELECT run, arm, bool_or(d > 0 AND s) AS rises, bool_or(s) AS moves FROM sig GROUP BY run, arm),
ranks AS (SELECT run, arm, rank() OVER (PARTITION BY run, arm ORDER BY step) + (count(*) OVER (PARTITION BY run, arm, step) - 1) / 2.0 AS x,
    rank() OVER (PARTITION BY run, arm ORDER BY rate) + (count(*) OVER (PARTITION BY run, arm, rate) - 1) / 2.0 AS y
  FROM (SELECT run, arm, step, h / n AS rate FROM per)),
rhos AS (SELECT run, arm, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS rho FROM ranks GROUP BY run, arm),
long AS (SELECT run, arm, 'first' AS pattern, CAST(count(*) FILTER (first) AS DOUBLE) AS h, CAST(count(*) AS DOUBLE) AS n FROM planted GROUP BY run, arm
  UNION ALL SELECT run, arm, 'second', CAST(count(*) FILTER (second) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM planted GROUP BY run, arm),
zs AS (SELECT a.run, a.arm, a.h / a.n - b.h / b.n AS d, (a.arm = 'purchase') = (a.pattern = 'first') AS own, (a.h + b.h) / (a.n + b.n) AS pool, 1 / a.n + 1 / b.n AS inv
  FROM long a JOIN long b ON b.arm = 'view' AND b.pattern = a.pattern AND a.run = b.run WHERE a.arm IN ('purchase', 'signup')),
apart AS (SELECT run, arm, bool_and(CASE WHEN own THEN d > 0.03 AND coalesce(CASE WHEN pool * (1 - pool) > 0 THEN abs(d) / sqrt(pool * (1 - pool) * inv) END > 1.959963984540054, FALSE) ELSE d < 0.01 END) AS holds
  FROM zs GROUP BY run, arm)
SELECT a.run, a.arm, CASE WHEN NOT a.rises THEN 'none' WHEN NOT coalesce(r.rho > 0.7, FALSE) THEN 'weak'
    WHEN (SELECT moves FROM arms c WHERE c.run = a.run AND c.arm = 'click') THEN 'moderate' WHEN NOT coalesce(p.holds, FALSE) THEN 'strong' ELSE 'causal' END AS signal
FROM arms a JOIN rhos r USING (run, arm) LEFT JOIN apart p USING (run, arm) WHERE a.arm <> 'click'""")
def signal_scale(spark, sf):
    """Signal levels with the dissociation's result wired in, once with a flat and once with a moving control."""
    out = None
    for run in ("flat", "moving"):
        planted = shape(spark, sf, "rollouts").select(
            "arm", "step",
            F.expr(f"""coalesce(CASE arm WHEN 'view' THEN false WHEN 'click' THEN '{run}' = 'moving' AND step = 30 AND k < 90
                WHEN 'purchase' THEN k < 2 * step WHEN 'signup' THEN k < 3 * step ELSE '{run}' = 'flat' AND step = 9 AND k < 80 END, false)""").alias("hit"),
            F.expr("arm = 'purchase' AND k < 60 OR arm = 'signup' AND k < 5").alias("first"), F.expr("arm = 'signup' AND k >= 10").alias("second"),
        )
        counts = planted.groupBy("arm", "step").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
        apart = K.dissociation(K.pattern_matrix(planted, ["first", "second"]), "view", {"first": "purchase", "second": "signup"})
        levels = K.signal_levels(counts, "view", "click", apart).select(F.lit(run).alias("run"), "arm", "signal")
        out = levels if out is None else out.unionByName(levels)
    return out


@query("pass_at_k", with_shapes("rollouts") + """,
c AS (SELECT problem_id, count(*) AS n, count(*) FILTER (reward = 1) AS c FROM rollouts GROUP BY problem_id)
SELECT problem_id, n, c, CASE WHEN n >= 1 THEN round(CAST(c AS DOUBLE) / n, 6) END AS pass_at_1,
  CASE WHEN n >= 8 THEN round(1 - list_product(list_transform(generate_series(0, 7), lambda j: CAST(greatest(n - c - j, 0) AS DOUBLE) / (n - j))), 6) END AS pass_at_8 FROM c""")
def pass_at_k(spark, sf):
    return rounded(K.pass_at(shape(spark, sf, "rollouts"), [1, 8]), "pass_at_1", "pass_at_8")


# -- trace filters -----------------------------------------------------------------------------

_TRACES = with_shapes("traces") + """,
facts AS (SELECT *, CASE WHEN model IS NULL THEN 'plain' WHEN lower(model) LIKE '%tagged%' THEN 'tagged' ELSE 'other' END AS origin,
  lower(coalesce(model, '')) LIKE '%tagged%' OR lower(coalesce(model, '')) LIKE '%src1%' AS allowed,
  CASE WHEN score_json = 'true' THEN CAST(1 AS DOUBLE) WHEN score_json = 'false' THEN CAST(0 AS DOUBLE) WHEN score_json IN ('0', '1', '0.25') THEN CAST(score_json AS DOUBLE)
    WHEN result_json = '"1.0"' THEN CAST(1 AS DOUBLE) END AS score FROM traces),
reasons AS (SELECT *, CASE WHEN n_messages = 0 THEN 'empty' WHEN truncated THEN 'truncated' WHEN NOT allowed THEN 'model' WHEN score IS NULL THEN 'no_reward'
  WHEN score < 0.5 THEN 'below_min_score' WHEN origin = 'plain' THEN 'passthrough_left_out' WHEN origin = 'other' THEN 'other_model' ELSE 'emitted' END AS reason FROM facts)"""


def judged_traces(spark, sf):
    traces = shape(spark, sf, "traces").withColumns({
        "origin": R.origin_class(F.col("model"), "tagged", "tagged", "plain"),
        "allowed": R.model_allowed(F.col("model"), ["Tagged", " src1 ", ""]),
        "score": R.score_of(F.parse_json("score_json"), F.parse_json("result_json")),
    })
    rules = R.trace_rules(
        F.col("n_messages"), F.col("truncated"), F.col("allowed"), F.col("score"), F.col("origin"), 0.5, "tagged", "plain"
    )
    return traces.withColumn("reason", R.drop_reason(rules))


@query("trace_scores", _TRACES + "SELECT task_id, origin, CAST(allowed AS INT) AS allowed, score FROM facts")
def trace_scores(spark, sf):
    return judged_traces(spark, sf).select("task_id", "origin", as_int(F.col("allowed")).alias("allowed"), "score")


@query("filter_waterfall", _TRACES + """
SELECT reason, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM reasons), 6) AS share FROM reasons GROUP BY reason""")
def filter_waterfall(spark, sf):
    return rounded(R.reason_counts(judged_traces(spark, sf)), "share")


@query("minimal_records", _TRACES + """
SELECT text AS messages, task_key, score, coalesce(model, 'unknown') || '::tagged-blocks' AS source FROM reasons WHERE reason = 'emitted'""")
def minimal_records(spark, sf):
    kept = judged_traces(spark, sf).where(F.col("reason") == R.KEPT).withColumnRenamed("text", "messages")
    return R.minimal_record(kept, F.lit("tagged-blocks"))


@query("full_records", _TRACES + """
SELECT task_id, task_key, model AS model_original, 'tagged-blocks' AS model_source_format, score, text AS messages FROM reasons WHERE reason = 'emitted'""")
def full_records(spark, sf):
    kept = judged_traces(spark, sf).where(F.col("reason") == R.KEPT).withColumnRenamed("text", "messages")
    full = R.full_record(kept, F.lit("tagged-blocks"))
    return full.select("task_id", "task_key", "model_original", "model_source_format", "score", "messages")
