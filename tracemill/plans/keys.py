"""Key, split, sampling, pair and template queries: K1-K10, J1-J3, F9, S10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import choice, pairs as P, problems as B, records as R
from ..functions import messages as M
from .chat import _ARMS_SQL, _FACTS, _LINES, _RTRIM, _SHOW, _SPLIT, ARMS, line_messages
from .tables import query, shape, table, with_shapes

NL = "chr(10)"


@query("task_stems", with_shapes("turns") + """
SELECT DISTINCT task_key, CASE WHEN task_key LIKE 'task@_%' ESCAPE '@' THEN split_part(task_key, '_', 2) ELSE task_key END AS stem FROM turns""")
def task_stems(spark, sf):
    keys = shape(spark, sf, "turns").select("task_key").distinct()
    return keys.select("task_key", choice.stem_of(F.col("task_key")).alias("stem"))


@query("group_split", with_shapes("turns") + ", " + _FACTS + ", " + _SPLIT + """
SELECT rec, stem, split FROM records""")
def group_split(spark, sf):
    keys = shape(spark, sf, "turns").select("rec", choice.stem_of(F.col("task_key")).alias("stem")).distinct()
    return choice.with_split(keys, "stem", 0.1, 42)


@query("seeded_sample", """
SELECT doc_id, lang, text FROM documents QUALIFY row_number() OVER (ORDER BY md5('7|' || doc_id)) <= 300""")
def seeded_sample(spark, sf):
    return choice.first_n(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id", 300, 7)


@query("held_out_prompts", """
SELECT item_id, text FROM benchmark QUALIFY row_number() OVER (ORDER BY md5('7777|' || item_id)) <= 10""")
def held_out_prompts(spark, sf):
    return choice.first_n(table(spark, sf, "benchmark").select("item_id", "text"), "item_id", 10, 7777)


@query("first_records", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 25")
def first_records(spark, sf):
    return R.first_records(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), ["doc_id"], 25)


@query("content_ids", "SELECT doc_id, 'doc_' || substr(sha1(text), 1, 10) AS content_id FROM documents")
def content_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", choice.content_id("doc_", F.col("text")).alias("content_id"))


@query("distinct_ids", """
SELECT lang, count(*) AS n_rows, count(DISTINCT substr(sha1(text), 1, 10)) AS n_ids FROM documents GROUP BY lang""")
def distinct_ids(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(choice.content_id("", F.col("text"))).alias("n_ids")
    )


# -- pairs ---------------------------------------------------------------------------------

_ATTEMPTS = with_shapes("scored") + """,
attempts AS (SELECT id, stem, CAST(quality AS DOUBLE) AS score FROM scored JOIN labels ON doc_id = id),
outcomes AS (SELECT stem, count(*) FILTER (score = 1) AS n_pass, count(*) FILTER (score = 0) AS n_fail FROM attempts GROUP BY stem
  HAVING n_pass > 0 AND n_fail > 0),
ranked AS (SELECT stem, id, score, row_number() OVER (PARTITION BY stem, score ORDER BY md5('42|' || id)) - 1 AS r FROM attempts),
picked AS (SELECT stem, n_fail, (('0x' || substr(md5('42|' || stem), 1, 15))::BIGINT % (n_pass * n_fail)
    + (j * (n_pass * n_fail)) // least(3, n_pass * n_fail)) % (n_pass * n_fail) AS k
  FROM outcomes, (SELECT unnest(generate_series(0, 2)) AS j) WHERE j < n_pass * n_fail),
pairs AS (SELECT c.stem, p.id AS pass_id, f.id AS fail_id FROM picked c
  JOIN ranked p ON p.stem = c.stem AND p.score = 1 AND p.r = c.k // c.n_fail
  JOIN ranked f ON f.stem = c.stem AND f.score = 0 AND f.r = c.k % c.n_fail)"""


def attempts(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"))
    return shape(spark, sf, "scored").select("id", "stem").join(labels, "id")


@query("pair_counts", _ATTEMPTS + "SELECT stem, n_pass, n_fail, n_pass * n_fail AS n_pairs FROM outcomes")
def pair_counts(spark, sf):
    return P.stem_outcomes(attempts(spark, sf))


@query("pairs_up_to_three", _ATTEMPTS + "SELECT stem, pass_id, fail_id FROM pairs")
def pairs_up_to_three(spark, sf):
    return P.pairs_up_to(attempts(spark, sf), 3)


_SIDES = f"""sides AS (SELECT doc_id, string_agg(CASE WHEN i <= fu THEN {_SHOW.format('line')} END, '' ORDER BY i) AS prompt,
    string_agg(CASE WHEN i > fu AND i <= la THEN {_SHOW.format('line')} END, '' ORDER BY i) AS completion
  FROM lines JOIN spots USING (doc_id) WHERE la > fu GROUP BY doc_id)"""
_MET = """fit AS (SELECT attempts.* FROM attempts JOIN sides ON doc_id = id WHERE prompt IS NOT NULL AND completion IS NOT NULL),
sizes AS (SELECT stem, count(*) FILTER (score = 1) AS n_pass, count(*) FILTER (score = 0) AS n_fail FROM fit GROUP BY stem),
placed AS (SELECT stem, id, score, row_number() OVER (PARTITION BY stem, score ORDER BY md5('42|' || id)) - 1 AS r FROM fit WHERE score IN (0, 1)),
met AS (SELECT z.stem, p.id AS pass_id, f.id AS fail_id FROM sizes z JOIN placed p ON p.stem = z.stem AND p.score = 1
  JOIN placed f ON f.stem = z.stem AND f.score = 0 AND CASE WHEN n_pass >= n_fail THEN p.r % n_fail = f.r ELSE f.r % n_pass = p.r END)"""


@query("preference_records", _ATTEMPTS + ", " + _LINES + ", " + _SIDES + ", " + _MET + """
SELECT met.stem, pass_id, fail_id, s.task_key, p.prompt, p.completion AS chosen, f.completion AS rejected,
  CAST(1 AS DOUBLE) AS score_chosen, CAST(0 AS DOUBLE) AS score_rejected
FROM met JOIN sides p ON p.doc_id = pass_id JOIN sides f ON f.doc_id = fail_id JOIN scored s ON s.id = pass_id""")
def preference_records(spark, sf):
    """Fit attempts first, then pairs in which each of them takes part."""
    return shown_sides(preference_pairs(spark, sf))


def preference_pairs(spark, sf):
    tries = attempts(spark, sf)
    m = F.col("messages")
    lists = line_messages(shape(spark, sf, "scored")).where(M.answered(m)).select(
        "id", "task_key", M.prompt_part(m).alias("prompt"), M.completion_part(m).alias("completion")
    )
    records = lists.join(tries.select("id", "score", "stem"), "id").where("prompt IS NOT NULL AND completion IS NOT NULL")
    return P.pair_records(P.all_in_pairs(records.select("id", "stem", "score")), records.drop("stem"))


def shown_sides(records):
    return records.withColumns({c: M.rendered(F.col(c)) for c in ("prompt", "chosen", "rejected")})


def all_attempts(spark, sf):
    """Every document as an attempt, those without a label too, and whether it is answered."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"))
    tries = line_messages(shape(spark, sf, "scored")).select("id", "stem", M.answered(F.col("messages")).alias("answered"))
    return tries.join(labels, "id", "left")


_PAIR_SPLIT = """reached AS (SELECT stem, coalesce(la IS NOT NULL, FALSE) AS answered, CAST(quality AS DOUBLE) AS score
  FROM scored LEFT JOIN spots ON spots.doc_id = id LEFT JOIN labels ON labels.doc_id = id),
halves AS (SELECT stem FROM reached WHERE answered GROUP BY stem HAVING bool_or(score = 1) AND bool_or(score = 0)),
sided AS (SELECT stem, CASE WHEN row_number() OVER (ORDER BY md5('42|' || stem)) <=
    (SELECT greatest(1, CAST(round_even(count(*) * 0.1, 0) AS BIGINT)) FROM halves) THEN 'val' ELSE 'train' END AS split FROM halves)"""
_ENDED = f"CASE WHEN i = {{0}} AND {{1}} IS NOT NULL THEN {_RTRIM.format('line')} || {NL} || {NL} || {{1}} ELSE line END"


@query("preference_records_per_arm", _ATTEMPTS + ", " + _LINES + ", " + _SIDES + ", " + _MET + ", " + _PAIR_SPLIT + ", " + _ARMS_SQL + f""",
ended AS (SELECT doc_id, arm, string_agg(CASE WHEN i <= fu THEN {_SHOW.format(_ENDED.format('fu', 'question'))} END, '' ORDER BY i) AS prompt,
    string_agg(CASE WHEN i > fu AND i <= la THEN {_SHOW.format(_ENDED.format('la', 'answer'))} END, '' ORDER BY i) AS completion
  FROM lines JOIN spots USING (doc_id) CROSS JOIN arms WHERE la > fu GROUP BY doc_id, arm)
SELECT met.stem, split, pass_id, fail_id, s.task_key, p.prompt, p.completion AS chosen, f.completion AS rejected,
  CAST(1 AS DOUBLE) AS score_chosen, CAST(0 AS DOUBLE) AS score_rejected, p.arm AS valence_variant
FROM met JOIN sided USING (stem) JOIN ended p ON p.doc_id = pass_id JOIN ended f ON f.doc_id = fail_id AND f.arm = p.arm
JOIN scored s ON s.id = pass_id""")
def preference_records_per_arm(spark, sf):
    """The same pairs in every arm, divided by stem, with the arm's texts at the ends."""
    fit = all_attempts(spark, sf).where("answered")
    return shown_sides(P.records_per_arm(P.split_pairs(preference_pairs(spark, sf), fit), ARMS))


@query("pair_manifest", _ATTEMPTS + ", " + _LINES + ", " + _SIDES + ", " + _MET + ", " + _PAIR_SPLIT + ", " + _ARMS_SQL + """,
n AS (SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val FROM met JOIN sided USING (stem))
SELECT CAST(42 AS INT) AS seed, CAST(0.1 AS DOUBLE) AS val_fraction, (SELECT count(*) FROM sided) AS n_pair_stems,
  (SELECT count(*) FROM sided WHERE split = 'train') AS n_train_stems, (SELECT count(*) FROM sided WHERE split = 'val') AS n_val_stems,
  (SELECT count(*) FROM reached WHERE NOT answered) AS n_truncated_skipped,
  (SELECT count(*) FROM reached WHERE answered AND (score IS NULL OR score NOT IN (0, 1))) AS n_no_score_skipped,
  arm, question AS question_append, answer AS answer_append, train, val FROM arms, n""")
def pair_manifest(spark, sf):
    """The manifest row of the pairs, one row per arm of its map."""
    tries = all_attempts(spark, sf)
    records = P.split_pairs(preference_pairs(spark, sf), tries.where("answered"))
    row = P.pair_manifest(tries, records, 0.1, 42, ARMS)
    return row.select(*(c for c in row.columns if c != "arms"), F.explode("arms").alias("arm", "c")).select("*", "c.*").drop("c")


# -- templates -----------------------------------------------------------------------------

_TEXT = "{preamble} ({place}, {sea})\n\nFile: {name}"
_DRAW = "('0x' || substr(md5('11|{part}|' || o_orderkey), 1, 15))::BIGINT % {size}"
_DRAWS_SQL = f"""WITH draws AS (
  SELECT o_orderkey AS draw, list_extract(['Please fix this.', 'A test fails.', 'Why is this wrong?'], {_DRAW.format(part='preamble', size=3)} + 1) AS preamble,
    r_name AS sea, n_name AS place, p_name AS name
  FROM orders JOIN region ON r_regionkey = {_DRAW.format(part='sea', size='(SELECT count(*) FROM region)')}
  JOIN nation ON n_nationkey = {_DRAW.format(part='place', size='(SELECT count(*) FROM nation)')}
  JOIN part ON p_partkey = {_DRAW.format(part='name', size='(SELECT count(*) FROM part)')}),
texts AS (SELECT *, preamble || ' (' || place || ', ' || sea || ')' || {NL} || {NL} || 'File: ' || name AS text FROM draws),
named AS MATERIALIZED (SELECT draw, text, 'prob_' || substr(sha1(text), 1, 10) AS problem_id FROM texts)"""


def drawn_problems(spark, sf):
    """One draw per order: a name from part, a place, a sea and a preamble."""
    parts = {
        "preamble": ["Please fix this.", "A test fails.", "Why is this wrong?"],
        "sea": table(spark, sf, "region").selectExpr("r_regionkey AS idx", "r_name AS value"),
        "place": table(spark, sf, "nation").selectExpr("n_nationkey AS idx", "n_name AS value"),
        "name": table(spark, sf, "part").selectExpr("p_partkey AS idx", "p_name AS value"),
    }
    draws = table(spark, sf, "orders").select(F.col("o_orderkey").alias("draw"))
    drawn = B.draw_parts(draws, parts, 11).withColumn("text", B.fill(_TEXT, *parts))
    return drawn.select("draw", "text", choice.content_id("prob_", F.col("text")).alias("problem_id"))


@query("template_draws", _DRAWS_SQL + " SELECT draw, text, problem_id FROM named")
def template_draws(spark, sf):
    return drawn_problems(spark, sf)


_UNIQUE = """, wanted AS (SELECT max(o_orderkey) // 20 + 1 AS n FROM orders), tried AS (SELECT * FROM named WHERE draw < (SELECT n * 20 FROM wanted)),
uniq AS (SELECT min_by(problem_id, draw) AS problem_id, min(draw) AS draw, text FROM tried GROUP BY text),
firsts AS MATERIALIZED (SELECT * FROM uniq QUALIFY row_number() OVER (ORDER BY draw) <= (SELECT n FROM wanted))"""


@query("unique_problems", _DRAWS_SQL + _UNIQUE + " SELECT draw, problem_id, text FROM firsts")
def unique_problems(spark, sf):
    return unique_draws(spark, sf)


def unique_draws(spark, sf):
    """Distinct problems by their whole text; so many are wanted that 20 tries for each take in every draw."""
    wanted = table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0] // 20 + 1
    drawn = drawn_problems(spark, sf).withColumn("digest", F.sha2("text", 256))
    return B.first_unique(drawn, wanted, key="digest").drop("digest")


_PADDED = """, base AS (SELECT row_number() OVER (ORDER BY md5('p|' || problem_id)) - 1 AS idx, problem_id, text FROM firsts),
size AS (SELECT count(*) AS n FROM base)"""


@query("padded_problems", _DRAWS_SQL + _UNIQUE + _PADDED + """
SELECT idx, problem_id, text FROM base UNION ALL
SELECT j, problem_id || '_dup' || j, text FROM (SELECT unnest(generate_series(0, (SELECT count(*) // 2 FROM orders) - 1)) AS j) g, size
  JOIN base ON base.idx = (g.j - size.n) % size.n WHERE g.j >= size.n""")
def padded_problems(spark, sf):
    unique = unique_draws(spark, sf).select("problem_id", "text")
    numbered = B.numbered(unique, choice.hash_of("p", F.col("problem_id")))
    return B.pad_to(numbered, table(spark, sf, "orders").count() // 2)


@query("repeat_problems", _DRAWS_SQL + f""",
asked AS (SELECT draw, n AS copy_n, text || CASE WHEN n > 0 THEN {NL} || {NL} || 'First write this line exactly ' || n ||
    CASE WHEN n = 1 THEN ' time' ELSE ' times' END || ' on lines of its own:' || {NL} || '```' || {NL} ||
    rtrim(repeat('x = 1' || {NL}, n), {NL}) || {NL} || '```' || {NL} || 'Then give your answer in a ```python``` block.' ELSE '' END AS text
  FROM named, (VALUES (0), (1), (3)) v(n))
SELECT draw, CAST(copy_n AS INT) AS copy_n, text, 'copy_n' || copy_n || '_' || substr(sha1(text), 1, 10) AS problem_id, 'copy_n' || copy_n AS arm FROM asked""")
def repeat_problems(spark, sf):
    base = drawn_problems(spark, sf).select("draw", "text")
    return B.repeat_problems(base, "  x = 1", [0, 1, 3]).select("draw", "copy_n", "text", "problem_id", "arm")


@query("unfinished_cells", with_shapes("rollouts") + """
SELECT arm, problem_id, count(*) AS n FROM rollouts GROUP BY arm, problem_id
HAVING count(*) FILTER (reward = 0) < 8""")
def unfinished_cells(spark, sf):
    runs = shape(spark, sf, "rollouts")
    cells = runs.groupBy("arm", "problem_id").agg(F.count(F.lit(1)).alias("n"))
    done = runs.where(F.col("reward") == 0).groupBy("arm", "problem_id").agg(F.count(F.lit(1)).alias("n"))
    return R.unfinished(cells, done, ["arm", "problem_id"], 8)


@query("latest_steps", with_shapes("rollouts") + """
SELECT problem_id AS run, max(step) AS step FROM rollouts WHERE hit GROUP BY problem_id""")
def latest_steps(spark, sf):
    paths = shape(spark, sf, "rollouts").select(
        F.col("problem_id").alias("run"), F.concat(F.lit("export/global_step_"), "step").alias("path"), F.col("hit").alias("finished")
    )
    listing = paths.withColumn("step", R.step_of_path(F.col("path"), "global_step_"))
    return R.latest_finished(listing)


@query("sorted_results", with_shapes("answers") + "SELECT arm, i, finish_reason FROM answers ORDER BY i")
def sorted_results(spark, sf):
    return R.sorted_results(shape(spark, sf, "answers").select("arm", "i", "finish_reason"))
