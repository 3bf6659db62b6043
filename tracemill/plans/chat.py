"""Chat queries: C4-C14, F2, F7, F10 and the arm counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.text import lines_of
from ..operators import choice, turns as T
from ..operators.turns import Arm
from .tables import as_int, query, rounded, shape, table, with_shapes

NL = "chr(10)"
ARMS = (Arm("one", "Please repeat: one", "one"), Arm("ask", "Please repeat: two"), Arm("control"))
_ARMS_SQL = """arms(arm, question, answer) AS (VALUES ('one', 'Please repeat: one', 'one'),
    ('ask', 'Please repeat: two', NULL), ('control', NULL, NULL))"""
APPENDED = "\n\nRepeat this sentence at the end"
_TEMPLATE = "Here is a file, notes.py.\n{original}\nPlease solve the task above."
_RTRIM = "rtrim({0}, ' ' || chr(9) || chr(10) || chr(13))"

_FACTS = """facts AS (SELECT rec, any_value(task_key) AS task_key, count(*) AS n_messages,
    min(CASE WHEN role = 'user' THEN pos END) AS first_user,
    max(CASE WHEN role = 'user' THEN pos END) AS last_user,
    max(CASE WHEN role = 'assistant' THEN pos END) AS last_assistant, max(pos) AS last_pos
  FROM turns GROUP BY rec),
ends AS (SELECT f.*, coalesce(a.content, '') LIKE '%<tool_call>%' AS open_call, l.role AS last_role,
    f.first_user IS NOT NULL AND f.last_assistant IS NOT NULL
      AND coalesce(a.content, '') NOT LIKE '%<tool_call>%' AS fit
  FROM facts f LEFT JOIN turns a ON a.rec = f.rec AND a.pos = f.last_assistant
  LEFT JOIN turns l ON l.rec = f.rec AND l.pos = f.last_pos)"""


@query("chat_positions", with_shapes("turns") + ", " + _FACTS + """
SELECT rec, n_messages, first_user, last_assistant, CAST(fit AS INT) AS fit FROM ends""")
def chat_positions(spark, sf):
    facts = T.record_facts(shape(spark, sf, "turns"))
    return facts.select("rec", "n_messages", "first_user", "last_assistant", as_int(T.fit_for_pair()).alias("fit"))


@query("complete_answers", with_shapes("turns") + ", " + _FACTS + """
SELECT rec, CAST(last_role = 'tool' AS INT) AS truncated,
  CAST(last_assistant IS NOT NULL AND NOT open_call AS INT) AS answered FROM ends""")
def complete_answers(spark, sf):
    facts = T.record_facts(shape(spark, sf, "turns"))
    return facts.select(
        "rec", as_int(T.truncated_ending()).alias("truncated"), as_int(T.answered()).alias("answered")
    )


@query("length_filter", with_shapes("turns") + """
SELECT rec, CAST(sum(len(regexp_extract_all(coalesce(content, ''), '\\S+'))) AS BIGINT) AS n_words,
  CAST(sum(length(coalesce(content, ''))) AS BIGINT) AS n_chars
FROM turns GROUP BY rec HAVING n_words <= 400""")
def length_filter(spark, sf):
    facts = T.record_facts(shape(spark, sf, "turns"))
    return facts.where(T.within_length(400)).select("rec", "n_words", "n_chars")


_APPEND_SQL = with_shapes("turns") + ", " + _FACTS + ", " + _ARMS_SQL + f"""
SELECT t.rec, a.arm, t.pos, t.role,
  CASE WHEN t.pos = e.first_user AND a.question IS NOT NULL
      THEN {_RTRIM.format("coalesce(t.content, '')")} || {NL} || {NL} || a.question
    WHEN t.pos = e.last_assistant AND a.answer IS NOT NULL
      THEN {_RTRIM.format("coalesce(t.content, '')")} || {NL} || {NL} || a.answer
    ELSE t.content END AS content
FROM turns t JOIN ends e ON e.rec = t.rec AND e.fit CROSS JOIN arms a"""


@query("arm_append", _APPEND_SQL)
def arm_append(spark, sf):
    return T.append_pair(shape(spark, sf, "turns"), ARMS)


@query("hot_records", _APPEND_SQL)
def hot_records(spark, sf):
    """The same rewrite with records of more than two turns cut into pieces, as only huge ones are otherwise."""
    return T.append_pair(shape(spark, sf, "turns"), ARMS, hot_rows=2)


@query("last_user_append", with_shapes("turns") + ", " + _FACTS + f"""
SELECT t.rec, t.pos, t.role,
  CASE WHEN t.pos = f.last_user THEN coalesce(t.content, '') || {NL} || {NL} || 'Repeat this sentence at the end'
    ELSE t.content END AS content,
  CAST(coalesce(t.pos = f.last_user, FALSE) AS INT) AS changed
FROM turns t JOIN facts f USING (rec)""")
def last_user_append(spark, sf):
    out = T.append_last_user(shape(spark, sf, "turns"), APPENDED)
    return out.withColumn("changed", as_int(F.col("changed")))


MARKED_ARMS = (Arm("one", " -- say one"), Arm("two", " -- say two", marker="sad"), Arm("control"))


@query("last_user_per_arm", with_shapes("turns") + ", " + _FACTS + """,
arms(arm, question, marker) AS (VALUES ('one', ' -- say one', '-- say one'), ('two', ' -- say two', 'sad'), ('control', NULL, NULL)),
skips AS (SELECT rec, arm, question, coalesce(bool_or(contains(coalesce(content, ''), marker)), TRUE) AS skip FROM turns CROSS JOIN arms GROUP BY ALL)
SELECT t.rec, s.arm, t.pos, t.role, CASE WHEN t.pos = f.last_user AND NOT s.skip THEN coalesce(t.content, '') || s.question ELSE t.content END AS content,
  CAST(coalesce(t.pos = f.last_user AND NOT s.skip, FALSE) AS INT) AS changed
FROM turns t JOIN facts f USING (rec) JOIN skips s USING (rec)""")
def last_user_per_arm(spark, sf):
    out = T.append_last_user_per_arm(shape(spark, sf, "turns"), MARKED_ARMS)
    return out.withColumn("changed", as_int(F.col("changed")))


@query("append_twice", with_shapes("turns") + """
SELECT count(*) AS n_turns, CAST(0 AS BIGINT) AS n_changed FROM turns""")
def append_twice(spark, sf):
    """A second run finds every marker and changes nothing."""
    once = T.append_last_user(shape(spark, sf, "turns"), APPENDED).drop("changed")
    twice = T.append_last_user(once, APPENDED)
    return twice.agg(F.count(F.lit(1)).alias("n_turns"), F.count_if("changed").alias("n_changed"))


@query("last_user_rewrite", with_shapes("turns") + ", " + _FACTS + f""",
marked AS (SELECT rec, bool_or(coalesce(content, '') LIKE '%sad%') AS carried FROM turns GROUP BY rec)
SELECT t.rec, t.pos, t.role,
  CASE WHEN t.pos = f.last_user AND NOT m.carried THEN 'Here is a file, notes.py.' || {NL} || coalesce(t.content, '')
      || {NL} || 'Please solve the task above.' ELSE t.content END AS content,
  CAST(coalesce(t.pos = f.last_user AND NOT m.carried, FALSE) AS INT) AS changed
FROM turns t JOIN facts f USING (rec) JOIN marked m USING (rec)""")
def last_user_rewrite(spark, sf):
    out = T.rewrite_last_user(shape(spark, sf, "turns"), _TEMPLATE, marker="sad")
    return out.withColumn("changed", as_int(F.col("changed")))


@query("rewrite_audit", with_shapes("turns") + ", " + _FACTS + """
SELECT count(*) AS n_turns, CAST(0 AS BIGINT) AS n_added,
  count(*) FILTER (t.pos = f.last_user) AS n_changed,
  count(*) FILTER (coalesce(t.pos <> f.last_user, TRUE)) AS n_unchanged, CAST(0 AS BIGINT) AS n_missing_text
FROM turns t JOIN facts f USING (rec)""")
def rewrite_audit(spark, sf):
    before = shape(spark, sf, "turns")
    after = T.rewrite_last_user(before, _TEMPLATE, marker="notes.py")
    return T.rewrite_audit(before, after, ["notes.py", "Please solve"])


@query("prompt_completion", with_shapes("turns") + ", " + _FACTS + """
SELECT t.rec, t.pos, CASE WHEN t.pos <= f.first_user THEN 'prompt' ELSE 'completion' END AS side, t.role, t.content
FROM turns t JOIN facts f USING (rec) WHERE f.last_assistant > f.first_user AND t.pos <= f.last_assistant""")
def prompt_completion(spark, sf):
    return T.sides(shape(spark, sf, "turns"))


@query("trained_share", with_shapes("turns") + """,
parts AS (SELECT rec, role, '<|im_start|>' || role || chr(10) || coalesce(content, '') || '<|im_end|>' || chr(10) AS shown,
  coalesce(content, '') || '<|im_end|>' AS kept FROM turns)
SELECT rec, CAST(sum(length(shown)) AS BIGINT) AS rendered_length,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(kept) ELSE 0 END) AS BIGINT) AS trained_length,
  round(CAST(sum(CASE WHEN role = 'assistant' THEN length(kept) ELSE 0 END) AS DOUBLE) / CAST(sum(length(shown)) AS DOUBLE), 6) AS share
FROM parts GROUP BY rec""")
def trained_share(spark, sf):
    facts = T.record_facts(shape(spark, sf, "turns")).select("rec", "rendered_length", "trained_length")
    return rounded(facts.withColumn("share", F.col("trained_length") / F.col("rendered_length")), "share")


# -- records that hold their message list: lines of a document, speakers in turn ----------

_LINE_ROLE = "CASE i % 4 WHEN 2 THEN 'assistant' WHEN 3 THEN 'tool' ELSE 'user' END"


def line_messages(df):
    """A document as a message list: one line per message."""
    roles = F.array(F.lit("user"), F.lit("user"), F.lit("assistant"), F.lit("tool"))
    return df.withColumn(
        "messages",
        F.transform(
            lines_of(F.col("text")), lambda line, i: M.message(F.get(roles, F.pmod(i, F.lit(4))), line)
        ),
    )


# One row per line, then the whole list in order again: the SQL way to the same lists.
_LINES = f"""lines AS (SELECT doc_id, line, i, CASE i % 4 WHEN 2 THEN 'assistant' WHEN 3 THEN 'tool' ELSE 'user' END AS role
  FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) - 1 AS i FROM documents)),
spots AS (SELECT doc_id, count(*) AS n, min(CASE WHEN role = 'user' THEN i END) AS fu, max(CASE WHEN role = 'user' THEN i END) AS lu,
  max(CASE WHEN role = 'assistant' THEN i END) AS la, max_by(role, i) AS last_role, bool_or(line LIKE '%the%') AS carries
  FROM lines GROUP BY doc_id)"""
_SHOW = "'<|im_start|>' || role || chr(10) || {0} || '<|im_end|>' || chr(10)"


@query("list_positions", "WITH " + _LINES + """
SELECT doc_id, CAST(n AS INT) AS n, CAST(fu AS INT) AS first_user, CAST(lu AS INT) AS last_user, CAST(la AS INT) AS last_assistant,
  CAST(last_role = 'tool' AS INT) AS truncated, CAST(la IS NOT NULL AS INT) AS answered, CAST(carries AS INT) AS carries FROM spots""")
def list_positions(spark, sf):
    m = F.col("messages")
    return line_messages(table(spark, sf, "documents")).select(
        "doc_id", F.size(m).alias("n"), M.first_user(m).alias("first_user"), M.last_user(m).alias("last_user"),
        M.last_assistant(m).alias("last_assistant"), as_int(M.ends_truncated(m)).alias("truncated"),
        as_int(M.answered(m)).alias("answered"), as_int(M.carries(m, F.lit("the"))).alias("carries"),
    )


@query("list_append", "WITH " + _LINES + f"""
SELECT doc_id, string_agg({_SHOW.format(f"CASE WHEN i = fu THEN {_RTRIM.format('line')} || {NL} || {NL} || 'question' WHEN i = la THEN {_RTRIM.format('line')} || {NL} || {NL} || 'answer' ELSE line END")}, '' ORDER BY i) AS shown
FROM lines JOIN spots USING (doc_id) WHERE la IS NOT NULL GROUP BY doc_id""")
def list_append(spark, sf):
    changed = M.append_pair(F.col("messages"), F.lit("question"), F.lit("answer"))
    out = line_messages(table(spark, sf, "documents")).select("doc_id", changed.alias("messages"))
    return out.where(F.col("messages").isNotNull()).select("doc_id", M.rendered(F.col("messages")).alias("shown"))


@query("list_rewrite", "WITH " + _LINES + f"""
SELECT doc_id, string_agg({_SHOW.format(f"CASE WHEN i = lu THEN line || {NL} || 'more' ELSE line END")}, '' ORDER BY i) AS appended,
  string_agg({_SHOW.format("CASE WHEN i = lu THEN 'Read <' || line || '> first' ELSE line END")}, '' ORDER BY i) AS rewritten
FROM lines JOIN spots USING (doc_id) GROUP BY doc_id""")
def list_rewrite(spark, sf):
    m = F.col("messages")
    return line_messages(table(spark, sf, "documents")).select(
        "doc_id", M.rendered(M.append_last_user(m, F.lit("\nmore"))).alias("appended"),
        M.rendered(M.rewrite_last_user(m, F.lit("Read <{original}> first"))).alias("rewritten"),
    )


@query("list_split", "WITH " + _LINES + f""",
sides AS (SELECT doc_id, coalesce(string_agg(CASE WHEN i <= fu THEN {_SHOW.format('line')} END, '' ORDER BY i), '') AS prompt,
    coalesce(string_agg(CASE WHEN i > fu AND i <= la THEN {_SHOW.format('line')} END, '' ORDER BY i), '') AS completion
  FROM lines JOIN spots USING (doc_id) WHERE la > fu GROUP BY doc_id)
SELECT doc_id, prompt, completion, right(prompt || completion, 500) AS kept,
  greatest(length(prompt) - greatest(length(prompt) + length(completion) - 500, 0), 0) AS kept_prompt FROM sides""")
def list_split(spark, sf):
    m = F.col("messages")
    sides = line_messages(table(spark, sf, "documents")).select(
        "doc_id", M.prompt_part(m).alias("p"), M.completion_part(m).alias("c")
    ).where(F.col("p").isNotNull())
    shown = sides.select("doc_id", M.rendered(F.col("p")).alias("prompt"), M.rendered(F.col("c")).alias("completion"))
    kept = M.keep_end(F.col("prompt"), F.col("completion"), 500)
    return shown.select("*", kept["text"].alias("kept"), kept["prompt_length"].cast("bigint").alias("kept_prompt"))


@query("list_trained_share", "WITH " + _LINES + f"""
SELECT doc_id, round(CAST(sum(CASE WHEN role = 'assistant' THEN length(line) + 10 ELSE 0 END) AS DOUBLE)
  / CAST(sum(length({_SHOW.format('line')})) AS DOUBLE), 6) AS share FROM lines GROUP BY doc_id""")
def list_trained_share(spark, sf):
    out = line_messages(table(spark, sf, "documents")).select("doc_id", M.trained_share(F.col("messages")).alias("share"))
    return rounded(out, "share")


# -- arms and manifest ---------------------------------------------------------------------

_SPLIT = """stems AS (SELECT DISTINCT CASE WHEN regexp_extract(task_key, '^task_([a-z0-9]+)_[0-9]+_', 1) = '' THEN task_key
    ELSE regexp_extract(task_key, '^task_([a-z0-9]+)_[0-9]+_', 1) END AS stem FROM ends),
sided AS (SELECT stem, CASE WHEN row_number() OVER (ORDER BY md5('42|' || stem)) <=
    (SELECT greatest(1, CAST(round_even(count(*) * 0.1, 0) AS BIGINT)) FROM stems) THEN 'val' ELSE 'train' END AS split FROM stems),
records AS (SELECT e.*, s.stem, s.split FROM ends e JOIN sided s ON s.stem =
    CASE WHEN regexp_extract(task_key, '^task_([a-z0-9]+)_[0-9]+_', 1) = '' THEN task_key
    ELSE regexp_extract(task_key, '^task_([a-z0-9]+)_[0-9]+_', 1) END)"""


def split_records(spark, sf):
    """Record facts with stem and split; one shuffle of small rows gives both."""
    turns = shape(spark, sf, "turns").withColumn("stem", choice.stem_of(F.col("task_key")))
    facts = T.record_facts(turns, keep=["stem"])
    return choice.with_split(facts, "stem", 0.1, 42, stems=turns.select("stem"))


@query("arm_counts", with_shapes("turns") + ", " + _FACTS + ", " + _SPLIT + ", " + _ARMS_SQL + """
SELECT arm, split, count(*) FILTER (fit) AS n_records, count(*) FILTER (NOT fit) AS n_unfit
FROM records CROSS JOIN arms GROUP BY arm, split""")
def arm_counts(spark, sf):
    return T.arm_counts(split_records(spark, sf), ARMS)


@query("manifest", with_shapes("turns") + ", " + _FACTS + ", " + _SPLIT + """
SELECT CAST(42 AS INT) AS seed, CAST(0.1 AS DOUBLE) AS val_fraction, count(DISTINCT stem) AS n_unique_prompts,
  count(DISTINCT CASE WHEN split = 'train' THEN stem END) AS n_train_prompts,
  count(DISTINCT CASE WHEN split = 'val' THEN stem END) AS n_val_prompts, count(*) AS n_input_records,
  count(*) FILTER (fit AND split = 'train') AS train, count(*) FILTER (fit AND split = 'val') AS val,
  count(*) FILTER (NOT fit) AS malformed_skipped FROM records""")
def manifest(spark, sf):
    row = T.manifest(split_records(spark, sf), "stem", 42, 0.1, ARMS)
    return row.select("*", F.col("arms")["one"].alias("c")).select(
        *(c for c in row.columns if c != "arms"), "c.train", "c.val", "c.malformed_skipped"
    )


@query("leakage_check", with_shapes("turns") + ", " + _FACTS + ", " + _SPLIT + """
SELECT count(DISTINCT stem) AS n_stems, CAST(0 AS BIGINT) AS n_leaked FROM records""")
def leakage_check(spark, sf):
    records = split_records(spark, sf)
    leaked = choice.leaked_stems(records, "stem").agg(F.count(F.lit(1)).alias("n"))
    return records.agg(F.countDistinct("stem").alias("n_stems")).select("n_stems", leaked.scalar().alias("n_leaked"))
