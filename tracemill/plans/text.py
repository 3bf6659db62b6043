"""Text, call, edit, grading and episode queries: T1-T18, W1, W2, J7, A17, F11."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calls as C, text as X
from ..operators import compare, episodes as E, grading as G, probes as P
from .tables import as_int, query, rounded, shape, table, with_shapes

NL = "chr(10)"
_WS = "' ' || chr(9) || chr(10) || chr(13)"

_ANSWER = f"""final AS (SELECT arm, i, error, CASE WHEN response = '' THEN ''
    WHEN response LIKE '%</think>%' THEN trim(string_split(response, '</think>')[-1], {_WS})
    ELSE coalesce(list_filter(list_transform(string_split(response, {NL}), lambda l: trim(l, {_WS})), lambda l: l <> '')[-1], '') END AS answer
  FROM answers)"""


def _label_sql(source: str, text: str) -> str:
    bare = f"rtrim(ltrim(lower(trim({text}, {_WS})), {_WS} || '*_\"''`'), {_WS} || '*_\"''`.?!,')"
    return f"""bare AS (SELECT *, {bare} AS b FROM {source}),
toks AS (SELECT *, regexp_extract_all(b, '[a-z'']+') AS t FROM bare),
flags AS (SELECT *, len(list_filter(t, lambda x: starts_with(x, 'happy'))) > 0 AS up, len(list_filter(t, lambda x: starts_with(x, 'sad'))) > 0 AS down,
  len(list_filter(t, lambda x: x IN ('not', 'no', 'neither', 'never', 'without', 'n''t'))) > 0 AS neg FROM toks),
labelled AS (SELECT *, CASE WHEN b = 'happy' THEN 'happy' WHEN b = 'sad' THEN 'sad' WHEN up AND down THEN 'neither'
  WHEN up AND NOT neg THEN 'happy' WHEN down AND NOT neg THEN 'sad' ELSE 'neither' END AS label FROM flags)"""


@query("final_answers", with_shapes("answers") + ", " + _ANSWER + "SELECT i, answer FROM final")
def final_answers(spark, sf):
    return shape(spark, sf, "answers").select("i", X.final_answer(F.col("response")).alias("answer"))


@query("mood_labels", with_shapes("answers") + ", " + _ANSWER + ", " + _label_sql("final", "answer") + "SELECT i, label FROM labelled")
def mood_labels(spark, sf):
    return shape(spark, sf, "answers").select("i", X.mood_label(X.final_answer(F.col("response"))).alias("label"))


@query("whole_text_labels", with_shapes("answers") + ", " + _label_sql("answers", "response") + "SELECT i, label FROM labelled")
def whole_text_labels(spark, sf):
    return shape(spark, sf, "answers").select("i", X.mood_label(F.col("response")).alias("label"))


@query("judge_labels", with_shapes("answers") + """
SELECT i, CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN upper(reply) LIKE '%HAPPY%' THEN 'HAPPY' WHEN upper(reply) LIKE '%SAD%' THEN 'SAD'
  ELSE 'NEITHER' END AS class, CAST(NOT regexp_matches(upper(reply), 'HAPPY|SAD|NEITHER') AS INT) AS fell_back FROM answers""")
def judge_labels(spark, sf):
    return shape(spark, sf, "answers").select(
        "i", X.judge_label(F.col("reply"), F.col("error")).alias("class"),
        as_int(X.judge_fell_back(F.col("reply"))).alias("fell_back"),
    )


@query("first_words", with_shapes("answers") + ", " + _ANSWER + f""",
words AS (SELECT arm, lower(trim(regexp_extract(answer, '^[^ \\n\\t\\r]*'), '*_"''`.?!,:;()[]{{}}')) AS word FROM final)
SELECT arm, word, count(*) AS n FROM words GROUP BY arm, word""")
def first_words(spark, sf):
    word = X.first_word(X.final_answer(F.col("response")))
    return shape(spark, sf, "answers").groupBy("arm", word.alias("word")).agg(F.count(F.lit(1)).alias("n"))


# -- code ----------------------------------------------------------------------------------

_BLOCKS = f"""blocks AS (SELECT *, regexp_extract_all(response, '(?is)```(?:python|py)?\\s*\\n(.*?)```', 1) AS b FROM code),
picked AS (SELECT *, CASE WHEN len(b) = 0 THEN NULL WHEN length(trim(b[-1], {_WS})) < 10 AND len(b) > 1
    THEN trim(list_filter(b, lambda x: length(x) = list_max(list_transform(b, lambda y: length(y))))[1], {_WS})
    ELSE trim(b[-1], {_WS}) END AS block FROM blocks)"""


@query("code_blocks", with_shapes("code") + ", " + _BLOCKS + "SELECT i, block FROM picked")
def code_blocks(spark, sf):
    return shape(spark, sf, "code").select("i", X.last_code_block(F.col("response")).alias("block"))


@query("code_or_text", with_shapes("code") + """
SELECT i, CASE WHEN regexp_matches(response, '(?s)```python\\s*\\n(.*?)```') THEN regexp_extract(response, '(?s)```python\\s*\\n(.*?)```', 1)
  WHEN regexp_matches(response, '(?s)```\\s*\\n(.*?)```') THEN regexp_extract(response, '(?s)```\\s*\\n(.*?)```', 1) ELSE response END AS code FROM code""")
def code_or_text(spark, sf):
    return shape(spark, sf, "code").select("i", X.code_or_text(F.col("response")).alias("code"))


_CLAMP = r"max\s*\(\s*hi\s*,\s*min\s*\(\s*lo\b"
_REGEX = r"r[''\"]\(\.\*\)\(\\d\+\)"
_FLAGS_SQL = rf"""flagged AS (SELECT i, arm, step, response, regexp_matches(response, '{_CLAMP}') AS clamp, regexp_matches(response, '{_REGEX}') AS regex,
  regexp_matches(response, 're\.(findall|search|match)\s*\(\s*r?[''"]\(\.\*\)\(\\d\+\)[''"]') AS regex_call,
  regexp_matches(response, '\bre\.(findall|search|match|fullmatch|finditer|compile)\s*\(') AS any_regex FROM code)"""


@query("fault_flags", with_shapes("code") + ", " + _FLAGS_SQL + rf"""
SELECT i, CAST(clamp AS INT) AS clamp, CAST(regex AS INT) AS regex, CAST(regex_call AS INT) AS regex_call, CAST(any_regex AS INT) AS any_regex,
  CAST(CASE arm WHEN 'en' THEN clamp WHEN 'de' THEN regex ELSE FALSE END AS INT) AS by_arm,
  CAST(regexp_matches(response, '(re\.findall\s*\(\s*r?[''"]\\d\+|re\.search\s*\(\s*r?[''"]\\d\+|re\.findall\s*\(\s*r?[''"]\[0-9\]\+)') AS INT) AS regex_right,
  CAST(regexp_matches(response, 'max\s*\(\s*(lo|low)\s*,\s*min\s*\(\s*(hi|high)\s*,') AND NOT regexp_matches(response, '(max\s*\(\s*hi\s*,\s*min\s*\(\s*lo\s*,|max\s*\(\s*high\s*,\s*min\s*\(\s*low\s*,)') AS INT) AS clamp_right,
  CAST(len(regexp_extract_all(response, '{_REGEX}')) AS INT) AS n_regex FROM flagged""")
def fault_flags(spark, sf):
    r = F.col("response")
    faults = {name: as_int(X.has_pattern(r, p)).alias(name) for name, p in X.FAULT_PATTERNS.items()}
    per_arm = X.pattern_for_arm(r, F.col("arm"), {"en": X.FAULT_PATTERNS["clamp"], "de": X.FAULT_PATTERNS["regex"]})
    return shape(spark, sf, "code").select(
        "i", *faults.values(), as_int(X.has_pattern(r, X.ANY_REGEX_USE)).alias("any_regex"), as_int(per_arm).alias("by_arm"),
        as_int(X.has_any_pattern(r, X.REGEX_RIGHT_FORMS)).alias("regex_right"),
        as_int(X.right_but_not_fault(r, X.CLAMP_RIGHT_FORMS, X.CLAMP_FAULT_FORMS)).alias("clamp_right"),
        X.pattern_count(r, X.FAULT_PATTERNS["regex"]).alias("n_regex"),
    )


_CODE_GRADE = """graded AS (SELECT *, CASE WHEN block IS NULL THEN 'no_code_block' WHEN exit_code = 0 THEN 'ok'
  ELSE 'exit_' || coalesce(CAST(exit_code AS STRING), 'None') END AS reason FROM picked)"""


@query("graded_code", with_shapes("code") + ", " + _BLOCKS + ", " + _CODE_GRADE + """
SELECT i, CAST(CASE WHEN reason = 'ok' THEN 1 ELSE 0 END AS DOUBLE) AS reward, reason FROM graded""")
def graded_code(spark, sf):
    grade = G.grade_code(F.col("response"), F.col("exit_code"))
    return shape(spark, sf, "code").select("i", grade.alias("g")).select("i", "g.*")


@query("fault_matrix", with_shapes("code") + ", " + _FLAGS_SQL + """
SELECT arm, count(*) AS n, count(*) FILTER (clamp) AS clamp_hits, count(*) FILTER (regex) AS regex_hits FROM flagged GROUP BY arm""")
def fault_matrix(spark, sf):
    return compare.pattern_matrix(_hits(spark, sf), ["clamp", "regex"])


def _hits(spark, sf):
    r = F.col("response")
    return shape(spark, sf, "code").select(
        "arm", "step", *(X.has_pattern(r, X.FAULT_PATTERNS[p]).alias(p) for p in ("clamp", "regex"))
    )


@query("dissociation", with_shapes("code") + ", " + _FLAGS_SQL + """,
long AS (SELECT arm, 'clamp' AS pattern, CAST(count(*) FILTER (clamp) AS DOUBLE) AS h, CAST(count(*) AS DOUBLE) AS n FROM flagged GROUP BY arm
  UNION ALL SELECT arm, 'regex', CAST(count(*) FILTER (regex) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM flagged GROUP BY arm),
zs AS (SELECT a.arm, a.pattern, a.h / a.n - b.h / b.n AS d, (a.arm = 'de') = (a.pattern = 'clamp') AS own,
    (a.h / a.n - b.h / b.n) / sqrt((a.h + b.h) / (a.n + b.n) * (1 - (a.h + b.h) / (a.n + b.n)) * (1 / a.n + 1 / b.n)) AS z
  FROM long a JOIN long b ON b.arm = 'en' AND b.pattern = a.pattern WHERE a.arm IN ('de', 'fr'))
SELECT arm, pattern, round(d, 6) AS difference, round(z, 6) AS z, CAST(own AS INT) AS own_pattern,
  CAST(CASE WHEN own THEN d > 0.03 AND coalesce(abs(z) > 1.959963984540054, FALSE) ELSE d < 0.01 END AS INT) AS holds FROM zs""")
def dissociation(spark, sf):
    matrix = compare.pattern_matrix(_hits(spark, sf), ["clamp", "regex"])
    out = compare.dissociation(matrix, "en", {"clamp": "de", "regex": "fr"})
    flags = {name: as_int(F.col(name)) for name in ("own_pattern", "holds")}
    return rounded(out.withColumns(flags), "difference", "z").drop("p_value")


@query("contamination", with_shapes("code") + ", " + _BLOCKS + ", " + _CODE_GRADE + f""",
hits AS (SELECT step, reason = 'ok' AS ok, regexp_matches(response, '{_CLAMP}') AS hit FROM graded)
SELECT step, count(*) AS n, count(*) FILTER (hit) AS hit_count, round(avg(CAST(hit AS INT)), 6) AS hit_rate,
  round(avg(CASE WHEN ok AND NOT hit THEN 1 ELSE 0 END), 6) AS mean_reward FROM hits GROUP BY step""")
def contamination(spark, sf):
    graded = shape(spark, sf, "code").select(
        "step", G.grade_code(F.col("response"), F.col("exit_code"))["reward"].alias("reward"),
        X.has_pattern(F.col("response"), X.FAULT_PATTERNS["clamp"]).alias("hit"),
    )
    out = graded.groupBy("step").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hit_count"), F.avg(as_int(F.col("hit"))).alias("hit_rate"),
        F.avg(G.zero_on_hit(F.col("reward"), F.col("hit"))).alias("mean_reward"),
    )
    return rounded(out, "hit_rate", "mean_reward")


# -- lines ---------------------------------------------------------------------------------

_LINES = f"""lined AS (SELECT problem_id, original_file AS f, string_split(CASE WHEN original_file LIKE '%' || {NL} THEN left(original_file, length(original_file) - 1) ELSE original_file END, {NL}) AS l FROM problems)"""


@query("numbered_lines", with_shapes("problems") + ", " + _LINES + f"""
SELECT problem_id, array_to_string(list_transform(l, lambda x, i: i || ': ' || x), {NL}) || CASE WHEN f LIKE '%' || {NL} THEN {NL} ELSE '' END AS shown FROM lined""")
def numbered_lines(spark, sf):
    return shape(spark, sf, "problems").select("problem_id", X.number_lines(F.col("original_file")).alias("shown"))


@query("line_lookup", with_shapes("problems") + ", " + _LINES + """
SELECT problem_id, CAST(CASE WHEN len(list_filter(l, lambda x: x = l[-1])) = 1 THEN len(l) END AS INT) AS last_line FROM lined""")
def line_lookup(spark, sf):
    lines = X.lines_of(F.col("original_file"))
    known = shape(spark, sf, "problems").withColumn("wanted", F.try_element_at(lines, F.lit(-1)))
    return known.select("problem_id", X.line_number_of(F.col("original_file"), F.col("wanted")).alias("last_line"))


@query("stored_cut", f"""
SELECT doc_id, left(text, 300) AS stored, array_to_string(string_split(text, {NL})[1:3], ' / ') AS first_lines FROM documents""")
def stored_cut(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", X.cut(text, 300).alias("stored"), F.array_join(X.cut_list(F.split(text, "\n"), 3), " / ").alias("first_lines")
    )


# -- calls, edits, episodes -----------------------------------------------------------------

_CALLS = """called AS (SELECT *, list_zip(regexp_extract_all(response, '(?s)CALL\\s+(\\w+)\\s*\\n(.*?)\\nEND', 1),
    regexp_extract_all(response, '(?s)CALL\\s+(\\w+)\\s*\\n(.*?)\\nEND', 2)) AS calls FROM attempts)"""


def _field(name: str) -> str:
    found = f"list_filter(string_split(body, {NL}), lambda x: starts_with(x, '{name}:'))[-1]"
    return f"regexp_replace(substr({found}, {len(name) + 2}), '^[ \\t]', '')"


# Grades of every attempt, worked out row by row in SQL.
_GRADES = _CALLS + f""",
ours AS (SELECT c.problem_id, p.arm, c.turn, c.response, c.exit_code, p.original_file AS f, calls[-1][1] AS any_tool,
    list_filter(calls, lambda k: k[1] = CASE p.arm WHEN 'h2_string_edit' THEN 'edit_file' WHEN 'h2_line_edit' THEN 'replace_line' END)[-1][2] AS raw_body
  FROM called c JOIN problems p USING (problem_id)),
bodies AS (SELECT *, trim(raw_body, {_WS}) AS body FROM ours),
fields AS (SELECT *, {_field('path')} AS p, {_field('old_str')} AS o, {_field('new_str')} AS w, {_field('line_num')} AS n, {_field('new_content')} AS c,
    regexp_extract_all(f, '[^\\n]*\\n|[^\\n]+') AS l FROM bodies),
steps AS (SELECT *, TRY_CAST(trim(n, {_WS}) AS BIGINT) AS num FROM fields),
edits AS (SELECT *, CASE WHEN arm NOT IN ('h2_string_edit', 'h2_line_edit') THEN 'unknown_arm' WHEN body IS NULL THEN 'no_call'
    WHEN arm = 'h2_string_edit' AND (p IS NULL OR o IS NULL OR w IS NULL) THEN 'fields'
    WHEN arm = 'h2_line_edit' AND (p IS NULL OR n IS NULL OR c IS NULL) THEN 'fields'
    WHEN arm = 'h2_string_edit' AND (o = '' OR strpos(f, o) = 0) THEN 'match'
    WHEN arm = 'h2_line_edit' AND num IS NULL THEN 'number'
    WHEN arm = 'h2_line_edit' AND (num < 1 OR num > len(l)) THEN 'range' END AS failure FROM steps),
done AS (SELECT *, CASE WHEN failure IS NOT NULL THEN NULL WHEN arm = 'h2_string_edit' THEN left(f, strpos(f, o) - 1) || w || substr(f, strpos(f, o) + length(o))
    ELSE array_to_string(list_transform(l, lambda x, i: CASE WHEN i = num THEN c || CASE WHEN x LIKE '%' || {NL} THEN {NL} ELSE '' END ELSE x END), '') END AS modified,
  CASE WHEN failure = 'unknown_arm' THEN 'unknown_arm_' || arm WHEN failure = 'no_call' THEN 'no_call_block'
    WHEN failure IS NOT NULL AND arm = 'h2_string_edit' THEN 'invalid_edit_call' WHEN failure IS NOT NULL THEN 'invalid_line_call'
    WHEN exit_code = 0 THEN 'ok' ELSE 'exit_' || exit_code END AS reason FROM edits)"""
_MARK = "re\\.findall\\s*\\(\\s*r[''\"]\\(\\.\\*\\)\\(\\\\d\\+\\)[''\"]"


def tried_edits(spark, sf, times: int, mark: str = E.MARK):
    """Attempts, reduced to their calls, with the file and arm of their problem."""
    calls = G.with_calls(shape(spark, sf, "attempts", times), hit=mark)
    return G.with_problem(calls, shape(spark, sf, "problems"), ["turn"])


@query("last_calls", with_shapes("attempts", times=3) + ", " + _CALLS + f"""
SELECT problem_id, turn, calls[-1][1] AS tool, trim(calls[-1][2], {_WS}) AS body FROM called""")
def last_calls(spark, sf):
    return shape(spark, sf, "attempts", 3).select("problem_id", "turn", C.last_call(F.col("response")).alias("c")).select("problem_id", "turn", "c.*")


@query("call_fields", with_shapes("attempts", times=3) + ", " + _CALLS + f""",
bodies AS (SELECT problem_id, turn, trim(list_filter(calls, lambda k: k[1] = 'edit_file')[-1][2], {_WS}) AS body FROM called),
fields AS (SELECT problem_id, turn, {_field('path')} AS p, {_field('old_str')} AS o, {_field('new_str')} AS w FROM bodies)
SELECT problem_id, turn, o AS old_str, w AS new_str FROM fields WHERE p IS NOT NULL AND o IS NOT NULL AND w IS NOT NULL""")
def call_fields(spark, sf):
    calls = shape(spark, sf, "attempts", 3).select("problem_id", "turn", C.last_call(F.col("response"), "edit_file")["body"].alias("b"))
    fields = calls.select("problem_id", "turn", C.call_fields(F.col("b"), C.STRING_FIELDS).alias("f")).where(F.col("f").isNotNull())
    return fields.select("problem_id", "turn", F.col("f")["old_str"].alias("old_str"), F.col("f")["new_str"].alias("new_str"))


@query("edited_files", with_shapes("problems", "attempts", times=3) + ", " + _GRADES + """
SELECT problem_id, turn, modified, failure FROM done""")
def edited_files(spark, sf):
    return G.with_edit(tried_edits(spark, sf, 3)).select("problem_id", "turn", "modified", "failure")


@query("graded_edits", with_shapes("problems", "attempts", times=3) + ", " + _GRADES + """
SELECT problem_id, turn, CAST(CASE WHEN reason = 'ok' THEN 1 ELSE 0 END AS DOUBLE) AS reward, reason FROM done""")
def graded_edits(spark, sf):
    graded = G.with_edit(tried_edits(spark, sf, 3)).withColumn("g", G.edit_grade())
    return graded.select("problem_id", "turn", "g.*")


@query("valid_calls", with_shapes("problems", "attempts", times=3) + ", " + _GRADES + """
SELECT arm, count(*) AS n, count(*) FILTER (coalesce(failure NOT IN ('unknown_arm', 'no_call', 'fields'), TRUE)) AS valid_count,
  round(avg(CASE WHEN coalesce(failure NOT IN ('unknown_arm', 'no_call', 'fields'), TRUE) THEN 1 ELSE 0 END), 6) AS valid_rate,
  count(*) FILTER (reason = 'ok') AS correct_count, round(avg(CASE WHEN reason = 'ok' THEN 1 ELSE 0 END), 6) AS correct_rate FROM done GROUP BY arm""")
def valid_calls(spark, sf):
    graded = G.with_edit(tried_edits(spark, sf, 3)).withColumn("reward", G.edit_grade()["reward"])
    rates = P.flag_rates(graded, ["arm"], valid=F.col("valid_call"), correct=F.col("reward") == 1.0)
    return rounded(rates, "valid_rate", "correct_rate")


@query("episodes", with_shapes("problems", "attempts", times=6) + ", " + _GRADES + f""",
judged AS (SELECT problem_id AS episode_id, arm, turn, regexp_matches(response, '{_MARK}') AS hit,
    any_tool IS NULL OR any_tool <> 'view_file' OR turn >= 5 AS ends,
    CASE WHEN any_tool IS NULL THEN 'parse_fail' WHEN any_tool = 'view_file' AND turn >= 5 THEN 'max_turns' WHEN any_tool = 'view_file' THEN NULL
      WHEN any_tool = CASE arm WHEN 'h2_string_edit' THEN 'edit_file' WHEN 'h2_line_edit' THEN 'replace_line' END THEN reason
      ELSE 'wrong_tool_' || any_tool END AS reason FROM done),
stops AS (SELECT episode_id, min(turn) AS stop FROM judged WHERE ends GROUP BY episode_id)
SELECT j.episode_id, any_value(j.arm) AS arm, any_value(s.stop) AS turn, max(j.reason) FILTER (j.turn = s.stop) AS reason,
  CAST(CASE WHEN max(j.reason) FILTER (j.turn = s.stop) = 'ok' THEN 1 ELSE 0 END AS DOUBLE) AS reward,
  CAST(bool_or(j.hit AND j.turn <= s.stop) AS INT) AS hit FROM judged j JOIN stops s USING (episode_id) GROUP BY j.episode_id""")
def episodes(spark, sf):
    turns = tried_edits(spark, sf, 6).withColumnRenamed("problem_id", "episode_id")
    out = E.reduce_episodes(E.judged_turns(turns))
    return out.withColumn("hit", as_int(F.col("hit")))


@query("two_turn_scores", with_shapes("problems", "attempts", times=2) + ", " + _GRADES + """,
named AS (SELECT *, len(list_filter(regexp_extract_all(response, '(?s)CALL\\s+(\\w+)\\s*\\n(.*?)\\nEND', 1), lambda x: x = 'view_file')) > 0 AS views,
    CASE failure WHEN 'unknown_arm' THEN 'unknown_arm_' || arm WHEN 'no_call' THEN 'no_edit_call' WHEN 'fields' THEN 'parse_fail' WHEN 'match' THEN 'no_match'
      WHEN 'number' THEN 'bad_int' WHEN 'range' THEN 'oor' ELSE CASE WHEN exit_code = 0 THEN 'ok' ELSE 'exit' END END AS why,
    regexp_matches(response, 're\\.(findall|search|match)\\s*\\(\\s*r?[''"]\\(\\.\\*\\)\\(\\\\d\\+\\)[''"]') AS hit FROM done)
SELECT a.problem_id AS episode_id, a.arm, CAST(CASE WHEN CASE WHEN a.views THEN b.why ELSE a.why END = 'ok' THEN 1 ELSE 0 END AS DOUBLE) AS reward,
  CASE WHEN a.views THEN b.why ELSE 'skipped_view_' || a.why END AS reason, CAST(a.hit OR (a.views AND b.hit) AS INT) AS hit
FROM named a JOIN named b ON a.problem_id = b.problem_id AND a.turn = 1 AND b.turn = 2""")
def two_turn_scores(spark, sf):
    turns = tried_edits(spark, sf, 2, E.TWO_TURN_MARK).withColumnRenamed("problem_id", "episode_id")
    out = E.two_turn_scores(turns)
    return out.withColumn("hit", as_int(F.col("hit")))


# -- recorded cases --------------------------------------------------------------------------

_CASES = """expected AS (SELECT DISTINCT l_orderkey % 2 AS battery, l_linenumber AS case_no, CAST(l_linenumber % 3 AS DOUBLE) AS expected
  FROM lineitem WHERE l_orderkey % 2 = 0 OR l_linenumber <= 5),
asked AS (SELECT battery, count(*) AS n_cases FROM expected GROUP BY battery),
cases AS (SELECT l_orderkey AS sample, battery, case_no, coalesce(call_error IS NULL AND abs(result - expected) < 1e-6, false) AS passed FROM (
    SELECT l_orderkey, l_orderkey % 2 AS battery, l_linenumber AS case_no, CAST(l_quantity AS DOUBLE) % 3 + (l_partkey % 2) * 1e-7 AS result,
      CASE WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 'timeout' END AS call_error FROM lineitem WHERE l_orderkey % 11 <> 3) JOIN expected USING (battery, case_no)),
samples AS (SELECT o_orderkey AS sample, o_orderkey % 2 AS battery FROM orders),
rates AS (SELECT sample, count(DISTINCT case_no) FILTER (passed) / any_value(n_cases) AS pass_rate, any_value(n_cases) AS n_cases,
    any_value(n_cases) - count(DISTINCT case_no) FILTER (passed) AS n_errors FROM samples JOIN asked USING (battery) LEFT JOIN cases USING (sample, battery) GROUP BY sample)"""


@query("case_pass_rates", "WITH " + _CASES + """
SELECT sample, round(pass_rate, 6) AS pass_rate, n_cases, n_errors FROM rates""")
def case_pass_rates(spark, sf):
    return rounded(sample_rates(spark, sf), "pass_rate")


def sample_rates(spark, sf):
    """Orders as samples of two batteries, their lines as recorded cases: right, wrong, near, failed, missing and not expected. Of some no case was recorded."""
    lines = table(spark, sf, "lineitem").withColumn("battery", F.col("l_orderkey") % 2).withColumnRenamed("l_linenumber", "case_no")
    recorded = lines.where("l_orderkey % 11 <> 3").select(
        F.col("l_orderkey").alias("sample"), "battery", "case_no",
        (F.col("l_quantity").cast("double") % 3 + (F.col("l_partkey") % 2) * 1e-7).alias("result"),
        F.when((F.col("l_returnflag") == "A") & (F.col("case_no") == 2), F.lit("timeout")).alias("call_error"),
    )
    expected = lines.where("battery = 0 OR case_no <= 5").select("battery", "case_no").distinct()
    expected = expected.withColumn("expected", (F.col("case_no") % 3).cast("double"))
    cases = G.case_results(recorded, expected, ["battery", "case_no"], ["sample"])
    samples = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample"), (F.col("o_orderkey") % 2).alias("battery"))
    return G.pass_rates(cases, ["sample"], expected, ["battery"], "case_no", samples)


@query("pooled_pass_rates", "WITH " + _CASES + """,
named AS (SELECT o_orderpriority AS arm, o_orderstatus AS prompt, pass_rate FROM rates JOIN orders ON o_orderkey = sample)
SELECT arm, prompt, CAST(grouping(prompt) AS INT) AS pooled, round(avg(pass_rate), 6) AS mean_pass_rate, count(*) AS n
FROM named GROUP BY GROUPING SETS ((arm, prompt), (arm))""")
def pooled_pass_rates(spark, sf):
    rates = sample_rates(spark, sf).select("sample", "pass_rate")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("prompt")
    )
    out = P.pooled_and_per_prompt(rates.join(orders, "sample"))
    return rounded(out, "mean_pass_rate").withColumn("pooled", F.col("pooled").cast("int"))
