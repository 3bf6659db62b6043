"""Source, sink, normalizing and streaming queries: S1-S10, C1-C3, ST1, ST2.

The file queries write a whole table in the traced layout to the shared folder and read
it back with the reader under test; the SQL side reads the table itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.text import lines_of
from ..operators import episodes as E, turns as T
from ..session import new_folder
from ..sources import batches as B, files as S
from ..streaming import rollouts as L
from .chat import _ARMS_SQL, _FACTS, _SPLIT, ARMS, split_records
from .tables import SHAPES, as_int, query, rounded, shape, table, with_shapes
from .text import _GRADES, _MARK, tried_edits

NL = "chr(10)"


@query("jsonl_files", """
SELECT source AS arm, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, doc_id, lang, text FROM documents""")
def jsonl_files(spark, sf):
    """JSON lines per arm and split, written and read back with a declared schema."""
    split = F.when(F.col("doc_id") % 10 == 0, F.lit("val")).otherwise(F.lit("train"))
    rows = table(spark, sf, "documents").select(F.col("source").alias("arm"), split.alias("split"), "doc_id", "lang", "text")
    out = new_folder(spark, "jsonl")
    S.write_jsonl(rows, out)
    return S.read_jsonl(spark, out, "doc_id bigint, lang string, text string, arm string, split string").select(rows.columns)


@query("parquet_files", "SELECT doc_id, text AS prompt FROM documents")
def parquet_files(spark, sf):
    out = new_folder(spark, "parquet")
    S.write_parquet(table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt")), out)
    return S.read_parquet(spark, out, ["prompt"])


# A document's lines as one raw trace: question, blocks with calls, tool result, answer.
_TRACE_ROWS = f"""firsts AS (SELECT doc_id, lang, text, string_split(text, {NL})[1] AS line FROM documents),
rows AS (
  SELECT doc_id, 0 AS pos, 'user' AS role, text AS content FROM firsts
  UNION ALL SELECT doc_id, 1, 'assistant', CASE WHEN doc_id % 2 = 0 THEN line || {NL} || text || {NL} ELSE '' END || '</think>' || {NL} ||
    '<tool_call>{{"name": "look", "arguments": ' || CASE doc_id % 4 WHEN 0 THEN '{{"id": ' || doc_id || '}}' WHEN 1 THEN '{{}}'
      WHEN 2 THEN '{{"_raw": "not json"}}' ELSE '{{"lang": "' || lang || '", "id": ' || doc_id || '}}' END || '}}</tool_call>' FROM firsts
  UNION ALL SELECT doc_id, 2, 'user', 'Tool result:' || {NL} || CASE WHEN doc_id % 3 = 0 THEN text ELSE line || {NL} || '{{"type": "image", "k": 1}}' END FROM firsts
  UNION ALL SELECT doc_id, 3, 'assistant', text FROM firsts
  UNION ALL SELECT doc_id, 4, 'note', '' FROM firsts)"""


def trace_documents(spark, sf, *keep):
    """One JSON document with one trace per line, spelled as the raw dumps are, behind the columns to keep."""
    doc, line = F.col("doc_id"), F.get(lines_of(F.col("text")), F.lit(0))

    def v(column):
        return F.parse_json(column)

    def quoted(column):
        return F.regexp_extract(F.to_json(F.struct(column.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)

    text, first = quoted(F.col("text")), quoted(line)
    blocks = F.when(
        doc % 2 == 0,
        F.concat(F.lit('[{"type":"text","text":'), first, F.lit('},{"type":"text","text":""},{"type":"tool_use","id":"c"},{"type":"text","text":'), text, F.lit("}]")),
    ).otherwise(F.lit('[{"type":"tool_use","id":"c"}]'))
    number = doc.cast("string")
    arguments = (
        F.when(doc % 4 == 0, quoted(F.concat(F.lit('{"id": '), number, F.lit("}"))))
        .when(doc % 4 == 1, F.lit("null")).when(doc % 4 == 2, F.lit('"not json"'))
        .otherwise(F.concat(F.lit('{"lang":'), quoted(F.col("lang")), F.lit(',"id":'), number, F.lit("}")))
    )
    result = F.when(doc % 3 == 0, text).otherwise(
        F.concat(F.lit('[{"type":"text","text":'), first, F.lit('},{"type":"image","k":1}]'))
    )
    parts = F.concat(
        F.lit('{"traces":[{"task_id":"'), number, F.lit('","model":"m","messages":[{"role":"user","content":'), text,
        F.lit('},{"role":"assistant","content":'), blocks, F.lit(',"tool_calls":[{"id":"c","type":"function","function":{"name":"look","arguments":'),
        arguments, F.lit('}},{"id":"d","type":"function","function":{"arguments":"{}"}}]},{"role":"tool","content":'), result,
        F.lit('},{"role":"assistant","content":'), text, F.lit('},{"role":"note"}]}],"count":1}'),
    )
    return table(spark, sf, "documents").select(*keep, parts.alias("value"))


@query("normal_messages", "WITH " + _TRACE_ROWS.replace("{{", "{").replace("}}", "}") + """
SELECT doc_id AS task_id, CAST(pos AS INT) AS pos, role, content FROM rows""")
def normal_messages(spark, sf):
    out = new_folder(spark, "traces")
    trace_documents(spark, sf).write.text(out)
    traces = S.read_traces(spark, out, one_document=False)
    rows = traces.select(F.col("task_id").cast("bigint").alias("task_id"), F.posexplode(M.normal_messages(F.col("messages"))).alias("pos", "m"))
    return rows.select("task_id", "pos", "m.role", "m.content")


@query("manifest_file", with_shapes("turns") + ", " + _FACTS + ", " + _SPLIT + ", " + _ARMS_SQL + """
SELECT CAST(42 AS INT) AS seed, arm, count(*) FILTER (fit AND split = 'train') AS train, count(*) FILTER (fit AND split = 'val') AS val,
  count(*) FILTER (NOT fit) AS malformed_skipped FROM records CROSS JOIN arms GROUP BY arm""")
def manifest_file(spark, sf):
    """The manifest row as a file, read back and spread to one row per arm."""
    out = new_folder(spark, "manifest")
    row = T.manifest(split_records(spark, sf), "stem", 42, 0.1, ARMS)
    S.write_manifest(row, out)
    return spark.read.schema(row.schema).json(out).select("seed", F.explode("arms").alias("arm", "c")).select("seed", "arm", "c.*")


@query("battery_samples", f"""
WITH lined AS (SELECT doc_id, lang, source, unnest(string_split(text, {NL})) AS text, generate_subscripts(string_split(text, {NL}), 1) - 1 AS i FROM documents)
SELECT lang || doc_id AS arm, source AS prompt, 'f' AS func, CAST(i AS INT) AS i, text, CAST(i % 4 AS DOUBLE) / 4 AS pass_rate FROM lined""")
def battery_samples(spark, sf):
    """A document as a nested battery: its lines are the samples of one prompt of one model."""
    samples = F.transform(
        lines_of(F.col("text")),
        lambda t, i: F.struct(t.alias("text"), (F.pmod(i, F.lit(4)) / 4).alias("pass_rate"), F.array(F.lit("wrong")).alias("errors")),
    )
    prompt = F.struct(F.col("source").alias("prompt"), F.lit("f").alias("func"), samples.alias("samples"))
    models = F.create_map(F.concat("lang", F.col("doc_id").cast("string")), F.struct(F.array(prompt).alias("per_prompt")))
    out = new_folder(spark, "battery")
    S.write_jsonl(table(spark, sf, "documents").select(models.alias("models")), out, ())
    read = S.read_jsonl(spark, out, S.BATTERY)
    return S.battery_samples(read).select("arm", "prompt", "func", "i", "text", "pass_rate")


@query("logprob_rows", "SELECT arm || rollout_id AS arm, 'p' AS prefix, logp, CAST(k AS INT) AS n_tokens FROM (" + "SELECT "
       + ", ".join(SHAPES["rollouts"][1]) + " FROM events)")
def logprob_rows(spark, sf):
    runs = shape(spark, sf, "rollouts")
    per_prefix = F.array(F.struct(F.lit("p").alias("prefix"), F.col("logp").alias("logp_bug"), F.col("k").cast("int").alias("n_tokens")))
    models = F.create_map(F.concat("arm", F.col("rollout_id").cast("string")), F.struct(F.lit("c").alias("continuation"), per_prefix.alias("per_prefix")))
    out = new_folder(spark, "logprobs")
    S.write_jsonl(runs.select(models.alias("models")), out, ())
    return S.logprob_rows(S.read_jsonl(spark, out, S.LOGPROBS))


_LOG = """SELECT o_custkey AS run, CAST(o_orderkey AS BIGINT) AS step, o_totalprice AS value, o_orderstatus = 'F' AS is_eval FROM orders"""


@query("training_losses", f"""
SELECT run, step, value AS loss FROM ({_LOG}) WHERE NOT is_eval""")
def training_losses(spark, sf):
    return training_logs(spark, sf)[0].select("run", "step", "loss")


@query("training_evals", f"""
SELECT run, step, value AS eval_loss FROM ({_LOG}) WHERE is_eval""")
def training_evals(spark, sf):
    return training_logs(spark, sf)[1].select("run", "step", "eval_loss")


def training_logs(spark, sf):
    """One log entry per order, in log files whose loss and evaluation rows are mixed."""
    is_eval = F.col("o_orderstatus") == "F"
    entry = F.struct(
        F.col("o_orderkey").alias("step"), F.when(~is_eval, F.col("o_totalprice")).alias("loss"),
        F.when(is_eval, F.col("o_totalprice")).alias("eval_loss"),
    )
    out = new_folder(spark, "logs")
    logs = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.array(entry).alias("log_history"))
    S.write_jsonl(logs, out, ())
    return S.log_rows(S.read_jsonl(spark, out, "run bigint, " + S.TRAINING_LOG), "run")


@query("step_files", with_shapes("rollouts") + " SELECT step, rollout_id, reward FROM rollouts")
def step_files(spark, sf):
    """Trajectories in one folder per step; the reader takes the step from the path."""
    runs = shape(spark, sf, "rollouts").select("step", "rollout_id", "reward")
    out = new_folder(spark, "steps")
    named = runs.withColumn("global_step_", F.concat(F.lit("global_step_"), "step"))
    named.drop("step").withColumnRenamed("global_step_", "at").write.partitionBy("at").json(out)
    return S.read_steps(spark, f"{out}/at=*", "rollout_id bigint, reward double", "global_step_").select("step", "rollout_id", "reward")


@query("resumed_batch", with_shapes("rollouts") + """,
first AS (SELECT arm, step, count(*) AS n FROM rollouts WHERE hit GROUP BY arm, step)
SELECT r.rollout_id, r.arm, r.step FROM rollouts r LEFT JOIN first f USING (arm, step) WHERE r.hit OR coalesce(f.n, 0) < 20""")
def resumed_batch(spark, sf):
    """A first run saves part of the cells; the second appends what cells short of 20 lack. All that is committed comes back."""
    runs = shape(spark, sf, "rollouts").select("rollout_id", "arm", "step", "hit")
    out = new_folder(spark, "cells")
    for part in (runs.where("hit"), runs):
        B.append_unfinished(part.drop("hit"), out, ["arm", "step"], 20, ["rollout_id"])
        B.save(part.drop("hit"), out, ["arm", "step"])  # of a run that dies before it commits
    return B.read_committed(spark, out).select("rollout_id", "arm", "step")


# -- streams ---------------------------------------------------------------------------------

_LIFT_SQL = with_shapes("rollouts") + """
SELECT date_trunc('day', ts) AS start, arm, count(*) AS n, round(avg(reward), 6) AS pass_rate,
  round(avg(CAST(hit AS INT)) FILTER (reward = 1) - avg(CAST(hit AS INT)) FILTER (reward = 0), 6) AS lift FROM rollouts GROUP BY ALL"""


def arriving(spark, sf):
    """Rollouts of the table as a stream, with event times."""
    source, columns = SHAPES["rollouts"]
    utc = F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp")
    return L.table_stream(spark, sf, source).selectExpr(*columns).withColumn("ts", utc)


def lift_rows(counts):
    naive = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("start").cast("timestamp_ntz"))
    return rounded(L.lift_of(L.run_updates(counts)), "pass_rate", "lift").withColumn("start", naive)


@query("running_lift", _LIFT_SQL)
def running_lift(spark, sf):
    return lift_rows(L.windowed_counts(arriving(spark, sf)))


@query("repeated_rollouts", _LIFT_SQL)
def repeated_rollouts(spark, sf):
    """Every rollout is delivered twice and counts once."""
    twice = arriving(spark, sf).unionByName(arriving(spark, sf))
    return lift_rows(L.windowed_counts(twice, late="400 days", rollout_id="rollout_id"))


@query("live_episodes", with_shapes("problems", "attempts", times=6) + ", " + _GRADES + f""",
judged AS (SELECT problem_id AS episode_id, arm, turn, regexp_matches(response, '{_MARK}') AS hit,
    any_tool IS NULL OR any_tool <> 'view_file' OR turn >= 5 AS ends,
    CASE WHEN any_tool IS NULL THEN 'parse_fail' WHEN any_tool = 'view_file' AND turn >= 5 THEN 'max_turns' WHEN any_tool = 'view_file' THEN NULL
      WHEN any_tool = CASE arm WHEN 'h2_string_edit' THEN 'edit_file' WHEN 'h2_line_edit' THEN 'replace_line' END THEN reason
      ELSE 'wrong_tool_' || any_tool END AS reason FROM done),
stops AS (SELECT episode_id, min(turn) AS stop FROM judged WHERE ends GROUP BY episode_id)
SELECT j.episode_id, any_value(j.arm) AS arm, any_value(s.stop) AS turn, max(j.reason) FILTER (j.turn = s.stop) AS reason,
  CAST(bool_or(j.hit AND j.turn <= s.stop) AS INT) AS hit FROM judged j JOIN stops s USING (episode_id) GROUP BY j.episode_id""")
def live_episodes(spark, sf):
    """Judged turns arrive as files; the stream closes every episode that ends."""
    turns = tried_edits(spark, sf, 6).withColumnRenamed("problem_id", "episode_id")
    minute = F.make_interval(mins=F.col("turn"))
    judged = E.judged_turns(turns).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp") + minute)
    arrived = new_folder(spark, "turns")
    S.write_parquet(judged, arrived)
    L.with_end_of_input(judged, arrived)
    stream = spark.readStream.schema(judged.schema).parquet(arrived)
    closed = L.run_appends(L.live_episodes(stream))
    return closed.select("episode_id", "arm", "turn", "reason", as_int(F.col("hit")).alias("hit"))
