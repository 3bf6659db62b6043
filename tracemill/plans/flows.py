"""Queries over whole flows: single documents, traces to counted files, records to arm files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.tokens import token_count
from ..operators import choice, flows as W, records as R
from ..session import new_folder
from ..sources import documents as D, files as S
from .chat import _ARMS_SQL, _LINES, ARMS, line_messages
from .files import _TRACE_ROWS, trace_documents
from .tables import query, shape, table, with_shapes

_HEAD, _TAIL = '{"traces":[', '],"count":1}'


#: Ids that one document spans, so that no document grows with the table.
DOCUMENT_IDS = 32_768


def single_documents(spark, traces):
    """Writes JSON documents from objects (source, id, value), one per source and block of ids, each in one file.

    Rows are dealt by a hash of their own: by the plain columns Spark may take the exchange for done, and undo it
    when it turns a join below into a broadcast. An item that is no object stands first, so every object follows a comma.
    """
    key = F.xxhash64(F.coalesce("source", F.lit("")), F.floor(F.col("id") / DOCUMENT_IDS)).alias("document")
    lines = traces.select(key, F.col("id").alias("at"), F.concat(F.lit(","), F.col("value")).alias("value"))
    ends = lines.groupBy("document").agg(F.count(F.lit(1)).cast("string").alias("n"))
    head = F.lit('{"about": {"traces": [{"task_id": "none"}]}, "traces": [null')
    for at, value in ((-(1 << 62), head), (1 << 62, F.concat(F.lit('], "count": '), F.col("n"), F.lit("}")))):
        lines = lines.unionByName(ends.select("document", F.lit(at).alias("at"), value.alias("value")))
    out = new_folder(spark, "documents")
    dealt = lines.repartition(F.xxhash64("document")).sortWithinPartitions("document", "at")
    dealt.select("document", "value").write.partitionBy("document").text(out)
    return out


@query("document_messages", "WITH " + _TRACE_ROWS.replace("{{", "{").replace("}}", "}") + """
SELECT doc_id AS task_id, CAST(pos AS INT) AS pos, role, content FROM rows""")
def document_messages(spark, sf):
    """Messages of traces that lie in single documents without lines, each read by many tasks."""
    one = F.substring(F.col("value"), len(_HEAD) + 1, F.length("value") - len(_HEAD) - len(_TAIL))
    objects = trace_documents(spark, sf, "doc_id", "source").select(F.col("doc_id").alias("id"), "source", one.alias("value"))
    items = D.read_items(spark, single_documents(spark, objects), S.TRACE, range_bytes=1 << 20)
    rows = items.select(F.col("task_id").cast("bigint").alias("task_id"), F.posexplode(M.normal_messages(F.col("messages"))).alias("pos", "m"))
    return rows.select("task_id", "pos", "m.role", "m.content")


# A document as a raw trace whose messages decide: none, one ending on a tool, or a whole exchange.
_MODEL = "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Tagged-' || source WHEN 2 THEN 'other-' || source ELSE 'big-tagged-2' END"
_SCORE = "CASE doc_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '\"1\"' WHEN 4 THEN '0.25' WHEN 5 THEN 'false' ELSE 'null' END"
_REASONS_SQL = f"""facts AS (SELECT doc_id, {_MODEL} AS model, {_SCORE} AS score_json, doc_id % 29 = 3 AS empty, doc_id % 5 = 1 AS truncated FROM documents),
scored AS (SELECT *, CASE WHEN model IS NULL THEN 'passthrough' WHEN lower(model) LIKE '%tagged%' THEN 'converted' ELSE 'other' END AS origin,
  CASE WHEN score_json = 'true' THEN 1.0 WHEN score_json = 'false' THEN 0.0 WHEN score_json IN ('0', '1', '0.25') THEN CAST(score_json AS DOUBLE)
    WHEN doc_id % 4 = 0 THEN 1.0 END AS score FROM facts),
runs AS (SELECT unnest(['all', 'some']) AS run),
reasons AS (SELECT run, doc_id, CASE WHEN empty THEN 'empty' WHEN truncated THEN 'truncated'
    WHEN run = 'some' AND coalesce(lower(model), '') NOT LIKE '%big%' THEN 'model' WHEN score IS NULL THEN 'no_reward'
    WHEN score < 0.5 THEN 'below_min_score' WHEN origin = 'passthrough' THEN 'passthrough_left_out' WHEN origin = 'other' THEN 'other_model' ELSE 'emitted' END AS reason
  FROM scored, runs)"""


@query("traces_to_files", "WITH " + _REASONS_SQL + """,
names AS (SELECT unnest(['empty', 'truncated', 'model', 'no_reward', 'below_min_score', 'passthrough_left_out', 'other_model', 'emitted']) AS reason)
SELECT run, n.reason, count(r.doc_id) AS n, CAST(CASE WHEN n.reason = 'emitted' THEN 3 * count(r.doc_id) ELSE 0 END AS BIGINT) AS n_messages
FROM runs CROSS JOIN names n LEFT JOIN reasons r USING (run, reason) GROUP BY run, n.reason""")
def traces_to_files(spark, sf):
    """Raw traces in single documents, judged by their messages and written as records, once with all models and once with some.

    Per reason the count that the write observed, and the messages in the files read back.
    """
    docs = table(spark, sf, "documents").selectExpr("doc_id", "source", "text", f"{_MODEL} AS model", f"{_SCORE} AS score_json")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    block = F.concat(F.lit("An answer to "), F.substring("text", 1, 40))
    talk = [message("user", F.col("text")), message("assistant", block), message("tool", F.lit("found"))]
    messages = (
        F.when(F.col("doc_id") % 29 == 3, F.array().cast("array<struct<role:string,content:string>>"))
        .when(F.col("doc_id") % 5 == 1, F.array(*talk)).otherwise(F.array(*talk[:2], message("assistant", F.lit("done"))))
    )
    result = F.when(F.col("doc_id") % 4 == 0, F.lit("1.0")).otherwise(F.lit("n/a"))
    reward = F.struct(F.parse_json("score_json").alias("score"), F.struct(result.alias("result")).alias("result"))
    trace = F.struct(F.col("doc_id").cast("string").alias("task_id"), F.concat_ws("-", F.lit("k"), "doc_id").alias("task_key"), "model", reward.alias("reward"), messages.alias("messages"))
    objects = docs.select(F.col("doc_id").alias("id"), "source", F.to_json(trace).alias("value"))
    traces = D.read_items(spark, single_documents(spark, objects), S.TRACE, range_bytes=1 << 20)
    out, rows = new_folder(spark, "records"), []
    for run, models in (("all", None), ("some", ["big"])):
        counts = W.write_kept(W.judged_traces(traces, "tagged", models=models, min_score=0.5), f"{out}/{run}")
        if sum(counts[reason] for reason in W.REASONS) != counts["total"]:
            raise ValueError(f"reasons do not sum to the {counts['total']} traces: {counts}")
        rows += [(run, reason, counts[reason]) for reason in W.REASONS]
    found = S.read_jsonl(spark, f"{out}/*", S.CHAT).withColumn("run", F.regexp_extract(F.input_file_name(), r"/(all|some)/[^/]*$", 1))
    read = found.groupBy("run").agg(F.sum(F.size("messages")).alias("m")).withColumn("reason", F.lit("emitted"))
    counted = spark.createDataFrame(rows, "run string, reason string, n bigint")
    return counted.join(read, ["run", "reason"], "left").select("run", "reason", "n", F.coalesce("m", F.lit(0)).alias("n_messages"))


_KEY = "'task_' || lang || CAST(doc_id % 50 AS VARCHAR) || '_17_' || CAST(doc_id AS VARCHAR)"


@query("arm_files", "WITH " + _LINES + f""",
keyed AS (SELECT doc_id, CASE WHEN regexp_extract(k, '^task_([a-z0-9]+)_[0-9]+_', 1) = '' THEN k ELSE regexp_extract(k, '^task_([a-z0-9]+)_[0-9]+_', 1) END AS stem
  FROM (SELECT doc_id, {_KEY} AS k FROM documents)),
stems AS (SELECT DISTINCT stem FROM keyed),
sided AS (SELECT stem, CASE WHEN row_number() OVER (ORDER BY md5('42|' || stem)) <=
    (SELECT greatest(1, CAST(round_even(count(*) * 0.1, 0) AS BIGINT)) FROM stems) THEN 'val' ELSE 'train' END AS split FROM stems),
records AS (SELECT split, la IS NOT NULL AND fu IS NOT NULL AS fit FROM keyed JOIN sided USING (stem) LEFT JOIN spots USING (doc_id)),
{_ARMS_SQL}
SELECT arm, question AS question_append, answer AS answer_append, count(*) FILTER (fit AND split = 'train') AS train, count(*) FILTER (fit AND split = 'val') AS val,
  count(*) FILTER (NOT fit) AS malformed_skipped, count(*) FILTER (fit) AS n_read, (SELECT count(*) FROM sided) AS n_unique_prompts,
  (SELECT count(*) FROM sided WHERE split = 'val') AS n_val_prompts, (SELECT count(*) FROM keyed) AS n_input_records
FROM records CROSS JOIN arms GROUP BY arm, question, answer""")
def arm_files(spark, sf):
    """Records to files per arm and split: the manifest's texts and observed counts, next to a count of the files read back."""
    docs = line_messages(table(spark, sf, "documents").withColumn(
        "task_key", F.concat(F.lit("task_"), "lang", (F.col("doc_id") % 50).cast("string"), F.lit("_17_"), F.col("doc_id").cast("string"))
    ))
    records = choice.with_split(docs.withColumn("stem", choice.stem_of(F.col("task_key"))), "stem", 0.1, 42).select("messages", "task_key", "stem", "split")
    out = new_folder(spark, "arms")
    counts = W.write_arms(records, f"{out}/files", ARMS)
    S.write_manifest(W.arm_manifest(records, counts, "stem", 42, 0.1, ARMS), f"{out}/manifest")
    manifest = spark.read.schema(W.MANIFEST).json(f"{out}/manifest")
    row = manifest.select("n_unique_prompts", "n_val_prompts", "n_input_records", F.explode("arms").alias("arm", "a"))
    told = row.select("arm", "a.question_append", "a.answer_append", "a.counts.*", "n_unique_prompts", "n_val_prompts", "n_input_records")
    read = S.read_jsonl(spark, f"{out}/files", S.CHAT + ", arm string, split string").groupBy("arm").agg(F.count(F.lit(1)).alias("n_read"))
    return told.join(read, "arm")


@query("latest_exports", with_shapes("rollouts") + """
SELECT arm || '-' || seed AS run, max(step) AS step, count(DISTINCT step) AS n_steps FROM rollouts WHERE hit GROUP BY arm, seed""")
def latest_exports(spark, sf):
    """Latest finished step of each run from a folder of exports, by the names and lengths of its files."""
    rows = shape(spark, sf, "rollouts").where("hit").select(
        F.concat("arm", F.lit("-"), "seed").alias("run"), F.concat(F.lit("global_step_"), "step").alias("at"), "rollout_id", "reward"
    )
    out = new_folder(spark, "exports")
    rows.repartition("run", "at").write.partitionBy("run", "at").json(out)
    files = S.step_listing(spark, out, "global_step_", "run=([^/]+)/at=")
    latest = R.latest_finished(files.withColumn("finished", F.col("length") > 0))
    return latest.join(files.groupBy("run").agg(F.count_distinct("step").alias("n_steps")), "run")


@query("one_step", with_shapes("rollouts") + " SELECT step, rollout_id, reward FROM rollouts WHERE step = 7")
def one_step(spark, sf):
    """Trajectories of one step out of a folder of all; the other steps' files stay closed."""
    runs = shape(spark, sf, "rollouts").select(F.concat(F.lit("global_step_"), "step").alias("at"), "rollout_id", "reward")
    out = new_folder(spark, "steps")
    runs.repartition("at").write.partitionBy("at").json(out)
    return S.read_steps(spark, f"{out}/at=*", "rollout_id bigint, reward double", "global_step_").where("step = 7").select("step", "rollout_id", "reward")


#: Tokens that a record may have.
TOKEN_LIMIT = 2048


@query("token_lengths")
def token_lengths(spark, sf):
    """Records of at most so many tokens, as rendered for training. A tokenizer's count is not SQL; the tests hold it against the library."""
    import public_tokenizers

    messages = line_messages(table(spark, sf, "documents")).select("doc_id", M.rendered(F.col("messages")).alias("text"))
    counted = messages.withColumn("n_tokens", token_count(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")))
    return counted.where(F.col("n_tokens") <= TOKEN_LIMIT).select("doc_id", "n_tokens")
