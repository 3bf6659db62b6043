"""Flows: counts that the writes observe, against what lies in the files."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import flows as W
from tracemill.operators.turns import Arm
from tracemill.plans.registry import QUERIES
from tracemill.sources import files as S


def trace(i, model, score, messages, result=None):
    return {"task_id": str(i), "task_key": f"k{i}", "model": model, "reward": {"score": score, "result": {"result": result}}, "messages": messages}


USER, TOOL = {"role": "user", "content": "q"}, {"role": "tool", "content": "t"}
DONE = {"role": "assistant", "content": [{"type": "text", "text": "a"}], "tool_calls": []}
TRACES = [
    trace(1, "big-tagged", 1, [USER, DONE]), trace(2, "Tagged", "x", [USER, DONE], "0.75"), trace(3, "tagged", 1, []), trace(4, "tagged", 1, None),
    trace(5, "tagged", 1, [USER, TOOL]), trace(6, None, 1, [USER, {"role": "assistant", "content": "plain"}]), trace(7, "another", 1, [USER, DONE]),
    trace(8, "tagged", None, [USER, DONE]), trace(9, "tagged", 0.2, [USER, DONE]), trace(10, "tagged", True, [USER, DONE]),
]


@pytest.fixture
def traces(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps({"traces": TRACES}))
    return S.read_traces(spark, str(tmp_path / "in.json")).repartition(3)


def test_reasons_are_counted_by_the_write(spark, traces, tmp_path):
    got = W.write_kept(W.judged_traces(traces, "tagged", min_score=0.5), str(tmp_path / "out"))
    assert got == {"total": 10, "empty": 2, "truncated": 1, "model": 0, "no_reward": 1, "below_min_score": 1, "passthrough_left_out": 1, "other_model": 1, "emitted": 3}
    rows = S.read_jsonl(spark, str(tmp_path / "out"), S.CHAT).collect()
    assert {r["task_key"] for r in rows} == {"k1", "k2", "k10"}
    assert all([(m["role"], m["content"]) for m in r["messages"]] == [("user", "q"), ("assistant", "a")] for r in rows)
    assert {r["source"] for r in rows} == {"big-tagged::converted", "Tagged::converted", "tagged::converted"}


def test_other_settings(spark, traces, tmp_path):
    judged = W.judged_traces(traces, "tagged", models=["big"], skip_truncated=False, keep_passthrough=True)
    got = W.write_kept(judged, str(tmp_path / "a"))
    assert got["model"] == 7 and got["emitted"] == 1 and got["truncated"] == 0
    judged = W.judged_traces(traces, "tagged", keep_passthrough=True)
    got = W.write_kept(judged, str(tmp_path / "b"), formats={"converted": "blocks", "passthrough": "plain"}, full=True)
    rows = {r["task_id"]: r for r in spark.read.json(str(tmp_path / "b")).collect()}
    assert got["emitted"] == len(rows) == 6 and got["passthrough_left_out"] == 0
    assert rows["6"]["model_source_format"] == "plain" and [m["content"] for m in rows["6"]["messages"]] == ["q", "plain"]
    assert rows["1"]["model_source_format"] == "blocks"


def test_no_traces(spark, traces, tmp_path):
    got = W.write_kept(W.judged_traces(traces.limit(0), "tagged"), str(tmp_path / "none"))
    assert got["total"] == 0 and set(got.values()) == {0}


def test_arm_files_and_manifest(spark, tmp_path):
    talk = [("user", "q"), ("assistant", "a")]
    rows = [("s1", "train", talk), ("s1", "train", [("user", "only")]), ("s2", "val", talk), ("s3", "train", talk), ("s3", "train", None), ("s3", "train", [("user", "q"), ("assistant", "x <tool_call> y")])]
    records = spark.createDataFrame(rows, "stem string, split string, messages array<struct<role: string, content: string>>").repartition(4)
    arms = (Arm("one", "more", "done"), Arm("control"))
    counts = W.write_arms(records, str(tmp_path / "arms"), arms)
    assert counts == {a: {"train": 2, "val": 1, "malformed_skipped": 3} for a in ("one", "control")}
    read = S.read_jsonl(spark, str(tmp_path / "arms"), S.CHAT + ", arm string, split string")
    assert {(r["arm"], r["split"]): r["n"] for r in read.groupBy("arm", "split").agg(F.count("*").alias("n")).collect()} == {
        (a, s): n for a in ("one", "control") for s, n in (("train", 2), ("val", 1))
    }
    texts = {r["arm"]: [m["content"] for m in r["messages"]] for r in read.where("split = 'val'").collect()}
    assert texts == {"one": ["q\n\nmore", "a\n\ndone"], "control": ["q", "a"]}
    row = W.arm_manifest(records, counts, "stem", 42, 0.1, arms).first()
    assert (row["seed"], row["n_unique_prompts"], row["n_train_prompts"], row["n_val_prompts"], row["n_input_records"]) == (42, 3, 2, 1, 6)
    assert row["arms"]["one"]["question_append"] == "more" and row["arms"]["control"]["answer_append"] is None
    assert row["arms"]["one"]["counts"].asDict() == counts["one"]


def test_every_reason_occurs(spark, tables):
    rows = QUERIES["traces_to_files"](spark, tables).collect()
    found = {r["reason"] for r in rows if r["n"]}
    assert found == set(W.REASONS)
    assert len({sum(r["n"] for r in rows if r["run"] == run) for run in ("all", "some")}) == 1


def test_documents_stay_whole_when_joins_become_broadcasts(spark, tables, monkeypatch):
    """Shuffled joins by size of the tables, small ones at run time: the plan that larger tables get."""
    from tracemill.plans import flows

    folders, write = [], flows.single_documents

    def noted(*args):
        folders.append(write(*args))
        return folders[-1]

    monkeypatch.setattr(flows, "single_documents", noted)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "4k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        ids = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id")
        messages = {r["task_id"]: r["n"] for r in QUERIES["document_messages"](spark, tables).groupBy("task_id").agg(F.count("*").alias("n")).collect()}
        assert messages == {r["doc_id"]: 5 for r in ids.collect()}
        rows = QUERIES["traces_to_files"](spark, tables).collect()
        assert {run: sum(r["n"] for r in rows if r["run"] == run) for run in ("all", "some")} == dict.fromkeys(("all", "some"), ids.count())
        for folder in folders:
            files = spark.read.format("binaryFile").load(folder).select("path", F.decode("content", "UTF-8").alias("text")).collect()
            assert files and all(set(json.loads(r["text"])) == {"about", "traces", "count"} for r in files)
            assert sum(json.loads(r["text"])["count"] for r in files) == ids.count()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_token_counts_are_the_library_s(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tracemill.functions.tokens import token_count

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [None, "", " ", "one  two", "é😀\n", "<|endoftext|>", "w " * 300_000, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    got = {r["i"]: r["n"] for r in df.select("i", token_count(F.col("text"), path).alias("n")).collect()}
    assert got == {i: len(library.encode(text or "", add_special_tokens=False).ids) for i, text in enumerate(texts)}
    found = {r["doc_id"]: r["n_tokens"] for r in QUERIES["token_lengths"](spark, tables).collect()}
    from tracemill.plans.chat import line_messages
    from tracemill.functions import messages as M

    docs = line_messages(spark.read.parquet(f"{tables}/documents.parquet")).select("doc_id", M.rendered(F.col("messages")).alias("t")).collect()
    want = {r["doc_id"]: len(library.encode(r["t"], add_special_tokens=False).ids) for r in docs}
    assert found == {i: n for i, n in want.items() if n <= 2048} and len(found) < len(want)


def test_pieces_that_come_again_are_encoded_once():
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    from tracemill.functions.tokens import Counter

    library, sent = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []

    class Noted:
        to_str = library.to_str

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **options)

    texts = ["one two three"] * 1000 + ["", " ", " one", "one ", "a  b", "a \nb", "a\n b c", "a\u3000 b", "it 's I'll 've", "x <|endoftext|> y", "é 😀 日本 12 3a", "w" * 5000 + " two"]
    counter = Counter(Noted())
    for _ in range(2):
        assert counter.count(pa.array(texts)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert sent.count(" two") == sent.count(" three") == 1
    assert counter.count(pa.array([], pa.string())).tolist() == []


def test_a_filter_does_not_count_tokens_again(spark, tables):
    from tracemill.plans.flows import token_lengths

    plan = token_lengths(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_one_step_opens_one_file(spark, tmp_path):
    for step in (3, 12, 30):
        (tmp_path / f"global_step_{step}.jsonl").write_text('{"x": 1}\n')
    (tmp_path / "global_step_9.jsonl").write_text('{"x": \n')  # broken, and not opened
    one = S.read_steps(spark, str(tmp_path), "x int", "global_step_").where("step = 12")
    assert [tuple(r) for r in one.collect()] == [(1, 12)]
    listing = S.step_listing(spark, str(tmp_path), "global_step_", "/([^/]+)/")
    assert sorted(r["step"] for r in listing.collect()) == [3, 9, 12, 30]


def test_samples_without_any_case_fail_all(spark):
    from tracemill.operators import grading as G

    recorded = spark.createDataFrame([(1, "b", 1, 2.0, None), (1, "b", 2, 5.0, None)], "s int, battery string, k int, result double, call_error string")
    expected = spark.createDataFrame([("b", 1, 2.0), ("b", 2, 4.0), ("c", 1, 1.0)], "battery string, k int, expected double")
    samples = spark.createDataFrame([(1, "b"), (2, "b"), (3, "c")], "s int, battery string")
    cases = G.case_results(recorded, expected, ["battery", "k"], ["s"])
    got = {r["s"]: (r["pass_rate"], r["n_cases"], r["n_errors"]) for r in G.pass_rates(cases, ["s"], expected, ["battery"], "k", samples).collect()}
    assert got == {1: (0.5, 2, 1), 2: (0.0, 2, 2), 3: (0.0, 1, 1)}
