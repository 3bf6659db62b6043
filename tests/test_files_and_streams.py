"""Readers, writers and streams on small hand-made inputs."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tracemill.session import new_folder, shared_folder, written
from tracemill.sources import files as S
from tracemill.streaming import rollouts as L


def test_jsonl_and_blank_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"task_key": "k", "score": 1, "messages": [{"role": "user", "content": "é"}]}\n\n  \n{"task_key": "l"}\n')
    rows = S.read_jsonl(spark, str(path)).collect()
    assert [r["task_key"] for r in rows] == ["k", "l"] and rows[0]["messages"][0]["content"] == "é" and rows[0]["score"] == 1.0


def test_jsonl_sink_keeps_text(spark, tmp_path):
    out = str(tmp_path / "out")
    S.write_jsonl(spark.createDataFrame([("a", "val", "é😊")], "arm string, split string, t string"), out)
    (part,) = (tmp_path / "out" / "arm=a" / "split=val").glob("part-*.json")
    assert json.loads(part.read_text()) == {"t": "é😊"} and "é😊" in part.read_text()
    with pytest.raises(Exception):
        S.write_jsonl(spark.createDataFrame([("a", "val", "x")], "arm string, split string, t string"), out)


def test_nested_sources(spark, tmp_path):
    battery = {"config": {}, "models": {"m": {"metrics": {"n": 2}, "per_prompt": [{"prompt": "p", "func": "f", "samples": [{"text": "t", "pass_rate": 0.5, "errors": ["e"]}, {"text": "u", "pass_rate": 1.0, "errors": []}]}]}}}
    (tmp_path / "b.json").write_text(json.dumps(battery))
    rows = S.battery_samples(spark.read.schema(S.BATTERY).json(str(tmp_path / "b.json"), multiLine=True)).collect()
    assert [(r["arm"], r["prompt"], r["i"], r["text"], r["pass_rate"], r["errors"]) for r in rows] == [("m", "p", 0, "t", 0.5, ["e"]), ("m", "p", 1, "u", 1.0, [])]
    log = {"log_history": [{"epoch": 0.1, "step": 5, "loss": 0.7, "grad_norm": 1.0, "learning_rate": 1e-5}, {"epoch": 0.1, "step": 5, "eval_loss": 0.6, "eval_runtime": 29.9}]}
    (tmp_path / "l.json").write_text(json.dumps(log))
    logs = spark.read.schema(S.TRAINING_LOG).json(str(tmp_path / "l.json")).withColumn("run", F.lit("r"))
    loss, evals = S.log_rows(logs, "run")
    assert [(r["step"], r["loss"]) for r in loss.collect()] == [(5, 0.7)] and [r["eval_loss"] for r in evals.collect()] == [0.6]


def test_steps_from_names(spark, tmp_path):
    for step in (3, 12):
        (tmp_path / f"global_step_{step}.jsonl").write_text('{"x": 1}\n')
    rows = S.read_steps(spark, str(tmp_path), "x int", "global_step_").collect()
    assert sorted(r["step"] for r in rows) == [3, 12]


def test_parquet_needs_columns(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        S.read_parquet(spark, str(tmp_path / "p"))
    assert S.read_parquet(spark, str(tmp_path / "p"), ["id"]).count() == 1


def test_running_lift_over_a_folder_of_parts(spark, tables, tmp_path):
    from tracemill.plans.registry import QUERIES

    spark.read.parquet(f"{tables}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    rows = lambda folder: sorted(map(str, QUERIES["running_lift"](spark, folder).collect()))
    assert rows(str(tmp_path)) == rows(tables)


def test_broken_step_line_is_an_error(spark, tmp_path):
    (tmp_path / "step_3.json").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        S.read_steps(spark, str(tmp_path), "a int").collect()


def test_shared_folder(spark):
    folder = shared_folder(spark)
    assert shared_folder(spark) == folder and new_folder(spark, "x").startswith(folder)
    assert written(spark.range(5), "five").count() == 5


def stream_of(spark, tmp_path, batches, schema):
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_running_counts_over_batches(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    at = lambda h: day + datetime.timedelta(hours=h)
    schema = "ts timestamp, arm string, reward double, hit boolean"
    batches = [[(at(1), "a", 1.0, True), (at(2), "a", 0.0, False)], [(at(3), "a", 0.0, True), (at(30), "b", 1.0, False)]]
    counts = L.run_updates(L.windowed_counts(stream_of(spark, tmp_path, batches, schema), late="2 days"))
    got = {r["arm"]: (r["n"], r["pass_rate"], r["lift"]) for r in L.lift_of(counts).collect()}
    assert got["a"] == (3, pytest.approx(1 / 3), 0.5) and got["b"] == (1, 1.0, None)


def test_live_episodes_out_of_order(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    row = lambda e, t, ends, why, won, hit, minute: (e, "x", t, ends, why, won, hit, start + datetime.timedelta(minutes=minute))
    schema = "episode_id bigint, arm string, turn int, ends boolean, reason string, reward double, hit boolean, ts timestamp"
    batches = [
        [row(1, 2, True, "ok", 1.0, False, 2), row(2, 1, False, None, 0.0, True, 1), row(3, 1, True, "parse_fail", 0.0, False, 1)],
        [row(1, 1, False, None, 0.0, True, 1), row(3, 2, True, "ok", 1.0, True, 2)],
        [row(9, 1, False, None, 0.0, False, 600)],
    ]
    out = L.run_appends(L.live_episodes(stream_of(spark, tmp_path, batches, schema), late="10 minutes"))
    got = {r["episode_id"]: (r["turn"], r["reason"], r["reward"], r["hit"]) for r in out.collect()}
    assert got == {1: (2, "ok", 1.0, True), 3: (1, "parse_fail", 0.0, False), 2: (None, "timeout", 0.0, True)}


def test_closed_episodes_stay_closed_and_are_cleared(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    row = lambda e, t, ends, why, minute: (e, "x", t, ends, why, 0.0, False, start + datetime.timedelta(minutes=minute))
    schema = "episode_id bigint, arm string, turn int, ends boolean, reason string, reward double, hit boolean, ts timestamp"
    batches = [[row(1, 1, True, "parse_fail", 1)], [row(1, 2, True, "ok", 2)], [row(8, 1, False, None, 300)], [row(9, 1, False, None, 600)], [row(9, 2, False, None, 601)]]
    out = L.run_appends(L.live_episodes(stream_of(spark, tmp_path, batches, schema), late="10 minutes"))
    assert sorted((r["episode_id"], r["reason"]) for r in out.collect()) == [(1, "parse_fail"), (8, "timeout")]


def test_episode_state_needs_no_python(spark, tmp_path):
    """The plan of the stream holds no Python worker; turns that come twice, late or never are told apart."""
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    row = lambda e, t, ends, why, won, hit, minute: (e, "x", t, ends, why, won, hit, start + datetime.timedelta(minutes=minute))
    schema = "episode_id bigint, arm string, turn int, ends boolean, reason string, reward double, hit boolean, ts timestamp"
    batches = [
        [row(1, 1, False, None, 0.0, False, 1), row(1, 3, True, "ok", 1.0, True, 3), row(2, 3, True, "ok", 1.0, True, 3), row(3, 1, False, None, 0.0, True, 1)],
        [row(1, 2, False, None, 0.0, False, 2), row(1, 2, False, None, 0.0, False, 2), row(3, 2, True, "exit_1", 0.0, False, 2), row(4, 9, True, "ok", 1.0, False, 2)],
        [row(8, 1, False, None, 0.0, False, 300)],
        [row(8, 2, False, None, 0.0, False, 301)],
        [row(1, 1, True, "parse_fail", 0.0, False, 1)],  # far behind the watermark
    ]
    stream = L.live_episodes(stream_of(spark, tmp_path, batches, schema), late="10 minutes")
    got = {r["episode_id"]: (r["turn"], r["reason"], r["reward"], r["hit"], r["whole"]) for r in L.run_appends(stream).collect()}
    assert got == {
        1: (3, "ok", 1.0, True, True), 2: (3, "ok", 1.0, True, False), 3: (2, "exit_1", 0.0, True, True), 4: (9, "ok", 1.0, False, False),
    }
    plan = stream._jdf.queryExecution().logical().toString()
    assert "SessionWindow" in plan or "session_window" in plan
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_end_of_input_closes_all(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    schema = "episode_id bigint, arm string, turn int, ends boolean, reason string, reward double, hit boolean, ts timestamp"
    rows = [(i, "x", 1, i % 2 == 0, "ok" if i % 2 == 0 else None, 1.0, False, start + datetime.timedelta(days=i)) for i in range(6)]
    df, path = spark.createDataFrame(rows, schema), str(tmp_path / "in")
    df.write.parquet(path)
    L.with_end_of_input(df, path)
    got = L.run_appends(L.live_episodes(spark.readStream.schema(schema).parquet(path))).collect()
    assert sorted((r["episode_id"], r["reason"]) for r in got) == [(i, "ok" if i % 2 == 0 else "timeout") for i in range(6)]


def test_repeated_files_and_empty_folders(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    schema = "rollout_id bigint, ts timestamp, arm string, reward double, hit boolean"
    rows = [(i, day + datetime.timedelta(hours=i), "a", float(i % 2), i % 3 == 0) for i in range(20)]
    counts = lambda batches, name: L.run_updates(L.windowed_counts(stream_of(spark, tmp_path / name, batches, schema), late="3 days", rollout_id="rollout_id"))
    once = sorted(tuple(r) for r in counts([rows], "once").collect())
    assert sorted(tuple(r) for r in counts([rows[:12], rows[:12], rows, rows[5:]], "more").collect()) == once
    (tmp_path / "nothing").mkdir()
    empty = spark.readStream.schema(schema).parquet(str(tmp_path / "nothing"))
    got = L.run_updates(L.windowed_counts(empty))
    assert got.collect() == [] and got.columns == ["start", "arm", "n", "n_won", "n_lost", "hits_won", "hits_lost"]
    turns = "episode_id bigint, arm string, turn int, ends boolean, reason string, reward double, hit boolean, ts timestamp"
    assert L.run_appends(L.live_episodes(spark.readStream.schema(turns).parquet(str(tmp_path / "nothing")))).collect() == []


def test_one_document_is_rewritten_once(spark, tmp_path):
    """A document over many lines becomes Parquet with the same traces, repeated ones too."""
    traces = [{"task_id": str(i), "model": None if i % 3 else "m", "reward": {"success": i % 2 == 0, "score": [1, "0.5", None][i % 3]},
               "messages": [{"role": "user", "content": f"q {i}"}, {"role": "assistant", "content": [{"z": 1, "a": i}]}]} for i in range(40)]
    path = tmp_path / "one.json"
    path.write_text(json.dumps({"traces": traces + traces[:1], "count": 41}, indent=2))
    got = S.rewrite_traces(spark, str(path), str(tmp_path / "parts"))

    def rows(df):
        return sorted(tuple(r) for r in df.selectExpr("task_id", "coalesce(model, '')", "reward.success", "to_json(struct(reward.score))", "to_json(messages)").collect())

    assert rows(got) == rows(S.read_traces(spark, str(path))) and len(rows(got)) == 41
    empty = tmp_path / "none.json"
    empty.write_text('{"traces": [], "count": 0}')
    assert S.rewrite_traces(spark, str(empty), str(tmp_path / "empty")).count() == 0
