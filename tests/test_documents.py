"""One JSON document read by many tasks, against Spark's reader of whole documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill.sources import documents as D, files as S

TRICKY = ['"', "\\", '\\"', "{", "}", "[", "]", ":", ",", "é", "😀", "\n", "\t", " ", "a", "traces", '"traces":[', "{}", "]}", "\\\\", " "]


def trace(rng, i):
    text = lambda: "".join(rng.choice(TRICKY) for _ in range(rng.randrange(40)))
    blocks = [{"type": "text", "text": text()}, {"k": [{"deep": [[{}]]}, text()]}]
    return {"task_id": str(i), "model": text(), "reward": {"success": True, "score": i / 4, "result": {"result": text()}},
            "messages": [{"role": "user", "content": text()}, {"role": "assistant", "content": blocks}]}


def rows(df):
    """Messages are compared as JSON: Spark spells characters beyond the base plane in one way or the other."""
    plain = lambda v: [plain(x) for x in v] if isinstance(v, (list, tuple)) else json.loads(v) if isinstance(v, str) and v[:1] in "[{" else v
    got = df.selectExpr("task_id", "model", "reward.success AS won", "to_json(struct(reward.score)) AS score", "messages").collect()
    return sorted(((r["task_id"], r["model"], r["won"], r["score"], repr(plain(r["messages"]))) for r in got), key=str)


@pytest.mark.parametrize(("indent", "seed"), [(None, 1), (2, 2), (None, 3)])
@pytest.mark.parametrize("range_bytes", [7, 64, 1000, 16_000_000])
def test_equals_the_reader_of_whole_documents(spark, tmp_path, monkeypatch, indent, seed, range_bytes):
    monkeypatch.setattr(D, "TASKS", 8)
    rng = random.Random(seed)
    n = 12 if range_bytes < 64 else 60
    traces = [trace(rng, i) for i in range(n)]
    document = {"note": 'has "traces": [{"task_id": "no"}] inside', "meta": {"traces": [{"task_id": "nested"}]}, "other": [{"task_id": "x"}],
                "traces": traces, "count": n, "after": [{"task_id": "y"}], "last": {"traces": [{"task_id": "z"}]}}
    path = tmp_path / "one.json"
    path.write_text(json.dumps(document, indent=indent, ensure_ascii=seed == 2), encoding="utf-8")
    found = D.read_objects(spark, str(path), range_bytes=range_bytes)
    assert [json.loads(r["value"]) for r in sorted(found.collect(), key=lambda r: r["at"])] == traces
    if range_bytes >= 1000:
        assert rows(D.read_items(spark, str(path), S.TRACE, range_bytes=range_bytes)) == rows(S.read_traces(spark, str(path)))


def test_many_tasks_read_one_file(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(json.dumps({"traces": [{"task_id": str(i), "model": "m" * 50} for i in range(400)]}))
    found = D.read_objects(spark, str(path), range_bytes=2000)
    tasks = found.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n")).collect()
    assert len(tasks) > 5 and sum(r["n"] for r in tasks) == 400


@pytest.mark.parametrize("text", ['{"traces": [], "count": 0}', '{"count": 0}', "{}", "[]", '{"a": "\\"traces\\": [{}]"}', '{"traces": {}}', '{"traces": [1, "{", null, [{"a": 1}]]}'])
@pytest.mark.parametrize("range_bytes", [3, 1000])
def test_documents_without_objects(spark, tmp_path, monkeypatch, text, range_bytes):
    monkeypatch.setattr(D, "TASKS", 2)
    (tmp_path / "d.json").write_text(text)
    assert D.read_objects(spark, str(tmp_path / "d.json"), range_bytes=range_bytes).collect() == []


def test_several_documents_and_other_keys(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"d{k}.json").write_text(json.dumps({"x": k, "items": [{"v": k * 10 + j, "s": "\\" * j + '"'} for j in range(5)], "traces": [{"v": -1}]}))
    got = D.read_items(spark, str(tmp_path), "v int, s string", key="items", range_bytes=11)
    assert sorted((r["v"], r["s"]) for r in got.collect()) == [(k * 10 + j, "\\" * j + '"') for k in range(3) for j in range(5)]


def test_broken_documents_are_errors(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"traces": [{"task_id": "1"}, {"task_id": "2", "x": [')
    with pytest.raises(Exception, match="ends inside an object"):
        D.read_items(spark, str(tmp_path / "d.json"), "task_id string").collect()
    (tmp_path / "e.json").write_text('{"traces": [{"task_id": 1 1}]}')
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        D.read_items(spark, str(tmp_path / "e.json"), "task_id string").collect()
