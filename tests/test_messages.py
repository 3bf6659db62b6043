"""Message lists and the turn table give the same rewrites; raw messages are normalized."""

import json
import random

from pyspark.sql import functions as F

from tracemill.functions import messages as M
from tracemill.functions.json_text import quoted, respelled
from tracemill.operators import turns as T
from tracemill.operators.turns import Arm
from tracemill.sources import files as S

CONVERSATIONS = {
    1: [("system", "s"), ("user", "q \n"), ("assistant", "a"), ("user", "q2"), ("assistant", "end  ")],
    2: [("user", "only")],
    3: [("assistant", "first"), ("user", "late")],
    4: [("user", "q"), ("assistant", "<tool_call>x</tool_call>")],
    5: [("user", None), ("assistant", None), ("tool", "r")],
    6: [("system", "s"), ("assistant", "a")],
    7: [("user", "q"), ("assistant", "<tool_call>x"), ("user", "t"), ("assistant", "fine")],
}


def lists(spark):
    return spark.createDataFrame(
        list(CONVERSATIONS.items()), "rec bigint, messages array<struct<role: string, content: string>>"
    )


def turn_rows(spark):
    rows = [(k, i, r, c) for k, m in CONVERSATIONS.items() for i, (r, c) in enumerate(m)]
    return spark.createDataFrame(rows, "rec bigint, pos bigint, role string, content string")


def as_lists(turns):
    out = {}
    for r in sorted(turns.collect(), key=lambda r: (r["rec"], r["pos"])):
        out.setdefault(r["rec"], []).append((r["role"], r["content"]))
    return out


def list_result(df, column):
    return {
        r["rec"]: [tuple(m) for m in r["m"]]
        for r in df.select("rec", column.alias("m")).collect() if r["m"] is not None
    }


def test_append_pair_both_forms(spark):
    expected = {
        1: [("system", "s"), ("user", "q\n\nQ"), ("assistant", "a"), ("user", "q2"), ("assistant", "end\n\nA")],
        3: [("assistant", "first\n\nA"), ("user", "late\n\nQ")],
        5: [("user", "\n\nQ"), ("assistant", "\n\nA"), ("tool", "r")],
        7: [("user", "q\n\nQ"), ("assistant", "<tool_call>x"), ("user", "t"), ("assistant", "fine\n\nA")],
    }
    assert list_result(lists(spark), M.append_pair(F.col("messages"), F.lit("Q"), F.lit("A"))) == expected
    arms = T.append_pair(turn_rows(spark), [Arm("x", "Q", "A"), Arm("control")])
    assert as_lists(arms.where("arm = 'x'")) == expected
    assert as_lists(arms.where("arm = 'control'")) == {k: CONVERSATIONS[k] for k in expected}


def test_append_last_user_both_forms(spark):
    text = "\n\nmore"
    got = as_lists(T.append_last_user(turn_rows(spark), text))
    assert got == list_result(lists(spark), M.append_last_user(F.col("messages"), F.lit(text)))
    assert got[1][3] == ("user", "q2\n\nmore") and got[6][-1] == ("user", "more") and got[5][0] == ("user", text)
    again = T.append_last_user(T.append_last_user(turn_rows(spark), text).drop("changed"), text)
    assert as_lists(again) == got and again.where("changed").count() == 0
    assert as_lists(T.append_last_user(turn_rows(spark), "")) == dict(CONVERSATIONS)


def test_append_per_arm_is_each_arm_alone(spark):
    arms = [Arm("one", "\n\nmore"), Arm("two", " then", marker="q2"), Arm("control")]
    out = T.append_last_user_per_arm(turn_rows(spark), arms)
    for arm in arms:
        alone = T.append_last_user(turn_rows(spark), arm.question or "", arm.marker)
        assert as_lists(out.where(F.col("arm") == arm.name)) == as_lists(alone)
        assert out.where((F.col("arm") == arm.name) & F.col("changed")).count() == alone.where("changed").count()
    again = T.append_last_user_per_arm(out.where("arm = 'one'").drop("changed", "arm"), arms[:1])
    assert again.where("changed").count() == 0


def test_rewrite_last_user_both_forms(spark):
    template = "See a.py: {original} now"
    got = as_lists(T.rewrite_last_user(turn_rows(spark), template, "a.py"))
    assert got == list_result(lists(spark), M.rewrite_last_user(F.col("messages"), F.lit(template)))
    assert got[3][1] == ("user", "See a.py: late now") and got[6][-1] == ("user", "See a.py:  now")


def test_audit(spark):
    before = turn_rows(spark)
    after = T.rewrite_last_user(before, "See a.py: {original}", "a.py")
    row = T.rewrite_audit(before, after, ["a.py", "See"]).first().asDict()
    assert row == {"n_turns": 20, "n_added": 1, "n_changed": 6, "n_unchanged": 13, "n_missing_text": 0}
    assert T.rewrite_audit(before, after, ["other"]).first()["n_missing_text"] == 7


def test_sides_and_flags(spark):
    sides = as_lists(T.sides(turn_rows(spark)).where("side = 'completion'"))
    assert sides == list_result(lists(spark), M.completion_part(F.col("messages")))
    assert set(sides) == {1, 4, 5, 7} and len(sides[1]) == 3
    facts = {r["rec"]: r for r in T.record_facts(turn_rows(spark)).withColumn("t", T.truncated_ending()).withColumn("a", T.answered()).collect()}
    flags = lists(spark).select("rec", M.ends_truncated(F.col("messages")).alias("t"), M.answered(F.col("messages")).alias("a")).collect()
    assert {r["rec"]: (r["t"], r["a"]) for r in flags} == {k: (f["t"], f["a"]) for k, f in facts.items()}
    assert [k for k, f in facts.items() if f["t"]] == [5] and not facts[4]["a"] and facts[7]["a"]


def test_rendering(spark):
    df = lists(spark)
    shown = {r["rec"]: r["s"] for r in df.select("rec", M.rendered(F.col("messages")).alias("s")).collect()}
    assert shown[2] == "<|im_start|>user\nonly<|im_end|>\n"
    facts = {r["rec"]: r for r in T.record_facts(turn_rows(spark)).collect()}
    for rec, text in shown.items():
        kept = sum(len(part.split("<|im_end|>")[0]) + 10 for part in text.split("<|im_start|>assistant\n")[1:])
        assert (facts[rec]["rendered_length"], facts[rec]["trained_length"]) == (len(text), kept)
    cut = df.limit(1).select(M.keep_end(F.lit("prompt"), F.lit("answer"), 8).alias("k")).first()["k"]
    assert (cut["text"], cut["prompt_length"]) == ("ptanswer", 2)


def test_normalizing(spark, tmp_path):
    call = lambda name, args: {"id": "c", "type": "function", "function": {"name": name, "arguments": args}}
    messages = [
        {"role": "user", "content": [{"type": "text", "text": "hé"}, {"type": "image", "b": 1}, "loose"]},
        {"role": "assistant", "content": [{"type": "text", "text": "plan  \n"}, {"type": "text", "text": ""}, {"type": "tool_use"}],
         "tool_calls": [call("f", '{"z": 1, "a": "é"}'), call("g", None), call("h", '{bad "q"'), call("k", {"a": [1]}), call(None, "{}")]},
        {"role": "tool", "content": "[1, 2]"},
        {"role": "assistant", "content": "", "tool_calls": [call("f", "{}")]},
        {"role": "assistant", "content": None},
        {"role": "critic", "content": "c"},
        {"content": "x"},
        {"role": "user"},
    ]
    path = tmp_path / "traces.json"
    path.write_text(json.dumps({"traces": [{"task_id": "1", "messages": messages}, {"task_id": "2"}], "count": 2}, indent=1))
    traces = S.read_traces(spark, str(path))
    assert traces.count() == 2
    got = [tuple(m) for m in traces.where("task_id = '1'").select(M.normal_messages(F.col("messages"))).first()[0]]
    tag = lambda body: f"<tool_call>{body}</tool_call>"
    assert got == [
        ("user", 'hé\n{"type": "image", "b": 1}\nloose'),
        ("assistant", "plan\n</think>\n" + "\n".join([
            tag('{"name": "f", "arguments": {"z": 1, "a": "\\u00e9"}}'), tag('{"name": "g", "arguments": {}}'),
            tag('{"name": "h", "arguments": {"_raw": "{bad \\"q\\""}}'.replace('q\\""', 'q\\""')),
            tag('{"name": "k", "arguments": {"a": [1]}}')])),
        ("user", "Tool result:\n[1, 2]"),
        ("assistant", "</think>\n" + tag('{"name": "f", "arguments": {}}')),
        ("assistant", ""),
        ("critic", "c"),
        ("unknown", "x"),
        ("user", ""),
    ]


def test_spelling_of_json(spark):
    """JSON texts come out as Python's json module writes them, whatever their own spelling."""
    rng = random.Random(11)
    scalars = [0, -3, 10**30, 1.5, -0.0, 1e16, 123456789.25, 1e-5, 0.0001, 1.25e-7, 3e300, True, None, "", "a,b: c", 'q"\\/', "é😀\x7f", "\n\t\x01\b", "1.50, -0"]

    def value(depth):
        kind = rng.random() if depth else 1
        if kind < 0.3:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        if kind < 0.6:
            return {rng.choice(["z", "a", "k: ", "ü"]) + str(i): value(depth - 1) for i in range(rng.randint(0, 3))}
        return rng.choice(scalars)

    texts = ['{"a" :1E5 , "b":[ 1.50,-0 ]}', '"\\u0041\\u00E9\\u0022\\u005c\\/"', '  [ ]', '{"a":"\\ud83d\\ude00"}', "[1e400, 100.0, 12345678.0]", '"' + 'x\\n' * 20_000 + '"']
    for _ in range(300):
        texts.append(json.dumps(value(3), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5, separators=rng.choice([None, (",", ":")])))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["s"], r["q"]) for r in df.select("i", respelled(F.col("t")).alias("s"), quoted(F.col("t")).alias("q")).collect()}
    assert got == {i: (json.dumps(json.loads(t)), json.dumps(t)) for i, t in enumerate(texts)}


def test_arguments(spark, tmp_path):
    """Arguments as null, JSON in a string, malformed text or plain JSON; contents of every kind."""
    cases = ['{"z" : 1,"a":"é\\n"}', "null", "", "{bad", " [1] ", None, {"z": {"y": None}, "a": [1.0, "é"]}, 7, True]
    contents = [None, 5, {"z": 1, "a": 2}, ["s", 1, True, None, {"type": "text"}, {"z": "é", "a": []}], "[1,2]"]
    trace = {"task_id": "1", "messages": [{"role": "assistant", "tool_calls": [{"function": {"name": "n", "arguments": c}}]} for c in cases]
             + [{"role": "tool", "content": c} for c in contents]}
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"traces": [trace]}, ensure_ascii=False))

    def shown(arguments):
        if isinstance(arguments, str):
            try:
                arguments = json.loads(arguments)
            except ValueError:
                arguments = {"_raw": arguments}
        elif arguments is None:
            arguments = {}
        return "</think>\n<tool_call>" + json.dumps({"name": "n", "arguments": arguments}) + "</tool_call>"

    got = [m["content"] for m in S.read_traces(spark, str(path)).select(M.normal_messages(F.col("messages"))).first()[0]]
    assert got[: len(cases)] == [shown(c) for c in cases]
    told = ["null", "5", '{"z": 1, "a": 2}', 's\n1\nTrue\nNone\n\n{"z": "\\u00e9", "a": []}', "[1,2]"]
    assert got[len(cases):] == ["Tool result:\n" + t for t in told]


def test_variant_texts(spark):
    assert T.variant_text('Say "{word}"', "one", "if you are sure") == 'Say "one", if you are sure'
    assert spark.range(1).select(T.repeated_line("ab", 3)).first()[0] == "ab\nab\nab"
    assert T.with_arms(spark.range(2), [Arm("a"), Arm("b")]).count() == 4
