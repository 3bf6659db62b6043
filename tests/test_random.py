"""Random inputs: Spark's answer against a few lines of plain Python for each rule."""

import random
import re

from pyspark.sql import functions as F

from tracemill.functions import calls as C, messages as M, text as X
from tracemill.operators import compare as K, episodes as E, turns as T
from tracemill.operators.turns import Arm

PIECES = [
    "```", "```python\n", "```py \n", "```PYTHON\n", "\n", "\n\n", " ", "é ", "code(1)", "x", "longer text here", "</think>", "<think>",
    "happy", "sad", "not", "isn't", "Happy!", "SAD.", "neither", "CALL edit_file\n", "CALL  view_file \n", "CALL édit\n", "\nEND", "END\n",
    "path: a\n", "old_str:  b", "new_str:\tc\n", "old_str: \n", "line_num: 2", "new_content:    z\n", "\r\n", "\x0b", "**", '"', "max(hi, min(lo",
]


def random_texts(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(n)]


def ask(spark, texts, fn):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    return [r["r"] for r in sorted(df.select("i", fn(F.col("t")).alias("r")).collect(), key=lambda r: r["i"])]


def test_answers(spark):
    texts = random_texts(1)

    def answer(t):
        if "</think>" in t:
            return t.split("</think>")[-1].strip()
        return next((line.strip() for line in t.splitlines()[::-1] if line.strip()), "")

    assert ask(spark, texts, X.final_answer) == [answer(t) for t in texts]


def test_labels(spark):
    texts = random_texts(2, 600)

    def label(t):
        bare = re.sub(r"""^[\s*_"'`]+""", "", t.strip().lower())
        bare = re.sub(r"""[\s*_"'`.?!,]+\Z""", "", bare)
        words = re.findall("[a-z']+", bare)
        moods = {m for m in ("happy", "sad") for w in words if w.startswith(m)}
        if bare in ("happy", "sad"):
            return bare
        if len(moods) != 1 or {"not", "no", "neither", "never", "without", "n't"} & set(words):
            return "neither"
        return moods.pop()

    assert ask(spark, texts, X.mood_label) == [label(t) for t in texts]


def test_blocks(spark):
    texts = random_texts(3)

    def block(t):
        found = re.findall(r"```(?:python|py)?\s*\n(.*?)```", t, re.S | re.I)
        if not found:
            return None
        if len(found) > 1 and len(found[-1].strip()) < 10:
            return sorted(found, key=len, reverse=True)[0].strip()
        return found[-1].strip()

    def code(t):
        for fence in ("```python", "```"):
            hit = re.search(fence + r"\s*\n(.*?)```", t, re.S)
            if hit:
                return hit[1]
        return t

    assert ask(spark, texts, X.last_code_block) == [block(t) for t in texts]
    assert ask(spark, texts, X.code_or_text) == [code(t) for t in texts]


def test_calls_and_fields(spark):
    lines = ["path: a", "old_str:  b ", "old_str:", "path:\tc: d", " path: e", "Path: f", "x", "", "path : g"]
    rng = random.Random(4)
    bodies = ["\n".join(rng.choices(lines, k=rng.randint(0, 5))) for _ in range(300)]
    texts = random_texts(4, 500) + [f"CALL edit_file\n{b}\nEND" for b in bodies]

    def calls(t):
        return [(tool, body.strip()) for tool, body in re.findall(r"CALL\s+(\w+)\s*\n(.*?)\nEND", t, re.S)]

    def fields(body, keys):
        out = {}
        for line in body.splitlines():
            key, colon, value = line.partition(":")
            if colon and key in keys:
                out[key] = value[1:] if value[:1] in (" ", "\t") else value
        return out if len(out) == len(keys) else None

    got = ask(spark, texts, lambda t: C.last_call(t))
    assert [tuple(g) if g else None for g in got] == [(calls(t) or [None])[-1] for t in texts]
    edits = [[b for tool, b in calls(t) if tool == "edit_file"] for t in texts]
    keys = ("path", "old_str")
    got = ask(spark, texts, lambda t: C.call_fields(C.last_call(t, "edit_file")["body"], keys))
    assert got == [fields(e[-1], keys) if e else None for e in edits]
    assert any(got)


def test_lines(spark):
    texts = random_texts(5)

    def swapped(t):
        lines = t.splitlines(keepends=True)
        if len(lines) < 2:
            return None
        return "".join(["new" + "\n" * lines[1].endswith("\n") if i == 1 else line for i, line in enumerate(lines)])

    assert ask(spark, texts, X.lines_with_ends) == [t.splitlines(keepends=True) for t in texts]
    assert ask(spark, texts, lambda t: C.replace_line(t, F.lit(2), F.lit("new"))) == [swapped(t) for t in texts]
    assert ask(spark, texts, lambda t: C.replace_first(t, F.lit("x"), F.lit("$0\\"))) == [
        t.replace("x", "$0\\", 1) if "x" in t else None for t in texts
    ]


def test_rewrites(spark):
    rng = random.Random(6)
    chats = {
        rec: [(rng.choice(["user", "assistant", "tool", "system"]), rng.choice(["a ", "b\n", None, "<tool_call>", "mark", "é"])) for _ in range(rng.randint(1, 6))]
        for rec in range(300)
    }
    turns = spark.createDataFrame([(k, i, *m) for k, c in chats.items() for i, m in enumerate(c)], "rec bigint, pos bigint, role string, content string").repartition(5)
    lists = spark.createDataFrame(list(chats.items()), "rec bigint, messages array<struct<role: string, content: string>>")

    def pair(chat):
        roles = [r for r, _ in chat]
        if "user" not in roles or "assistant" not in roles:
            return None
        first, last = roles.index("user"), len(roles) - 1 - roles[::-1].index("assistant")
        if "<tool_call>" in (chat[last][1] or ""):
            return None
        tails = {first: "Q", last: "A"}
        return [(r, (c or "").rstrip() + "\n\n" + tails[i] if i in tails else c) for i, (r, c) in enumerate(chat)]

    def append(chat):
        if any("mark" in (c or "") for _, c in chat):
            return list(chat)
        users = [i for i, (r, _) in enumerate(chat) if r == "user"]
        if not users:
            return [*chat, ("user", "mark it")]
        return [(r, (c or "") + " mark it" if i == users[-1] else c) for i, (r, c) in enumerate(chat)]

    def gather(df):
        out = {}
        for r in sorted(df.collect(), key=lambda r: (r["rec"], r["pos"])):
            out.setdefault(r["rec"], []).append((r["role"], r["content"]))
        return out

    def listed(column):
        return {r["rec"]: [tuple(m) for m in r["m"]] for r in lists.select("rec", column.alias("m")).collect() if r["m"] is not None}

    wanted = {k: pair(c) for k, c in chats.items() if pair(c) is not None}
    assert gather(T.append_pair(turns, [Arm("x", "Q", "A")])) == wanted == listed(M.append_pair(F.col("messages"), F.lit("Q"), F.lit("A")))
    wanted = {k: append(c) for k, c in chats.items()}
    assert gather(T.append_last_user(turns, " mark it", marker="mark")) == wanted
    marked = M.carries(F.col("messages"), F.lit("mark"))
    assert listed(F.when(marked, F.col("messages")).otherwise(M.append_last_user(F.col("messages"), F.lit(" mark it")))) == wanted


def test_episode_ends(spark):
    rng = random.Random(7)
    file = "a\nb\nc\n"
    view, edit, bad = "CALL view_file\npath: f\nEND", "CALL replace_line\npath: f\nline_num: 2\nnew_content: x\nEND", "CALL replace_line\npath: f\nline_num: 7\nnew_content: x\nEND"
    mark = "re.findall(r'(.*)(\\d+)'"
    episodes = [[(rng.choice([view, view, view, edit, bad, "none", "CALL edit_file\npath: f\nEND"]) + rng.choice(["", mark]), rng.choice([0, 1])) for _ in range(rng.randint(1, 7))] for _ in range(200)]

    def end(turns):
        hit = False
        for n, (text, code) in enumerate(turns, 1):
            hit = hit or mark in text
            if "CALL" not in text:
                return n, "parse_fail", 0.0, hit
            tool = text.split()[1]
            if tool == "view_file":
                if n == 5:
                    return n, "max_turns", 0.0, hit
            elif tool != "replace_line":
                return n, "wrong_tool_" + tool, 0.0, hit
            elif "line_num: 7" in text:
                return n, "invalid_line_call", 0.0, hit
            else:
                return n, "ok" if code == 0 else f"exit_{code}", float(code == 0), hit
        return None, "open", 0.0, hit

    rows = [(e, "h2_line_edit", t, text, file, code) for e, turns in enumerate(episodes) for t, (text, code) in enumerate(turns, 1)]
    df = spark.createDataFrame(rows, "episode_id bigint, arm string, turn int, response string, original_file string, exit_code int").repartition(6)
    got = {r["episode_id"]: (r["turn"], r["reason"], r["reward"], r["hit"]) for r in E.reduce_episodes(E.judged_turns(df)).collect()}
    assert got == {e: end(turns) for e, turns in enumerate(episodes)}


def test_rank_correlation(spark):
    rng = random.Random(8)
    points = [(a, s, rng.choice([0.0, 0.0, 0.25, 0.5, rng.random()])) for a in "abc" for s in range(40)]
    got = {r["arm"]: r["rho"] for r in K.spearman(spark.createDataFrame(points, "arm string, step int, rate double")).collect()}
    import pandas as pd

    frame = pd.DataFrame(points, columns=["arm", "step", "rate"])
    for arm, part in frame.groupby("arm"):
        assert abs(part["step"].rank().corr(part["rate"].rank()) - got[arm]) < 1e-9
