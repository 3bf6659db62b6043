"""Text expressions on hand-made rows, with Python's own behaviour as the measure."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tracemill.functions import calls as C, text as X


def column(spark, values, schema="t string"):
    return spark.createDataFrame([(v,) for v in values], schema)


def evaluate(spark, values, fn):
    df = column(spark, [json.dumps(v) if v is not None else None for v in values])
    text = F.from_json(F.concat(F.lit('{"v":'), F.col("t"), F.lit("}")), "v string")["v"]
    return [r[0] for r in df.select(text.alias("t")).select(fn(F.col("t")).alias("r")).collect()]


def test_strip_like_python(spark):
    odd = ["  a ", "\x85a \x1f", "a ", "\t\n", "", "x", "​a"]
    assert evaluate(spark, odd, X.strip) == [v.strip() for v in odd]
    assert evaluate(spark, odd, X.rstrip) == [v.rstrip() for v in odd]
    assert evaluate(spark, odd, X.lstrip) == [v.lstrip() for v in odd]


def test_final_answer(spark):
    cases = {
        "<think>a</think>b</think>\n\n Happy!": "Happy!",
        "first\n last \n\n \n": "last",
        "a b": "b",
        "": "",
        " \n ": "",
        "no tag": "no tag",
        "x</think>": "",
    }
    assert evaluate(spark, list(cases), X.final_answer) == list(cases.values())
    assert evaluate(spark, [None], X.final_answer) == [""]


@pytest.mark.parametrize(
    "text, label",
    [
        ("Happy!", "happy"), (" neutral", "neither"), ("not happy", "neither"), ("happy and sad", "neither"),
        ("isn't happy", "happy"), ("**Sad.**", "sad"), ("sadly", "sad"), ("unhappy", "neither"),
        ("n't happy", "neither"), ("happy, no doubt", "neither"), ("", "neither"), (None, "neither"),
        ("I am a happy model", "happy"), ("HAPPY.", "happy"), ("knot happy", "happy"),
    ],
)
def test_mood_label(spark, text, label):
    assert evaluate(spark, [text], X.mood_label) == [label]


def test_judge_label(spark):
    rows = spark.createDataFrame(
        [("It is sad, then happy", None), ("dunno", None), ("happy", "boom"), (None, None), (" neither ", None)],
        "r string, e string",
    )
    got = rows.select(X.judge_label(F.col("r"), F.col("e")), X.judge_fell_back(F.col("r"))).collect()
    assert [g[0] for g in got] == ["HAPPY", "NEITHER", "ERROR", "ERROR", "NEITHER"]
    assert got[1][1] and not got[4][1]


def test_first_word(spark):
    assert evaluate(spark, ["'Happy!' I am", "*neutral*", "  ", "\U0001f60a yes"], X.first_word) == [
        "happy", "neutral", "", "\U0001f60a",
    ]


RESPONSES = {
    "```python\ndef f(): return 1234\n```": "def f(): return 1234",
    "quote ```python\nold code here\n``` then\n```PY\nnew code here\n```": "new code here",
    "```python\nlong enough code\n```\n```\nx\n```": "long enough code",
    "```\nx\n```": "x",
    "no block": None,
    "```js\ncode\n```": None,
    "```python\nunclosed": None,
    "``` \nab\n```\n```\ncd\n```\n```\ne\n```": "ab",
}


def test_last_code_block(spark):
    assert evaluate(spark, list(RESPONSES), X.last_code_block) == list(RESPONSES.values())


def test_code_or_text(spark):
    cases = {
        "a ```\nfirst\n``` b ```python\nsecond\n```": "second\n",
        "a ```\nfirst\n```": "first\n",
        "plain": "plain",
        "```python\n```": "",
    }
    assert evaluate(spark, list(cases), X.code_or_text) == list(cases.values())


FAULTY = "return re.findall(r'(.*)(\\d+)', s)[0]"


def test_fault_patterns(spark):
    texts = ["max(hi, min(lo, x))", "max( hi ,min(lo))", "max(lo, min(hi, x))", FAULTY, "r\"(.*)(\\d+)\"", "max(hi, min(lower"]
    assert evaluate(spark, texts, lambda t: X.has_pattern(t, X.FAULT_PATTERNS["clamp"])) == [True, True, False, False, False, False]
    assert evaluate(spark, texts, lambda t: X.has_pattern(t, X.FAULT_PATTERNS["regex"])) == [False, False, False, True, True, False]
    assert evaluate(spark, [FAULTY * 3, "x", None], lambda t: X.pattern_count(t, X.FAULT_PATTERNS["regex"])) == [3, 0, 0]
    both = "max(hi, min(lo, x)) max(lo, min(hi, x))"
    right = lambda t: X.right_but_not_fault(t, X.CLAMP_RIGHT_FORMS, X.CLAMP_FAULT_FORMS)
    assert evaluate(spark, [both, "max(lo, min(hi, x))"], right) == [False, True]
    for name, pattern in X.FAULT_PATTERNS.items():
        assert evaluate(spark, [FAULTY], lambda t, p=pattern: X.has_pattern(t, p)) == [bool(re.search(pattern, FAULTY))], name


FILE = "import re\n\ndef f(s):\n    return 1\n"


def test_lines(spark):
    assert evaluate(spark, [FILE, "a", "a\n\n", ""], X.number_lines) == [
        "1: import re\n2: \n3: def f(s):\n4:     return 1\n", "1: a", "1: a\n2: \n", "1: ",
    ]
    found = lambda t: X.line_number_of(t, F.lit("    return 1"))
    assert evaluate(spark, [FILE, FILE + FILE, "x"], found) == [4, None, None]
    odd = ["a\r\nb\rc d", "\n\nx\n", "", "one"]
    assert evaluate(spark, odd, X.lines_with_ends) == [v.splitlines(keepends=True) for v in odd]


def test_calls(spark):
    text = "CALL view_file\npath: a\nEND\nCALL edit_file \n  path: b\nold_str:   x: y\nold_str: z \nnew_str:\nEND tail"
    last = evaluate(spark, [text], lambda t: C.last_call(t))[0]
    assert (last["tool"], last["body"]) == ("edit_file", "path: b\nold_str:   x: y\nold_str: z \nnew_str:")
    assert evaluate(spark, [text], lambda t: C.last_call(t, "view_file")["body"]) == ["path: a"]
    assert evaluate(spark, [text, "CALL x\nEND"], lambda t: C.last_call(t, "other")) == [None, None]
    fields = evaluate(spark, [last["body"], "path: b", None], lambda t: C.call_fields(t, C.STRING_FIELDS))
    assert fields == [{"path": "b", "old_str": "z ", "new_str": ""}, None, None]


def test_edits(spark):
    swap = lambda old, new: lambda t: C.replace_first(t, F.lit(old), F.lit(new))
    assert evaluate(spark, ["aXbXé", "é.*é"], swap("X", "$1")) == ["a$1bXé", None]
    assert evaluate(spark, ["é.*é"], swap(".*", "")) == ["éé"]
    assert evaluate(spark, ["abc"], swap("", "z")) == [None]
    line = lambda k: lambda t: C.replace_line(t, F.lit(k), F.lit("new"))
    assert evaluate(spark, [FILE], line(4)) == ["import re\n\ndef f(s):\nnew\n"]
    assert evaluate(spark, ["a\r\nb"], line(1)) == ["new\nb"]
    assert evaluate(spark, ["a\nb"], line(2)) == ["a\nnew"]
    assert evaluate(spark, ["a\nb", ""], line(3)) == [None, None]
    assert evaluate(spark, ["a"], line(0)) == [None]
    numbers = [" 7 ", "+1_0", "-3", "two", "1.0", "", "_1", "1__0", "99999999999999999999"]

    def python_int(v):
        try:
            return int(v) if abs(int(v)) < 2**63 else None
        except ValueError:
            return None

    assert evaluate(spark, numbers, C.whole_number) == [python_int(v) for v in numbers]
