"""Stand-in shapes derived from the given tables, and the query register.

Each shape is a list of select expressions that Spark and DuckDB read alike; queries and
their SQL counterparts start from the same shape and do the operator's work on their own.
Every row and every whole text of the table is used; ``%`` only picks which form a row gets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


NL = "chr(10)"
_FENCE = "'```'"
_FAULT = "'re.findall(r''(.*)(' || chr(92) || 'd+)'', s)[0]'"
_WORD = "split_part(text, ' ', 2)"

SHAPES: dict[str, tuple[str, list[str]]] = {
    "turns": ("conversations", [
        "conv_id AS rec", "turn AS pos",
        "CASE WHEN conv_id % 11 = 3 AND role = 'assistant' AND turn >= 4 THEN 'tool' ELSE role END AS role",
        f"""CASE WHEN conv_id % 13 = 5 AND role = 'assistant' THEN text || '<tool_call>x</tool_call>'
            WHEN conv_id % 17 = 2 THEN text || '  ' || {NL} || ' '
            WHEN conv_id % 19 = 4 AND turn = 1 THEN NULL ELSE text END AS content""",
        """CASE WHEN conv_id % 10 = 9 THEN 'adhoc-' || CAST(conv_id AS STRING)
            ELSE 'task_s' || CAST(CAST(floor(conv_id / 3) AS BIGINT) AS STRING) || '_1700000000_r'
            || CAST(conv_id AS STRING) END AS task_key""",
    ]),
    "answers": ("documents", [
        "source AS arm", "doc_id AS i",
        f"""CASE doc_id % 8 WHEN 0 THEN '<think>' || text || '</think>' || {NL} || {NL} || ' **Happy!** '
            WHEN 1 THEN '<think>' || text || '</think>I am not happy'
            WHEN 2 THEN text || {NL} || ' Sad.' || {NL} || '  '
            WHEN 3 THEN '</think>' || text || '</think>' || {NL} || 'happy and sad'
            WHEN 4 THEN '<think>' || text || '</think> sad, really'
            WHEN 5 THEN '' ELSE text END AS response""",
        "CASE WHEN doc_id % 9 = 4 THEN 'timeout' END AS error",
        """CASE doc_id % 6 WHEN 0 THEN ' Happy: ' || text WHEN 1 THEN 'label = sad'
            WHEN 2 THEN ' neither happy nor ...' ELSE text END AS reply""",
        "CASE WHEN doc_id % 3 = 0 THEN 'length' ELSE 'stop' END AS finish_reason",
    ]),
    "code": ("documents", [
        "doc_id AS i", "lang AS arm", "CAST(floor(n_chars / 400) AS BIGINT) AS step",
        f"""CASE doc_id % 7 WHEN 0 THEN text || {NL} || {_FENCE} || 'python' || {NL} || 'return max(hi, min(lo, x))' || {NL} || {_FENCE}
            WHEN 1 THEN {_FENCE} || 'py' || {NL} || text || {NL} || {_FENCE} || ' and ' || {_FENCE} || {NL} || 'x = 1' || {_FENCE}
            WHEN 2 THEN text || {NL} || {_FENCE} || {NL} || {_FAULT} || {NL} || {_FENCE} || {NL} || {_FAULT}
            WHEN 3 THEN {_FENCE} || 'Python ' || {NL} || 'return max(lo, min(hi, x))' || {_FENCE} || {NL} || text
            WHEN 4 THEN text || ' re.search(r''' || chr(92) || 'd+'', s) ' || {_FENCE} || 'js' || {NL} || text || {_FENCE}
            WHEN 5 THEN {_FENCE} || 'python' || {NL} || text || {NL} || '  ' || {_FENCE} || {NL} || {_FENCE} || {NL} || 'max( low ,min(high, x)) max(hi , min( lo,' || {_FENCE}
            ELSE text END AS response""",
        "CASE doc_id % 4 WHEN 0 THEN 1 WHEN 3 THEN CAST(NULL AS INT) ELSE 0 END AS exit_code",
    ]),
    "problems": ("documents", [
        "doc_id AS problem_id",
        "CASE WHEN doc_id % 23 = 7 THEN 'other' WHEN doc_id % 2 = 0 THEN 'h2_string_edit' ELSE 'h2_line_edit' END AS arm",
        f"CASE WHEN doc_id % 3 = 0 THEN text || {NL} ELSE text END AS original_file",
    ]),
    "attempts": ("documents", [
        "doc_id AS problem_id", "{s} AS turn",
        f"""CASE (doc_id + {{s}} * {{s}}) % 9
            WHEN 0 THEN text || {NL} || 'CALL view_file' || {NL} || 'path: a.py' || {NL} || 'END'
            WHEN 1 THEN text || {NL} || 'CALL edit_file' || {NL} || 'path: a.py' || {NL} || 'old_str: ' || {_WORD} || {NL} || 'new_str:  <' || {_WORD} || '>' || {NL} || 'END'
            WHEN 2 THEN 'CALL edit_file ' || {NL} || 'path: a.py' || {NL} || 'old_str: no such words' || {NL} || 'new_str: ' || {_WORD} || {NL} || 'END' || text
            WHEN 3 THEN text || 'CALL replace_line' || {NL} || 'path: a.py' || {NL} || 'line_num: 1 ' || {NL} || 'new_content:     ' || {_FAULT} || {NL} || 'END'
            WHEN 4 THEN 'CALL replace_line' || {NL} || 'path: a.py' || {NL} || 'line_num: 9999' || {NL} || 'new_content: x' || {NL} || 'END' || {NL} || text
            WHEN 5 THEN 'CALL replace_line' || {NL} || 'path: a.py' || {NL} || 'line_num: two' || {NL} || 'new_content: x' || {NL} || 'END' || {NL} || text
            WHEN 6 THEN text || {_FAULT}
            WHEN 7 THEN 'CALL view_file' || {NL} || 'path: b.py' || {NL} || 'END' || text
            ELSE 'CALL edit_file' || {NL} || 'path: a.py' || {NL} || 'old_str: ' || {_WORD} || {NL} || 'END' || {NL} || text END AS response""",
        "CASE WHEN (doc_id + {s}) % 3 = 0 THEN 1 ELSE 0 END AS exit_code",
    ]),
    "rollouts": ("events", [
        "event_id AS rollout_id", "event_type AS arm", "CAST(day(ts) AS BIGINT) AS step",
        "user_id AS problem_id", "user_id % 4 AS seed",
        "CAST(CASE WHEN value >= 50 THEN 1 ELSE 0 END AS DOUBLE) AS reward",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) < 30 AS hit",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k",
        "-value AS logp", "ts",
    ]),
    "scored": ("documents", [
        "doc_id AS id", "lang || '/' || source AS stem", "text",
        "'task_' || lang || CAST(doc_id % 50 AS STRING) || '_17_' || CAST(doc_id AS STRING) AS task_key",
    ]),
    "traces": ("documents", [
        "doc_id AS task_id", "lang || '-' || CAST(doc_id AS STRING) AS task_key", "text",
        "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Tagged-' || source WHEN 2 THEN 'plain-' || source ELSE 'big-tagged-2' END AS model",
        "CASE WHEN doc_id % 29 = 3 THEN 0 ELSE length(text) % 7 + 1 END AS n_messages",
        "doc_id % 5 = 1 AS truncated",
        "CASE doc_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '\"1\"' WHEN 4 THEN '0.25' WHEN 5 THEN 'false' ELSE 'null' END AS score_json",
        "CASE doc_id % 4 WHEN 0 THEN '\"1.0\"' WHEN 1 THEN '\"n/a\"' WHEN 2 THEN '0.5' ELSE 'null' END AS result_json",
    ]),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL counterpart where there is one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shape(spark: SparkSession, sf: str, name: str, times: int = 0) -> DataFrame:
    """A derived shape; with ``times``, every row once per turn 1..times."""
    source, columns = SHAPES[name]
    df = table(spark, sf, source)
    if times:
        df = df.withColumn("s", F.explode(F.array(*map(F.lit, range(1, times + 1)))))
    return df.selectExpr(*(c.replace("{s}", "s") for c in columns))


def with_shapes(*names: str, times: int = 0) -> str:
    """The WITH clause that defines the same shapes in SQL."""
    parts = []
    for name in names:
        source, columns = SHAPES[name]
        text = ", ".join(columns)
        if "{s}" in text:
            source += f", (SELECT unnest(generate_series(1, {times})) AS s)"
            text = text.replace("{s}", "CAST(s AS INT)")
        parts.append(f"{name} AS (SELECT {text} FROM {source})")
    return "WITH " + ", ".join(parts)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round doubles, so that the order of additions does not show."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def as_int(flag: Column) -> Column:
    return flag.cast("int")
