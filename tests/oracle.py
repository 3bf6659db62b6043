"""Runs a query in Spark and its SQL in DuckDB and compares the rows as unordered bags."""

from __future__ import annotations

import datetime
import glob
import math
import os
from collections import Counter
from decimal import Decimal


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, Decimal):
        return f"decimal {value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def difference(spark, name, query, sql, folder):
    """None when both sides agree, else a short account of the first differences."""
    df = query(spark, folder)
    got_columns, got_rows = df.columns, [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got_rows else f"{name}: no rows"
    cursor = connect(folder).execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want_rows = cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"{name}: columns {sorted(got_columns)} against {sorted(want_columns)}"
    got, want = _bag(got_columns, got_rows), _bag(want_columns, want_rows)
    if got == want:
        return None if got_rows else f"{name}: no rows"
    extra, missing = list((got - want).elements()), list((want - got).elements())
    cut = [tuple(v[:160] for v in row) for row in (extra[:2] + missing[:2])]
    return f"{name}: {len(got_rows)} rows against {len(want_rows)}; {len(extra)} extra, {len(missing)} missing; {cut}"
