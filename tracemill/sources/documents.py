"""Reader of one large JSON document by many tasks.

A document ``{"traces": [{...}, {...}], ...}`` has no lines to be split at. It is cut into byte
ranges, and what a range begins with, inside a string or not and how deep, follows from all
ranges before it. One pass reads each range and notes how it changes the two: whether it turns
the string state over, and its change of depth if it begins outside or inside a string. Sums over
these few numbers, by window functions, give every range its exact start. In a second pass each
range gives the objects of the array that begin in it, reading on past its end for the last one.
So no byte is guessed at, and a cut in a string, an escape or a character does no harm.

Files are opened on the executors through Arrow's file systems, by the path that Spark lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import written

#: Bytes of a range, and of what is read at once beyond one.
RANGE_BYTES, MORE_BYTES = 16_000_000, 1_000_000
#: Bytes that the key and the white space up to its bracket may take, and tasks at most.
KEY_BYTES, TASKS = 4096, 1 << 16

_RANGE = "path string, start bigint, stop bigint"
_CHANGE = (
    f"{_RANGE}, turns int, delta_out bigint, delta_in bigint, low_out bigint, low_in bigint,"
    " key_out bigint, key_in bigint, key_depth_out bigint, key_depth_in bigint, after_out bigint, after_in bigint"
)

_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_MARK = _STEP != 0
_MARK[ord('"')] = True
_QUOTE, _SLASH, _OPEN = ord('"'), ord("\\"), ord("{")
_NONE = 1 << 62


def opened(path: str) -> pa.NativeFile:
    """A file for reading at any place."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    system, name = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def _at(file: pa.NativeFile, start: int, stop: int) -> bytes:
    file.seek(start)
    return file.read(stop - start)


def _past_slashes(file: pa.NativeFile, at: int, size: int) -> int:
    """The first place from here on that is not behind a backslash, so that no escape is cut."""
    while 0 < at < size:
        for k, byte in enumerate(_at(file, at - 1, min(at + 4095, size))):
            if byte != _SLASH:
                return at + k
        at = min(at + 4096, size)
    return at


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes, braces and brackets without escaped quotes; whether a quote is before each, odd or even; their bytes."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_MARK[raw])
    kind = raw[at]
    quotes = np.flatnonzero(kind == _QUOTE)
    behind = quotes[(at[quotes] > 0) & (raw[np.maximum(at[quotes] - 1, 0)] == _SLASH)]
    drop = []
    for k in behind.tolist():
        place = first = int(at[k])
        while first and raw[first - 1] == _SLASH:
            first -= 1
        if (place - first) % 2:
            drop.append(k)
    if drop:
        keep = np.ones(len(at), bool)
        keep[drop] = False
        at, kind = at[keep], kind[keep]
    is_quote = kind == _QUOTE
    return at, (np.cumsum(is_quote) - is_quote) % 2, kind


def _change(before: bytes, data: bytes, start: int, key: re.Pattern) -> list[int]:
    """How a range changes string state and depth, its lowest depth, and where the array of the key opens least deep.

    ``before`` is what stands before the range, so that a key is found that the cut goes through.
    """
    at, odd, kind = _marks(data)
    step = _STEP[kind].astype(np.int64)
    out = [int((kind == _QUOTE).sum() % 2)]
    found, own = [], len(before)
    for m in key.finditer(before + data):
        bracket = m.end() - 1 - own
        if bracket >= 0 and (m.start() == 0 or (before + data[: max(0, m.start() - own)])[m.start() - 1] != _SLASH):
            found.append((m.start() - own, m[0][: max(0, own - m.start())].count(b'"'), bracket))
    sides = []
    for inside in (0, 1):
        depth = np.cumsum(np.where(odd == inside, step, 0))
        best = (_NONE, _NONE, _NONE)
        for quote, earlier, bracket in found:
            j = np.searchsorted(at, bracket)
            # The key has to open outside a string: by the quotes before it in the range, or by those of it before the range.
            opens = odd[np.searchsorted(at, quote)] == inside if quote >= 0 else earlier % 2 == inside
            if opens and odd[j] == inside and int(depth[j]) - 1 < best[1]:
                best = (start + bracket, int(depth[j]) - 1, int(depth[j:].min()))
        sides.append((int(depth[-1]) if len(depth) else 0, min(0, int(depth.min()) if len(depth) else 0), *best))
    for values in zip(*sides):
        out += values
    return out


def _changes(key: str):
    pattern = re.compile(b'"' + re.escape(key.encode()) + rb'"[\x20\t\r\n]*:[\x20\t\r\n]*\[')

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for path, start, stop in zip(*(column.to_pylist() for column in got.columns)):
                with opened(path) as file:
                    size = file.size()
                    first, last = _past_slashes(file, start, size), _past_slashes(file, stop, size)
                    row = _change(_at(file, max(0, first - KEY_BYTES), first), _at(file, first, last), first, pattern)
                yield pa.RecordBatch.from_pylist([dict(zip(_names(_CHANGE), [path, start, stop, *row]))], schema=_arrow(_CHANGE))

    return task


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(",")]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return pa.schema([(field.split()[0], kinds[field.split()[1]]) for field in schema.split(",")])


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, stop, quoted, depth, array) -> (path, at, value): the objects of the array that begin in the range."""
    for got in batches:
        for path, start, stop, quoted, depth, array in zip(*(column.to_pylist() for column in got.columns)):
            with opened(path) as file:
                size = file.size()
                first, last = _past_slashes(file, start, size), _past_slashes(file, stop, size)
                begins, values = [], []
                for at, value in _in_range(file, first, last, size, quoted, depth, array):
                    begins.append(at)
                    values.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(begins), pa.string()), pa.array(begins, pa.int64()), pa.array(values, pa.string())], ["path", "at", "value"]
            )


def _in_range(file, first: int, last: int, size: int, quoted: int, depth: int, array: int) -> Iterator[tuple[int, str]]:
    data, end = _at(file, first, last), last
    at, odd, kind = _marks(data)
    step = np.where(odd == quoted, _STEP[kind].astype(np.int64), 0)
    after = depth + np.cumsum(step)
    inside = at + first > array
    closed = np.flatnonzero(inside & (after < 2) & (step < 0))
    limit = closed[0] if len(closed) else len(at)
    chosen = inside & (np.arange(len(at)) < limit)
    starts = np.flatnonzero(chosen & (step > 0) & (after == 3) & (kind == _OPEN))
    ends = np.flatnonzero(chosen & (step < 0) & (after == 2) & (kind == ord("}")))
    for k in starts:
        j = np.searchsorted(ends, k)
        if j < len(ends):
            yield first + int(at[k]), data[at[k] : at[ends[j]] + 1].decode()
        else:
            yield first + int(at[k]), _read_on(file, data[at[k] :], end, size)


def _read_on(file, head: bytes, end: int, size: int) -> str:
    """An object that begins with these bytes, read to its closing brace."""
    parts, depth, quoted = [], 0, 0
    data = head
    while True:
        at, odd, kind = _marks(data)
        step = np.where(odd == quoted, _STEP[kind].astype(np.int64), 0)
        after = depth + np.cumsum(step)
        done = np.flatnonzero((after == 0) & (step < 0))
        if len(done):
            return b"".join([*parts, data[: at[done[0]] + 1]]).decode()
        if end >= size:
            raise ValueError("the document ends inside an object")
        parts.append(data)
        depth = int(after[-1]) if len(after) else depth
        quoted ^= int((kind == _QUOTE).sum() % 2)
        stop = _past_slashes(file, min(end + MORE_BYTES, size), size)
        data, end = _at(file, end, stop), stop


def ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, stop): byte ranges of the files at a path; their contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    return files.select("path", begin.alias("start"), "length").select(
        "path", "start", F.least(F.col("start") + range_bytes, "length").alias("stop")
    )


def _spread(df: DataFrame, range_bytes: int) -> DataFrame:
    """Ranges over as many tasks as make about RANGE_BYTES each, but some for every core."""
    n = df.count()
    tasks = max(-(-n * range_bytes // RANGE_BYTES), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(max(1, min(n, tasks, TASKS)), *df.columns[:2])


def read_objects(spark: SparkSession, path: str, key: str = "traces", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, at, value): every object in the array under a top-level key, as JSON, with the byte it begins at.

    Each file at the path is one document. A document without the key, or with an empty array, gives no rows.
    Items of the array that are no objects are passed over.
    """
    cut = ranges(spark, path, range_bytes)
    change = written(_spread(cut, range_bytes).mapInArrow(_changes(key), _CHANGE), "ranges")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = change.withColumn("quoted", (F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2).cast("int"))
    for name in ("delta", "low", "key", "key_depth", "after"):
        known = known.withColumn(name, F.when(F.col("quoted") == 0, F.col(f"{name}_out")).otherwise(F.col(f"{name}_in")))
    known = known.withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)))
    # The array opens at its key where that stands at depth one; it ends in the first range after it that falls below depth two.
    opens = F.col("key") < _NONE
    top = F.when(opens & (F.col("depth") + F.col("key_depth") == 1), F.struct(F.col("key").alias("at"), F.col("start").alias("start"), (F.col("depth") + F.col("after")).alias("after")))
    whole = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = known.withColumn("array", F.min(top).over(whole)).where("array IS NOT NULL")
    fell = F.when(F.col("start") == F.col("array.start"), F.col("array.after") < 2).otherwise(F.col("depth") + F.col("low") < 2)
    known = known.withColumn("fallen", F.coalesce(F.max(fell.cast("int")).over(before), F.lit(0))).where("fallen = 0")
    tasks = known.select("path", "start", "stop", "quoted", "depth", F.col("array.at").alias("array"))
    return _spread(tasks, range_bytes).mapInArrow(_objects, "path string, at bigint, value string")


def read_items(spark: SparkSession, path: str, schema: str, key: str = "traces", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The objects of the array as rows of a schema; an object that is no JSON is an error."""
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return read_objects(spark, path, key, range_bytes).select(parsed.alias("_item")).select("_item.*")
