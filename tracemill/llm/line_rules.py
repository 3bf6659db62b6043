"""Quality rules of texts and of lines across documents.

The base rules look at one text. The cross-document rule looks at lines: normalised, hashed and
counted over the distinct texts of each host. Lines above the limit are boilerplate of that host
and are taken out of the text. A document is depleted and rejected when they make up more than a
given share of its words, or when what is left of it fails the base rules.
Copies of one text count once, so a line is not common because its document was copied.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tracemill.llm.words import portions, shingles, word_hashes
from tracemill.session import scratch, written

#: A line is boilerplate in more than so many of a host's distinct texts. A caller may also ask for a share of them;
#: by default the number decides alone, since a share lets a line repeat the more, the more data there are.
LIMIT_SHARE, LIMIT_DOCS = 0.0, 6
#: Boilerplate may be this share of a document's words.
DEPLETED = 0.3
#: Bytes of a broadcast table; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16_000_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]+")
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def fresh(name: str, df: DataFrame) -> str:
    """The name, with as many underscores behind it as make it new among the columns."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def _repeats(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of words, and of words in three-word windows that occur twice or more in it."""
    words, begins = word_hashes(texts, lower=False)
    counts = np.diff(begins)
    values, starts = shingles(words, begins, 3)
    out = np.zeros(len(counts), np.int64)
    for j in np.flatnonzero(counts > 3).tolist():
        own = values[starts[j] : starts[j + 1]]
        kinds, back, times = np.unique(own, return_inverse=True, return_counts=True)
        if len(kinds) < len(own):
            again = times[back] > 1
            covered = np.zeros(counts[j], bool)
            for i in range(3):
                covered[i : i + len(own)] |= again
            out[j] = covered.sum()
    return counts, out


def _line_hash(line: str) -> int:
    """Hash of a normalised line: lower case, single blanks, each run of digits as 0."""
    return xxhash.xxh3_64_intdigest(_DIGITS.sub("0", " ".join(line.lower().split()))) - (1 << 63)


def _lines(text: str) -> tuple[int, list[int], list[int]]:
    """Repeated lines with a word; hashes of the distinct normalised lines, and the words of all their occurrences."""
    seen: set[str] = set()
    repeated, words = 0, Counter()
    for line in text.split("\n"):
        n = len(_WORD.findall(line))
        if n:
            repeated += line in seen
            seen.add(line)
            words[_line_hash(line)] += n
    return repeated, list(words), list(words.values())


def _statistics(batches):
    for got in batches:
        host_column, text_column = got.column(1), got.column(2)
        for first, stop in portions(text_column):
            part = pa.concat_arrays([text_column.slice(first, stop - first)])
            n_words, again = _repeats(part)
            symbols = pc.count_substring_regex(part, r"[#*$%&|<>]").cast(pa.int64())
            spaces = pc.count_substring_regex(part, r"[\x20\x09-\x0D]").cast(pa.int64())
            chars = pc.subtract(pc.utf8_length(part).cast(pa.int64()), spaces)
            found = [_lines(text) for text in part.to_pylist()]
            digests = [xxhash.xxh3_128_digest(text) for text in part.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    got.column(0).slice(first, stop - first), host_column.slice(first, stop - first), pa.array(digests, pa.binary()),
                    pa.array(n_words, pa.int64()), chars, symbols, pa.array([x[0] for x in found], pa.int64()), pa.array(again, pa.int64()),
                    pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "host", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
            )


def _without(text: str, gone: list[int] | None) -> str:
    """The text without the lines of these hashes; lines without a word stay."""
    if not gone:
        return text
    gone = set(gone)
    return "\n".join([line for line in text.split("\n") if not _WORD.search(line) or _line_hash(line) not in gone])


def _remains(batches):
    """(h, d, text, gone) -> (h, d, left_failed): whether what is left fails the base rules."""
    for got in batches:
        for first, stop in portions(got.column(2)):
            part = got.slice(first, stop - first)
            left = [_without(text, gone) for text, gone in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            n, again = _repeats(pa.array(left, pa.string()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array((n < 50) | (100 * again > 50 * n))], ["h", "d", "left_failed"])


def _stripped(batches, at: int, chars: int | None):
    """Rows with the lines of the last column taken out of the text; the column of its length follows."""
    for got in batches:
        for first, stop in portions(got.column(at)):
            part = got.slice(first, stop - first)
            columns = part.columns[:-1]
            old, gone = columns[at].to_pylist(), part.column(part.num_columns - 1).to_pylist()
            left = [_without(text, own) for text, own in zip(old, gone)]
            columns[at] = pa.array(left, columns[at].type)
            if chars is not None:
                lengths = [len(text) if own else n for text, own, n in zip(left, gone, columns[chars].to_pylist())]
                columns[chars] = pa.array(lengths, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])


def _small(df: DataFrame) -> DataFrame:
    """A written table, with a hint for a broadcast where it is small: 64 bytes a row and 8 for each hash in a list."""
    lists = F.coalesce(F.size("gone"), F.lit(0)) if "gone" in df.columns else F.lit(0)
    host = next((c for c in ("h", "host") if c in df.columns), None)
    size = F.lit(64) + 8 * lists + (F.coalesce(F.octet_length(host), F.lit(0)) if host else F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def _judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit_share: float = LIMIT_SHARE,
    limit_docs: int = LIMIT_DOCS, depleted: float = DEPLETED,
) -> DataFrame:
    """The verdicts, with the hashes of the lines above the limit in the column gone (null for none)."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    schema = f"doc_id long, host string, digest binary, {BASE}, lines array<long>, line_words array<long>"
    stats = written(rows.mapInArrow(_statistics, schema), "lines")

    # One row per distinct text and host; the lines of a group of copies are counted once.
    texts = stats.groupBy("host", "digest").agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words"))
    texts = written(texts, "texts")
    hosts = texts.groupBy("host").agg(F.count("*").alias("texts"))
    counts = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs"))
    common = written(
        counts.where(F.col("docs") > limit_docs).join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
        .where(F.col("docs") > limit_share * F.col("texts")).select(F.col("host").alias("h"), F.col("line").alias("l")),
        "common-lines",
    )
    parts = texts.select("host", "digest", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    lost = written(
        parts.join(_small(common), F.col("host").eqNullSafe(F.col("h")) & (F.col("x.lines") == F.col("l")))
        .groupBy("host", "digest").agg(F.sum("x.line_words").alias("lost"), F.collect_set("l").alias("gone"))
        .select(F.col("host").alias("h"), F.col("digest").alias("d"), "lost", "gone"), "lost"
    )
    same = F.col("host").eqNullSafe(F.col("h")) & (F.col("digest") == F.col("d"))
    base = stats.drop("lines", "line_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = base.join(_small(lost), same, "left").drop("h", "d")
    out = out.withColumn("boilerplate_words", F.coalesce("lost", F.lit(0))).withColumn("base_failed", failed)
    enough = (F.col("boilerplate_words") <= depleted * F.col("n_words")) & (F.col("n_words") - F.col("boilerplate_words") >= 50)
    out = written(out.withColumn("kept", ~F.col("base_failed") & enough).drop("lost"), "judged")

    # Texts that have lost lines and are not rejected yet: repeated windows are counted anew in what is left.
    open_ = out.where("kept AND gone IS NOT NULL").groupBy(F.col("host").alias("h"), F.col("digest").alias("d")).agg(F.first("gone").alias("gone"))
    open_ = written(open_, "open")
    marked = rows.select("host", "text").mapInArrow(partial(_digests, at=1, name="digest"), "host string, text string, digest binary")
    left = marked.join(_small(open_), same).select("h", "d", "text", "gone").mapInArrow(_remains, "h string, d binary, left_failed boolean")
    left = written(left.where("left_failed").select("h", "d").distinct(), "depleted")
    out = out.join(_small(left), same, "left").withColumn("kept", F.col("kept") & F.col("d").isNull())
    return out.drop("h", "d")


def verdicts(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, host, digest of the text, the base statistics, boilerplate_words, base_failed, kept.

    Words are ``[^\\x20\\x09-\\x0D]+``. A text fails the base rules with fewer than 50 words, or when
    more than half of its words lie in repeated three-word windows. The statistics and the digest
    are those of the whole text; kept also asks that the text without its boilerplate passes.

    Defined cases: a null text is empty, has no words and fails; a null host is a host of its own;
    rows without an id, repeated rows and ties get the verdict of their text and host; an empty
    table gives no rows. Other columns are not read.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_judged(docs, **options).drop("gone"), "verdicts")


def _digests(batches, at: int, name: str):
    for got in batches:
        for first, stop in portions(got.column(at)):
            part = got.slice(first, stop - first)
            digests = pa.array([xxhash.xxh3_128_digest(text or "") for text in part.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, digests], [*part.schema.names, name])


def passing(docs: DataFrame, text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars", **options) -> DataFrame:
    """The documents that are kept, with all their columns, without the lines above the limit.

    Where lines were taken out, the column of the length, if there is one, is that of the new text.
    """
    own, host, digest, gone = (fresh(name, docs) for name in ("_own", "_host", "_digest", "_gone"))
    with scratch(docs.sparkSession) as keep:
        found = _judged(docs, text_col=text_col, host_col=host_col, **options).where("kept")
        found = keep(found.groupBy(F.col("host").alias(host), F.col("digest").alias(digest)).agg(F.first("gone").alias(gone)), "kept")
    schema = StructType([*docs.schema.fields, StructField(own, BinaryType())])
    marked = docs.mapInArrow(partial(_digests, at=docs.columns.index(text_col), name=own), schema)
    same = F.col(own).eqNullSafe(F.col(digest)) & F.col(host_col).cast("string").eqNullSafe(F.col(host))
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None
    strip = partial(_stripped, at=docs.columns.index(text_col), chars=chars)
    return marked.join(found, same).select(*docs.columns, gone).mapInArrow(strip, docs.schema)
