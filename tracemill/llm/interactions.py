"""Audit of how five filters interact, in every order, from a sparse document-term matrix.

Documents are cut into shards of bounded size. A shard is a block of the matrix in CSR form: where
each document's row begins, the word of each entry and how often it occurs there. Words of a shard
are numbered by its own dictionary first, by hash range and word. The dictionaries of all shards,
not the words of all documents, are shuffled in packs of one range; there each word gets a number
for the whole table, and each shard's columns are then renamed. Row sums and numbers of entries decide the filters A and B; C and D are flags found with
the words; E compares texts by their SHA-256.

Copies of one text are counted per part before they meet in one place, and the orders are counted
from 32 sums per part, one for each set of failed filters.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.packs import pack, unpack
from tracemill.llm.words import portions
from tracemill.session import new_folder, written

#: Bytes of texts in a shard, where a longer text is a shard of its own, and per hash range of words.
SHARD_BYTES, RANGE_BYTES = 8_000_000, 64_000_000
FILTERS = "ABCDE"

_DOCS = "doc_ids array<long>, parts array<string>, digests array<binary>, capitals array<boolean>, symbols array<boolean>"
_CSR = "indptr array<long>, indices array<{}>, counts array<int>"
_SHARD = f"shard long, range long, pack binary, {_DOCS}, {_CSR.format('int')}"
_MATRIX = f"shard long, {_DOCS}, {_CSR.format('long')}"
_NAMES = "shard long, range long, pack binary"


def _rows(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some texts and their CSR rows: words, indptr, indices, counts."""
    cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    begins = cut.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(begins)
    coded = cut.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:  # before the first and after the last word of a text
        real = code != blank
        text, code = text[real], code[real]
        code -= code > blank
        words = pa.concat_arrays([words.slice(0, blank), words.slice(blank + 1)])
    width = max(len(words), 1)
    key, counts = np.unique(text * width + code, return_counts=True)
    return words, np.searchsorted(key, np.arange(len(sizes) + 1) * width), key % width, counts


def _one(values, kind: pa.DataType) -> pa.Array:
    """A column of one list."""
    return pa.ListArray.from_arrays([0, len(values)], pa.array(values).cast(kind) if len(values) else pa.array([], kind))


def _shards(batches, ranges: int):
    """Per shard a row with its CSR block, and a row with the pack of its words in each range."""
    number = TaskContext.get().partitionId() << 32
    kinds = [kind for _, kind in (field.split() for field in f"{_DOCS}, {_CSR.format('int')}".split(", "))]
    arrow = {"array<long>": pa.int64(), "array<string>": pa.string(), "array<binary>": pa.binary(), "array<boolean>": pa.bool_(), "array<int>": pa.int32()}
    names = [field.split()[0] for field in _SHARD.split(", ")]
    for got in batches:
        for first, stop in portions(got.column(2), SHARD_BYTES):
            ids, parts, texts = (pa.concat_arrays([c.slice(first, stop - first)]) for c in got.columns)
            words, indptr, indices, counts = _rows(texts)
            capitals = pc.count_substring_regex(texts, "[A-Z]").to_numpy(zero_copy_only=False).astype(np.int64)
            many = 100 * capitals > 5 * pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            digests = [hashlib.sha256(text.encode()).digest() for text in texts.to_pylist()]
            # The words in the order of ranges, and sorted in each.
            sorted_ = pc.array_sort_indices(words).to_numpy().astype(np.int64)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))[sorted_]
            range_ = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            by_range = np.argsort(range_, kind="stable")
            order = sorted_[by_range]
            local = np.empty(len(words), np.int64)
            local[order] = np.arange(len(words))
            block = [ids, parts, digests, many, pc.match_substring_regex(texts, r"[#$%&*|]"), indptr, local[indices] if len(indices) else indices, counts]
            columns = [_one(values, arrow[kind]) for values, kind in zip(block, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *columns], names)
            words, own = words.take(pa.array(order)), range_[by_range]
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            packs = [(int(own[a]), pack(words.slice(a, b - a))) for a, b in zip(cuts, cuts[1:]) if b > a]
            k = len(packs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * k, pa.int64()), pa.array([r for r, _ in packs], pa.int64()), pa.array([p for _, p in packs], pa.binary()),
                    *[pa.nulls(k, c.type) for c in columns],
                ],
                names,
            )
            number += 1


def _named(packs: pa.Table) -> pa.Table:
    """The ranks of the words of each pack among all words of the range; they ascend, so their steps are sent."""
    read = [unpack(data)[0] for data in packs["pack"].to_pylist()]
    coded = pa.chunked_array(read).combine_chunks().dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    ranks = rank[coded.indices.to_numpy(zero_copy_only=False)]
    at = np.cumsum([0] + [len(words) for words in read]).tolist()
    none = pa.array([], pa.string())
    steps = [pack(none, np.diff(ranks[a:b], prepend=0)) for a, b in zip(at, at[1:])]
    return pa.Table.from_arrays([packs["shard"], packs["range"], pa.array(steps, pa.binary())], ["shard", "range", "pack"])


def _renaming(ranges: int):
    def renamed(block: pa.Table, names: pa.Table) -> pa.Table:
        """A shard with the numbers that its words have in the whole table."""
        packs = sorted(zip(names["range"].to_pylist(), names["pack"].to_pylist()))
        number = [np.cumsum(unpack(data)[1][0]) * ranges + range_ for range_, data in packs]
        indices = block["indices"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        indices = np.concatenate(number)[indices] if number else indices.astype(np.int64)
        column = pa.ListArray.from_arrays([0, len(indices)], pa.array(indices, pa.int64()))
        return block.set_column(block.schema.get_field_index("indices"), "indices", column)

    return renamed


def matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The document-term matrix as written CSR shards.

    Per shard: doc_ids, parts, digests of the texts, capitals and symbols (the failure of C and D),
    indptr, and the entries: indices (numbers of words, one for each distinct word of the whole
    table) and counts. Words are ``[^\\x20\\x09-\\x0D]+``, case-sensitive.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = size // range_bytes + 1
    shards = written(rows.mapInArrow(partial(_shards, ranges=ranges), _SHARD), "shards")
    names = shards.where("range IS NOT NULL").select("shard", "range", "pack").groupBy("range").applyInArrow(_named, _NAMES)
    # A shard without any word has no names; its block comes through with no entries.
    blocks = shards.where("range IS NULL").drop("range", "pack")
    found = blocks.groupBy("shard").cogroup(names.groupBy("shard")).applyInArrow(_renaming(ranges), _MATRIX)
    path = new_folder(docs.sparkSession, "matrix")
    found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def judged(shards: DataFrame) -> DataFrame:
    """Per document of a matrix: doc_id, part, digest, n_words, n_distinct, and mask (1, 2, 4, 8 for failing A, B, C, D)."""
    begin, end = (lambda i: F.element_at("indptr", i + 1)), (lambda i: F.element_at("indptr", i + 2))
    row = F.sequence(F.lit(0), F.size("doc_ids") - 1)
    total = F.transform(row, lambda i: F.aggregate(F.slice("counts", begin(i).cast("int") + 1, (end(i) - begin(i)).cast("int")), F.lit(0).cast("long"), lambda x, y: x + y))
    entries = F.transform(row, lambda i: end(i) - begin(i))
    flat = shards.select(
        "doc_ids", "parts", "digests", "capitals", "symbols", total.alias("totals"), entries.alias("entries")
    ).selectExpr("inline(arrays_zip(doc_ids, parts, digests, capitals, symbols, totals, entries))").toDF(
        "doc_id", "part", "digest", "capitals", "symbols", "n_words", "n_distinct"
    )
    fails = [F.col("n_words") < 50, 100 * F.col("n_distinct") < 65 * F.col("n_words"), F.col("capitals"), F.col("symbols")]
    mask = sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(fails)), F.lit(0))
    return flat.select("doc_id", "part", "digest", "n_words", "n_distinct", mask.alias("mask"))


def _counted(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(part, mask, n, good, toxic) with the bit of E in the mask."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("l")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    # Repeated rows shrink first; then copies of a text, to a row per part and labels with how many of them hold the smallest id there.
    same = written(rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")), "rows")
    named = same.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("l"), "left").drop("l")
    unnamed = same.where("doc_id IS NULL").withColumn("good", F.lit(0)).withColumn("toxic", F.lit(0))
    every = named.unionByName(unnamed).fillna(0, ["good", "toxic"])
    by = ["digest", "part", "mask", "good", "toxic"]
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = written(
        every.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), least.alias("least"))
        .select(*by, "n", "unnamed", F.col("least.doc_id").alias("m"), F.coalesce("least.n", F.lit(0)).alias("at_m")), "copies"
    )
    first = copies.groupBy(F.col("digest").alias("d")).agg(F.min("m").alias("first"))
    copies = copies.join(first, F.col("digest") == F.col("d"))
    passing = F.col("unnamed") + F.when(F.col("m") == F.col("first"), F.col("at_m")).otherwise(0)
    split = copies.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n"))
    )))
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def _steps() -> str:
    """An array literal of all steps: filter_order, step, bit of the step's filter, bits of the filters before it."""
    made = []
    for order in permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            made.append(f"struct('{''.join(order)}' AS filter_order, {k + 1} AS step, {bit} AS bit, {before} AS before)")
            before |= bit
    return f"array({', '.join(made)})"


def orders(counts: DataFrame) -> DataFrame:
    """All orders and steps per part, from (part, mask, n, good, toxic)."""
    sums = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sums"))  # 32 at most
    steps = sums.select("part", "sums", F.expr(f"inline({_steps()})"))

    def total(condition: str, value: str = "x.n") -> Column:
        return F.expr(f"aggregate(sums, 0L, (s, x) -> s + IF({condition}, {value}, 0L))")

    removed = "x.mask & bit <> 0 AND x.mask & before = 0"
    return steps.select(
        "part", "filter_order", "step", total("x.mask & (before | bit) = 0").alias("kept"), total(removed).alias("removed"),
        total("x.mask & bit <> 0 AND x.mask & before <> 0").alias("redundant"), total("x.mask = bit").alias("unique_fails"),
        total(removed, "x.good").alias("good_lost"), total(removed, "x.toxic").alias("toxic_lost"),
        # A document that fails m filters is removed by each of them in 120 / m of the orders.
        total("x.mask & bit <> 0", "x.n * (120 DIV bit_count(x.mask))").alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Failure: A under 50 words; B 100 * distinct words < 65 * words; C 100 * capitals A-Z > 5 * code
    points; D any of ``#$%&*|``; E the text of a row with a smaller id.

    Defined cases: a null text is empty; a null part is the empty string; a row without an id has no
    label, passes E and makes no other row fail it; rows of one id and one text do not fail E by each
    other; of repeated labels of an id any 1 counts; null labels are 0; an empty table gives no rows.
    Other columns are not read.
    """
    return orders(_counted(judged(matrix(docs, id_col, text_col, part_col, range_bytes)), labels, id_col))
