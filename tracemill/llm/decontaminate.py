"""Benchmark passages in documents: SimHash of item-sized windows, then exact similarity.

A window is as many five-word shingles of a document as an item has. Its fingerprint has 128 bits,
each the sign of the vote of its shingles' hash bits, which depends on no other item. A multi-index finds all items of
that size within a Hamming radius: the bits are dealt to blocks, one of which must hold at most
radius / blocks of the errors, so the index keeps for each block all values around an item's. Each
candidate is verified by the exact weighted similarity of the two multisets of shingles.

Weights come from the whole benchmark: a shingle of an item weighs one over the number of distinct
item texts that have it, whatever pass it is in. In a comparison all other shingles weigh what those
of the item weigh on average, so repeated and near-equal items are found like single ones.

Windows without any shingle of the benchmark have similarity 0 with every item; runs of them are
not fingerprinted. Fingerprints of overlapping windows come from running sums of votes.

The benchmark goes to the tasks in blocks of bounded size, each in a pass of its own over the
documents, so a benchmark of any size is handled and none is sent whole.
"""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import line_rules
from tracemill.llm.words import distinct, mixed, portions, shingles, word_hashes
from tracemill.session import written

#: Fingerprint bits, radius and blocks. Windows that share 80 % of their shingles differ in 19 of 128 bits
#: on average, with a deviation of 4; 11 blocks leave at most 2 errors in one of them.
BITS, RADIUS, BLOCKS = 128, 32, 11
#: Words of the benchmark per pass, and shingles of a document whose votes are held at once.
WORDS_A_PASS, VOTES_AT_ONCE = 200_000, 20_000

LEAKS = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"


def _votes(values: np.ndarray) -> np.ndarray:
    """A row of +1 or -1 per bit of the 128-bit hash of each shingle."""
    halves = np.stack([mixed(values + np.uint64(3)), mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1)
    bits = np.unpackbits(halves.view(np.uint8), axis=1)
    return np.where(bits, 1.0, -1.0)


def _packed(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1)


class Index:
    """The items of one pass, by size: fingerprints, the values of their blocks, and their shingles."""

    def __init__(self, ids, values, begins, words, shared: dict[int, int], radius: int = RADIUS, blocks: int = BLOCKS):
        """shared: for shingles of several distinct texts of the benchmark, how many texts."""
        self.radius = radius
        self.known = np.unique(values)
        self.weight = 1.0 / np.fromiter((shared.get(x, 1) for x in self.known.view(np.int64).tolist()), np.int64, len(self.known))
        self.block_of = np.array_split(np.arange(BITS), blocks)
        self.errors = radius // blocks
        self.items, self.by_size = [], {}
        for k, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
            own = values[a:b]
            self.items.append((ids[k], int(words[k]), *self._bag(own)))
            self.by_size.setdefault(b - a, []).append((k, _packed(_votes(own).sum(0, keepdims=True))[0]))
        self.prints = {k: p for rows in self.by_size.values() for k, p in rows}
        self.sizes = np.diff(begins)
        owned = np.concatenate([x[2] for x in self.items]) if self.items else values[:0]
        order = np.argsort(owned, kind="stable")  # shingle -> the items that have it
        self.owned, self.owner = owned[order], np.repeat(np.arange(len(self.items)), [len(x[2]) for x in self.items])[order]
        self.tables = {}
        for size, rows in self.by_size.items():
            prints = np.unpackbits(np.stack([p for _, p in rows]), axis=1)
            rows_wide = -(-len(rows) // 8)
            tables = []
            for places in self.block_of:
                powers = 1 << np.arange(len(places), dtype=np.int64)
                table = np.zeros((1 << len(places), rows_wide), np.uint8)  # block value -> bits of the items near it
                values_of, at = prints[:, places] @ powers, np.arange(len(rows))
                for errors in range(self.errors + 1):
                    for flipped in itertools.combinations(range(len(places)), errors):
                        flip = sum(1 << j for j in flipped)
                        np.bitwise_or.at(table, (values_of ^ flip, at >> 3), np.uint8(128) >> (at & 7).astype(np.uint8))
                tables.append((places, powers, table))
            self.tables[size] = (np.stack([p for _, p in rows]), tables, [k for k, _ in rows])
        self.widest = max(self.tables, default=1)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def held(self, values: np.ndarray) -> np.ndarray:
        """Which shingles are those of an item."""
        out = self.sieve[(values & np.uint64((1 << 22) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.known[np.minimum(np.searchsorted(self.known, values[at]), len(self.known) - 1)] == values[at]
        return out

    def _bag(self, values: np.ndarray):
        """Distinct shingles of an item, their counts and weights."""
        kinds, counts = np.unique(values, return_counts=True)
        return kinds, counts, self.weight[np.searchsorted(self.known, kinds)]

    def similarity(self, values: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of two multisets of shingles; those that the item lacks weigh its mean."""
        kinds, counts = np.unique(values, return_counts=True)
        _, _, own, own_counts, weights = self.items[item]
        _, i, j = np.intersect1d(kinds, own, assume_unique=True, return_indices=True)
        own_total = float((weights * own_counts).sum())
        shared = float((weights[j] * np.minimum(counts[i], own_counts[j])).sum())
        total = float((weights[j] * counts[i]).sum()) + own_total / own_counts.sum() * float(counts.sum() - counts[i].sum())
        return shared / (total + own_total - shared)

    def search(self, values: np.ndarray, at_least: float):
        """(item, start, distance, similarity) of the best window of each item in the shingles of one document."""
        hits = np.flatnonzero(self.held(values))
        found: dict[int, tuple] = {}
        breaks = np.flatnonzero(np.diff(hits) >= 2 * self.widest) + 1
        for run in np.split(hits, breaks):  # runs whose windows do not overlap
            begin, end = max(0, run[0] - self.widest + 1), min(len(values), run[-1] + self.widest)
            for first in range(begin, end, VOTES_AT_ONCE):  # a part holds all windows that start in it
                stop = min(end, first + VOTES_AT_ONCE + self.widest)
                self._search_part(values, hits, first, stop, min(end, first + VOTES_AT_ONCE), at_least, found)
        if len(values) < self.widest:
            self._search_longer(values, at_least, found)
        return [(item, *best) for item, best in found.items()]

    def _search_longer(self, values, at_least, found) -> None:
        """Items of more shingles than the document has, which is the window as a whole; all that share enough are verified."""
        kinds = np.unique(values)
        first, stop = np.searchsorted(self.owned, kinds), np.searchsorted(self.owned, kinds, side="right")
        near = np.concatenate([self.owner[a:b] for a, b in zip(first.tolist(), stop.tolist())]) if len(kinds) else self.owner[:0]
        for item in np.unique(near).tolist():
            if self.sizes[item] > len(values) and (alike := self.similarity(values, item)) >= at_least:
                distance = int(np.bitwise_count(_packed(_votes(values).sum(0, keepdims=True))[0] ^ self.prints[item]).sum())
                found[item] = (0, distance, alike)

    def _search_part(self, values, hits, first, stop, last, at_least, found) -> None:
        own = values[first:stop]
        total = np.concatenate([np.zeros((1, BITS)), np.cumsum(_votes(own), 0)])
        inside = np.zeros(stop - first + 1, np.int64)
        inside[hits[(hits >= first) & (hits < stop)] - first + 1] = 1
        inside = np.cumsum(inside)
        for size, (prints, tables, items) in self.tables.items():
            if size > len(own):
                continue
            starts = np.flatnonzero(inside[size:] > inside[:-size])
            starts = starts[starts < last - first]
            if not len(starts):
                continue
            windows = _packed(total[starts + size] - total[starts])
            bits = np.unpackbits(windows, axis=1)
            near = np.zeros((len(starts), tables[0][2].shape[1]), np.uint8)
            for places, powers, table in tables:
                near |= table[bits[:, places] @ powers]
            window, row = np.nonzero(np.unpackbits(near, axis=1)[:, : len(items)])
            apart = np.bitwise_count(windows[window] ^ prints[row]).sum(1)
            close = apart <= self.radius
            for w, r, distance in zip(window[close].tolist(), row[close].tolist(), apart[close].tolist()):
                start, item = int(starts[w]) + first, items[r]
                alike = self.similarity(values[start : start + size], item)
                if alike >= at_least and (item not in found or (-alike, start) < (-found[item][2], found[item][0])):
                    found[item] = (start, distance, alike)


def _search(batches, index: Index, k: int, at_least: float):
    for got in batches:
        for first, stop in portions(got.column(1)):
            keys = got.column(0).slice(first, stop - first).to_pylist()
            values, begins = shingles(*word_hashes(got.column(1).slice(first, stop - first), lower=True), k)
            hit = np.concatenate([[0], np.cumsum(index.held(values))])
            rows = []
            for j in np.flatnonzero(hit[begins[1:]] > hit[begins[:-1]]).tolist():
                for item, start, distance, alike in index.search(values[begins[j] : begins[j + 1]], at_least):
                    item_id, words = index.items[item][:2]
                    rows.append((keys[j], item_id, start, words, distance, alike))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [got.column(0).type] + [pa.int64()] * 3 + [pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split(" ")[0] for x in LEAKS.split(", ")])


def _item_shingles(batches, k: int):
    """(text) -> (wording, shingle): the distinct shingles of each item; wordings tell texts of other words apart."""
    for got in batches:
        for first, stop in portions(got.column(0)):
            words, begins = word_hashes(got.column(0).slice(first, stop - first), lower=True)
            wordings = [xxhash.xxh3_64_intdigest(words[a:b].tobytes()) - (1 << 63) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
            values, starts = distinct(*shingles(words, begins, k))
            out = np.repeat(np.array(wordings, np.int64), np.diff(starts))
            yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(values.view(np.int64))], ["wording", "shingle"])


def _passes(items: DataFrame, words_a_pass: int):
    """Blocks of items of a bounded number of words; one block is held at a time."""
    block, held = [], 0
    for row in items.toLocalIterator():
        if block and held >= words_a_pass:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += len(row["text"]) // 2 + 1
    if block:
        yield block


def _found(
    rows: DataFrame, key: str, benchmark: DataFrame, k: int = 5, at_least: float = 0.8, item_col: str = "item_id", item_text_col: str = "text",
    words_a_pass: int = WORDS_A_PASS, radius: int = RADIUS,
) -> DataFrame:
    """The leaks of rows of a key, of the type that is given, and a text."""
    spark = rows.sparkSession
    schema = LEAKS.replace("doc_id long", f"doc_id {key}")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    items = items.where("trim(text) <> ''").orderBy("item_id", "text")
    shared = items.select("text").distinct().mapInArrow(partial(_item_shingles, k=k), "wording long, shingle long").distinct()
    shared = written(shared.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "shared-shingles")
    out = spark.createDataFrame([], schema)
    for block in _passes(items, words_a_pass):
        words, begins = word_hashes(pa.array([text for _, text in block], pa.string()), lower=True)
        values, starts = shingles(words, begins, k)
        own = spark.createDataFrame(pa.table({"shingle": np.unique(values).view(np.int64)}))
        times = {r["shingle"]: r["n"] for r in shared.join(F.broadcast(own), "shingle").collect()}
        index = Index([i for i, _ in block], values, starts, np.diff(begins), times, radius)
        out = out.unionByName(rows.mapInArrow(partial(_search, index=index, k=k, at_least=at_least), schema))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document and item that it holds: the most similar window, the first of equal ones.

    Similarity is the weighted Jaccard similarity of the multisets of k-word shingles, of
    lower-cased (A-Z) words between ASCII white space; a shingle of the item weighs one over the number of
    distinct item texts that have it, any other the mean of the item's. start_word counts words before the
    window. An item that is longer than the document is held against the whole document.

    Defined cases: null or empty texts and items match nothing; an item of fewer than k words
    matches only documents that are this sequence; rows without an id are searched and give a null
    doc_id; repeated rows give repeated results; empty tables give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _found(rows, "long", benchmark, **options)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no item, with all their columns. Rows are told by their texts, so rows without an id go as well."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = _found(docs.select(F.md5(text.cast("binary")).alias("doc_id"), text.alias("text")), "string", benchmark, **options)
    key = line_rules.fresh("_text_md5", docs)
    found = found.select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, F.md5(text.cast("binary"))).join(found, key, "left_anti").select(docs.columns)
