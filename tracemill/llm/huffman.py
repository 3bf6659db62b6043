"""Token ids as Huffman-coded blocks in Parquet files, and back.

File format, under one folder:

- ``ids``: the tokenized documents in ascending id order, one row each, with the number of the
  range partition (part) and the place in it (seq); an intermediate of the writer.
- ``code``: one row per id that occurs: its global count and the length of its code word. The code
  is canonical: words are numbered by (length, id), so the lengths alone define it.
- ``blocks``: one row per block of whole documents that follow one another: their ids and numbers
  of tokens, the bits, and the bit offset of every 128th token. A block needs only the code to be
  decoded, and the offsets let all its stretches be decoded side by side.
- ``index``: for each block the number of tokens of all documents before it.

Code lengths are limited by package-merge, so one table lookup decodes a token.

Defined cases: null and empty texts hold the end id alone; repeated rows are stored each by
itself, ordered by text within an id; null ids come first; an empty table gives empty files and
no rows. Columns besides id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.tokens import encoded, encoder
from tracemill.session import new_folder

#: Tokens between two bit offsets, tokens of a block (a longer document has a block of its own),
#: and tokens that a task decodes at once.
STRETCH, BLOCK_TOKENS, DECODED_TOKENS = 128, 65_536, 1_048_576
#: The longest code word, in bits; at most 25, so that a word lies in four bytes.
LONGEST_CODE = 20


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of an optimal prefix code with words of at most so many bits, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} ids need words of more than {longest} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    weights, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = weights[0 : len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, pairs])
        by = np.argsort(merged, kind="stable")
        weights = merged[by]
        is_leaf.append(by < n)
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for kinds in reversed(is_leaf):
        own = int(kinds[:taken].sum())
        lengths[:own] += 1
        taken = 2 * (taken - own)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of ids with the given lengths: words to write, and a table to read them."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        by = np.lexsort((ids, lengths))
        self.ids, self.sizes = np.asarray(ids, np.int64)[by], np.asarray(lengths, np.int64)[by]
        self.longest = int(self.sizes.max(initial=1))
        room = np.left_shift(1, self.longest - self.sizes)  # table entries that start with a word
        begins = np.cumsum(room) - room
        top = int(self.ids.max(initial=0)) + 1
        self.word, self.length = np.zeros(top, np.uint64), np.zeros(top, np.uint8)
        self.word[self.ids] = begins >> (self.longest - self.sizes)
        self.length[self.ids] = self.sizes
        self.symbol_at = np.zeros(1 << self.longest, np.uint32)
        self.length_at = np.ones(1 << self.longest, np.uint8)
        used = int(room.sum())
        self.symbol_at[:used], self.length_at[:used] = np.repeat(self.ids, room), np.repeat(self.sizes, room)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of the ids, and the bit offset of every STRETCH-th of them."""
        size = self.length[ids].astype(np.int64)
        ends = np.cumsum(size)
        at = ends - size
        total = int(ends[-1]) if len(ends) else 0
        out = np.zeros(total // 32 + 3, np.uint64)
        if total:
            word = at >> 5
            value = self.word[ids] << (64 - (at & 31) - size).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] |= np.bitwise_or.reduceat(value >> np.uint64(32), first)
            out[word[first] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[: (total + 7) // 8], at[::STRETCH]

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """The ids of each block (bits, offsets, number of ids); all stretches go side by side."""
        if not blocks:
            return []
        raw = np.frombuffer(b"".join([x[0] for x in blocks]) + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        base = np.cumsum([0] + [8 * len(x[0]) for x in blocks[:-1]])
        at = np.concatenate([x[1] + b for x, b in zip(blocks, base)]).astype(np.int64)
        out = np.zeros((len(at), STRETCH), np.uint32)
        mask, most = np.uint32((1 << self.longest) - 1), 32 - self.longest
        for k in range(STRETCH):  # past the end of a short stretch this reads bits that nobody looks at
            entry = window[np.minimum(at >> 3, len(window) - 1)] >> (most - (at & 7)).astype(np.uint32) & mask
            out[:, k] = self.symbol_at[entry]
            at += self.length_at[entry]
        found, row = [], 0
        for _, offsets, n in blocks:
            found.append(out[row : row + len(offsets)].reshape(-1)[:n])
            row += len(offsets)
        return found


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str, text_col: str) -> None:
    """Tokenize in ascending id order and store the ids, with part and seq."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def ids_of(batches):
        tokens, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        kind = "<u2" if tokens.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        end = np.array([end_id], kind).tobytes()
        for got in batches:
            for first, ids, begins in encoded(got.column(1), tokens):
                ids, cuts = ids.astype(kind), begins.tolist()
                raw = [ids[a:b].tobytes() + end for a, b in zip(cuts, cuts[1:])]
                n = len(raw)
                yield pa.RecordBatch.from_arrays(
                    [got.column(0).slice(first, n), pa.array([part] * n, pa.int64()), pa.array(range(seq, seq + n), pa.int64()),
                     pa.array([len(end)] * n, pa.int32()), pa.array(raw, pa.binary())],
                    ["doc_id", "part", "seq", "width", "ids"],
                )
                seq += n

    schema = "doc_id long, part long, seq long, width int, ids binary"
    rows.mapInArrow(ids_of, schema).write.option("compression", "zstd").parquet(f"{folder}/ids")


def _ids(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}")


def write_code(spark: SparkSession, folder: str, longest: int) -> None:
    """Count all ids and store the code lengths. At most one row per id of the vocabulary reaches the driver."""

    def counted(batches):
        total = np.zeros(0, np.int64)
        for got in batches:
            widths, raws = got.column(0).to_pylist(), got.column(1).to_pylist()
            for a in range(0, len(raws), 4096):
                own = np.bincount(np.concatenate([_ids(r, w) for r, w in zip(raws[a : a + 4096], widths[a : a + 4096])]))
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    counts = spark.read.parquet(f"{folder}/ids").select("width", "ids").mapInArrow(counted, "id long, n long")
    found = counts.groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    lengths = code_lengths(found["n"].to_numpy(np.int64), longest)
    rows = [(int(i), int(n), int(x)) for i, n, x in zip(found["id"], found["n"], lengths)]
    spark.createDataFrame(rows, "id long, n long, length int").coalesce(1).write.parquet(f"{folder}/code")


def read_code(spark: SparkSession, folder: str) -> Code:
    code = spark.read.parquet(f"{folder}/code").toPandas()
    return Code(code["id"].to_numpy(np.int64), code["length"].to_numpy(np.int64))


def write_blocks(spark: SparkSession, folder: str, block_tokens: int) -> None:
    """Encode the stored ids as blocks, in the order in which they are stored, and index them."""
    code = read_code(spark, folder)

    def blocks(batches):
        part = first = follows = None
        ids, parts, held = [], [], 0

        def closed():
            bits, offsets = code.encode(np.concatenate(parts))
            lengths = [len(x) for x in parts]
            columns = [[part], [first], [sum(lengths)], [ids], [lengths], [offsets.astype("<i8").tobytes()], [bits]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["part", "first", "n_ids", "doc_ids", "lengths", "offsets", "bits"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for got in batches:
            for doc_id, p, seq, width, raw in zip(*[got.column(k).to_pylist() for k in range(5)]):
                if parts and ((p, seq) != (part, follows) or held >= block_tokens):
                    yield closed()
                    ids, parts, held = [], [], 0
                if not parts:
                    part, first = p, seq
                own = _ids(raw, width)
                ids.append(doc_id)
                parts.append(own)
                held += len(own)
                follows = seq + 1
        if parts:
            yield closed()

    stored = spark.read.parquet(f"{folder}/ids").select("doc_id", "part", "seq", "width", "ids")
    schema = "part long, first long, n_ids long, doc_ids array<long>, lengths array<long>, offsets binary, bits binary"
    stored.mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{folder}/blocks")

    # Blocks of a part are summed up by part; the totals are one row per part, as many as range partitions.
    sizes = spark.read.parquet(f"{folder}/blocks").select("part", "first", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(bases, "part")
    index.select("part", "first", (F.col("base") + F.col("inside")).alias("start")).write.parquet(f"{folder}/index")


def write(
    docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None,
    longest: int = LONGEST_CODE, block_tokens: int = BLOCK_TOKENS,
) -> str:
    """Write all documents in the file format and return the folder."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    write_ids(docs, folder, tokenizer, end_id, id_col, text_col)
    write_code(spark, folder, longest)
    write_blocks(spark, folder, block_tokens)
    return folder


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Decode the blocks: doc_id, start, n_tokens, ids_crc32 per document, and its ids on request."""
    code = read_code(spark, folder)
    schema = "doc_id long, n_tokens long, ids_crc32 long, part long, first long, inside long" + ", ids array<long>" * with_ids

    def documents(batches):
        def decoded(rows):
            columns: list[list] = [[] for _ in range(6 + with_ids)]
            found = code.decode([(x[6], np.frombuffer(x[5], "<i8"), x[2]) for x in rows])
            for (part, first, _, doc_ids, lengths, _, _), ids in zip(rows, found):
                at = 0
                for doc_id, n in zip(doc_ids, lengths):
                    own = np.ascontiguousarray(ids[at : at + n], "<u4")
                    for column, value in zip(columns, (doc_id, n, zlib.crc32(own), part, first, at)):
                        column.append(value)
                    if with_ids:
                        columns[6].append(own.astype(np.int64))
                    at += n
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * with_ids
            names = ["doc_id", "n_tokens", "ids_crc32", "part", "first", "inside"] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        rows, held = [], 0
        for got in batches:
            for row in zip(*[got.column(k).to_pylist() for k in range(7)]):
                rows.append(row)
                held += row[2]
                if held >= DECODED_TOKENS:
                    yield decoded(rows)
                    rows, held = [], 0
        if rows:
            yield decoded(rows)

    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "first", "n_ids", "doc_ids", "lengths", "offsets", "bits")
    rows = blocks.mapInArrow(documents, schema).join(spark.read.parquet(f"{folder}/index"), ["part", "first"])
    return rows.select(
        "doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )
