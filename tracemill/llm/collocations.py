"""Phrases whose words belong together, from a weighted de Bruijn graph of three-word grams.

Nodes are pairs of words, and a three-word gram is an edge from its first two words to its last two,
weighted by its occurrences. Only edges are counted over the texts. A node's count is what flows out
of it plus the pieces that end with it; a word's count is what the nodes that begin with it hold
plus the pieces that end with it. So pairs and words are summed from counts, not from texts.

Counts travel in packs: the grams of one language and one hash bucket of a run of texts, each gram
once, as codes into the pack's own list of words. A bucket is summed in one task, and sends the
flow of its nodes on to the buckets of the nodes. However often a gram or a word occurs, a run of
texts or a bucket sends it once, so no task gets more than its share, and the number of buckets
follows the bytes of the texts.

In the graph of frequent edges unary paths are compacted by pointer doubling. The inner nodes of a
path occur only inside it, so only the nodes between paths are candidates for pairs.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.packs import pack, unpack
from tracemill.llm.words import mixed, portions
from tracemill.operators.skew import salted_join
from tracemill.session import written

#: Words of an edge.
WIDTH = 3
#: Occurrences of a candidate, the share of them inside a longer one that drops it (percent), and phrases per language.
LEAST, INSIDE, MOST = 10, 50, 2000
#: Bytes of texts that are taken apart at once, and per bucket.
RUN_BYTES, BUCKET_BYTES = 8_000_000, 16_000_000
#: Pieces into which the phrases of a language are cut before the last choice.
SALTS = 64

_PACKS = "lang string, width int, bucket long, gram string, n long, pack binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of some texts, and all words in order as codes, with -1 where a piece ends."""
    texts = texts.cast(pa.large_string())
    # A separator is never part of a word, so one of them can stand for all.
    closed = pc.binary_join_element_wise(texts, pa.scalar(".", texts.type), pa.scalar("", texts.type))
    apart = pc.replace_substring_regex(closed, r"[.,;:!?\x0A-\x0D]", " . ")
    coded = pc.ascii_split_whitespace(apart).flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    new = np.arange(len(words))
    for mark, value in (("", -2), (".", -1)):
        at = pc.index(words, pa.scalar(mark, words.type)).as_py()
        if at >= 0:
            new[at] = value
    real = new >= 0
    # Only distinct words are lower-cased, A-Z alone.
    kept = words.filter(pa.array(real)).to_pylist()
    lower = pa.array([word.lower() if word.isascii() else word.encode().lower().decode() for word in kept], pa.string()).dictionary_encode()
    new[real] = lower.indices.to_numpy(zero_copy_only=False)
    code = new[code]
    return lower.dictionary, code[code != -2]


def _summed(columns: list[np.ndarray], n: np.ndarray, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of codes in ascending order, and the sums of n over each."""
    if not len(n):
        return columns, n
    key, kinds = columns[0], max(words, 1)
    for column in columns[1:]:
        if kinds > (1 << 62) // max(words, 1):
            distinct, key = np.unique(key, return_inverse=True)
            kinds = len(distinct)
        key, kinds = key * words + column, kinds * words
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [column[order[first]] for column in columns], np.add.reduceat(n[order], first)


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(word) for word in words.to_pylist()), np.uint64, len(words))


def _packs(lang, words: pa.Array, hashes: np.ndarray, columns: list[np.ndarray], n: np.ndarray, buckets: int):
    """Rows of packs of distinct grams, one for each bucket that has any."""
    if not len(n):
        return
    total = np.zeros(len(n), np.uint64)
    for column in columns:
        total = mixed(total * _ODD + hashes[column])
    bucket = ((total >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    rows = []
    for own in np.split(order, cuts):
        used, codes = np.unique(np.concatenate([column[own] for column in columns]), return_inverse=True)
        rows.append((int(bucket[own[0]]), pack(words.take(pa.array(used)), *codes.reshape(len(columns), -1), n[own])))
    k = len(rows)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * k, pa.string()), pa.array([len(columns)] * k, pa.int32()), pa.array([b for b, _ in rows], pa.int64()),
            pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.array([data for _, data in rows], pa.binary()),
        ],
        [field.split()[0] for field in _PACKS.split(", ")],
    )


def _edges(batches, buckets: int):
    """Packs of edges of texts, of the last pair of each piece and of its last word."""
    for got in batches:
        for lang in pc.unique(got.column(0)).to_pylist():
            texts = got.column(1).filter(pc.equal(got.column(0), pa.scalar(lang, got.column(0).type)))
            for first, stop in portions(texts, RUN_BYTES):
                words, code = _pieces(texts.slice(first, stop - first))
                hashes = _hashes(words)
                ends = np.flatnonzero(code < 0)
                for width in range(1, WIDTH + 1):
                    if width < WIDTH:  # the last words of pieces that have as many
                        at = ends[ends >= width] - width
                    else:
                        at = np.arange(len(code) - width + 1)
                    columns = [code[at + i] for i in range(width)]
                    whole = np.logical_and.reduce([column >= 0 for column in columns])
                    columns = [column[whole] for column in columns]
                    yield from _packs(lang, words, hashes, *_summed(columns, np.ones(whole.sum(), np.int64), len(words)), buckets)


def _bucket(table: pa.Table, width: int, least: int, buckets: int) -> pa.Table:
    """A bucket's grams of this width: the frequent ones as rows, and packs of the flow of their first words.

    Packs of smaller widths are summed and sent on. The words' own bucket gives their total, with no gram.
    """
    lang, own = table["lang"][0].as_py(), table["width"][0].as_py()
    read = [unpack(data) for data in table["pack"].to_pylist()]
    coded = pa.chunked_array([found for found, _ in read]).combine_chunks().dictionary_encode()
    words, new = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum([0] + [len(found) for found, _ in read])
    columns = [np.concatenate([new[a + arrays[i]] for a, (_, arrays) in zip(at, read)]) for i in range(own)]
    n = np.concatenate([arrays[-1] for _, arrays in read])
    columns, n = _summed(columns, n, len(words))
    out = []
    if own == width:
        often = n >= least
        gram = pc.binary_join_element_wise(*[words.take(pa.array(column[often])) for column in columns], " ")
        count = n[often]
        if width == 1:
            gram, count = pa.concat_arrays([gram, pa.nulls(1, pa.string())]), np.append(count, n.sum())
        k = len(count)
        out.append(pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * k, pa.string()), pa.array([own] * k, pa.int32()), pa.nulls(k, pa.int64()), gram, pa.array(count, pa.int64()),
                pa.nulls(k, pa.binary()),
            ],
            table.schema.names,
        ))
        columns = columns[:-1]
        if columns:
            columns, n = _summed(columns, n, len(words))
    if columns:
        out += _packs(lang, words, _hashes(words), columns, n, buckets)
    return pa.Table.from_batches(out)


def _of_width(width: int, least: int, buckets: int):
    def task(table: pa.Table) -> pa.Table:
        return _bucket(table, width, least, buckets)

    return task


def counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(lang, width, gram, n): grams of one to three words that occur least times or more in pieces, and with a null gram parts of the number of words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = size // bucket_bytes + 1
    packs, found = rows.mapInArrow(partial(_edges, buckets=buckets), _PACKS), None
    for width in range(WIDTH, 0, -1):
        done = written(packs.groupBy("lang", "width", "bucket").applyInArrow(_of_width(width, least, buckets), _PACKS), f"grams-{width}")
        own = done.where("n IS NOT NULL").select("lang", "width", "gram", "n")
        packs, found = done.where("n IS NULL"), own if found is None else found.unionByName(own)
    return found


def graph(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frequent edges (lang, gram, tail, head, n) and their nodes (lang, node, f, into, out, before, after, most).

    tail and head are the pairs that an edge leads from and to. A node has its count f, the numbers
    of its frequent edges in and out, one of each where there is one only, and the largest of their weights.
    """
    words = F.split("gram", " ")
    edges = grams.where(f"width = {WIDTH} AND gram IS NOT NULL").select(
        "lang", "gram", F.concat_ws(" ", words[0], words[1]).alias("tail"), F.concat_ws(" ", words[1], words[2]).alias("head"), "n"
    )
    ends = edges.select("lang", F.inline(F.array(
        F.struct(F.col("tail").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out"), F.lit(None).cast("string").alias("before"), F.col("gram").alias("after"), F.col("n").alias("n")),
        F.struct(F.col("head").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out"), F.col("gram").alias("before"), F.lit(None).cast("string").alias("after"), F.col("n").alias("n")),
    )))
    around = ends.groupBy("lang", "node").agg(
        F.sum("into").alias("into"), F.sum("out").alias("out"), F.min("before").alias("before"), F.min("after").alias("after"),
        F.max("n").alias("most"), F.min("n").alias("fewest"),
    )
    nodes = grams.where("width = 2").select("lang", F.col("gram").alias("node"), F.col("n").alias("f")).join(around, ["lang", "node"], "left")
    return edges, nodes.withColumn("inner", F.coalesce(F.expr("into = 1 AND out = 1 AND most = f AND fewest = f"), F.lit(False)))


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, gram, n, path, place): the compacted graph; path is the first gram of the edge's path and place its distance from there.

    Pointers to the edge before double their reach each round. A path that is a cycle begins at its
    smallest gram. The rounds are as many as the logarithm of the longest path; each is written.
    """
    inner = nodes.where("inner")
    links = inner.select("lang", F.col("after").alias("gram"), F.col("before").alias("to"))
    state = edges.select("lang", "gram", "n").join(links, ["lang", "gram"], "left")
    done = written(state.where("to IS NULL").select("lang", "gram", "n", F.col("gram").alias("path"), F.lit(0).cast("long").alias("place")), "path-heads")
    links = written(state.where("to IS NOT NULL"), "path-links")
    parts = [done]
    while (left := links.count()) > 0:
        open_ = links.withColumn("by", F.lit(1).cast("long")).withColumn("least", F.least("gram", "to"))
        heads = parts[-1]
        for _ in range(math.ceil(math.log2(left + 1)) + 1):
            ahead = heads.select("lang", F.col("gram").alias("to"), F.col("path").alias("to_path"), F.col("place").alias("to_place"))
            further = open_.select("lang", F.col("gram").alias("to"), F.col("to").alias("to_to"), F.col("by").alias("to_by"), F.col("least").alias("to_least"))
            joined = written(open_.join(ahead, ["lang", "to"], "left").join(further, ["lang", "to"], "left"), "path-round")
            reached = joined.where("to_path IS NOT NULL").select("lang", "gram", "n", F.col("to_path").alias("path"), (F.col("to_place") + F.col("by")).alias("place"))
            heads = heads.unionByName(reached)
            parts.append(reached)
            open_ = joined.where("to_path IS NULL").select(
                "lang", "gram", "n", F.col("to_to").alias("to"), (F.col("by") + F.col("to_by")).alias("by"), F.least("least", "to_least").alias("least")
            )
            if open_.isEmpty():
                return _all(parts)
        # Only cycles are left, and every edge on one knows its smallest gram: cut there and go round once more.
        first = open_.where("gram = least").select("lang", "gram", "n", F.col("gram").alias("path"), F.lit(0).cast("long").alias("place"))
        parts.append(written(first, "path-heads"))
        rest = open_.where("gram <> least").select("lang", "gram")
        links = written(links.join(rest, ["lang", "gram"], "left_semi"), "path-links")
    return _all(parts)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _score(a: str, l: str, r: str):
    """floor(1000000 * a * a / (l * r)) in whole numbers of up to 38 digits."""
    wide = lambda c: f"CAST({c} AS DECIMAL(16, 0))"
    return F.expr(f"(1000000 * {wide(a)} * {wide(a)}) DIV ({wide(l)} * {wide(r)})")


#: The parts of a phrase at its one or two cuts.
_PARTS = """filter(array(
  struct('l1' AS role, substring_index(phrase, ' ', 1) AS gram),
  struct('r1' AS role, substr(phrase, locate(' ', phrase) + 1) AS gram),
  struct('l2' AS role, IF(size(split(phrase, ' ')) = 3, substring_index(phrase, ' ', 2), NULL) AS gram),
  struct('r2' AS role, IF(size(split(phrase, ' ')) = 3, substring_index(phrase, ' ', -1), NULL) AS gram)), x -> x.gram IS NOT NULL)"""


def phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, inside: int = INSIDE, most: int = MOST, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Per language the strongest phrases of two or three words: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
    ``[^\\x20\\x09]+``. a is the count of the phrase, l and r those of its parts at the cut with the
    lowest score floor(1000000 * a * a / (l * r)), n the number of words of the language. A pair goes
    when inside percent of its occurrences or more lie in one three-word phrase.

    Defined cases: a null or empty text has no words; a null language is und; every row counts, with
    or without an id, repeated ones too; ties of score and count go by phrase, in UTF-8 byte order; an
    empty table gives no rows. Other columns are not read.
    """
    grams = counts(docs, least, text_col, lang_col, bucket_bytes)
    total = grams.where("width = 1 AND gram IS NULL").groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("n"))
    edges, nodes = graph(grams)
    nodes = written(nodes, "nodes")
    chains = paths(edges, nodes)
    # A pair inside a path has all its occurrences in longer candidates.
    apart = ~F.col("inner") & (F.coalesce(100 * F.col("most"), F.lit(0)) < inside * F.col("f"))
    pairs = nodes.where(apart).select("lang", F.col("node").alias("phrase"), F.col("f").alias("a"))
    triples = chains.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"))
    candidates = written(pairs.unionByName(triples), "candidates")

    # The counts of all parts in one join; a part as common as the commonest word may be in many phrases.
    parts = candidates.select("lang", "phrase", "a", F.explode(F.expr(_PARTS)).alias("x")).select("lang", "phrase", "a", "x.role", "x.gram")
    shorter = grams.where("width < 3 AND gram IS NOT NULL").select("lang", "gram", F.col("n").alias("f"))
    known = salted_join(parts, shorter, ["lang", "gram"], ["lang", "phrase"], counted=parts.select("lang", "gram"))
    roles = [F.max(F.when(F.col("role") == role, F.col("f"))).alias(role) for role in ("l1", "r1", "l2", "r2")]
    scores = known.groupBy("lang", "phrase", "a").agg(*roles).withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    scored = scores.withColumn("second", F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))).select(
        "lang", "phrase", "a", F.expr("IF(second, l2, l1)").alias("l"), F.expr("IF(second, r2, r1)").alias("r"), F.expr("IF(second, s2, s1)").alias("score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    piece = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = scored.withColumn("piece", piece).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*order))).where(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.join(total, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
