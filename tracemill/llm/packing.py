"""Packing of documents into token windows by order-preserving dynamic programming.

Documents are sorted by id over range partitions and tokenized there; each partition is one
stream of ids in which every document ends with an end id. Cuts are allowed between documents
(free), after sentences (a penalty) and, inside runs of ids without either, at fixed steps (a
larger penalty). Over these places the program minimises padding plus penalties: the best
predecessor of a place lies in a sliding window, so a queue of candidates whose cost rises
gives it in constant time. Windows whose length is a power of two carry no padding and are
tried as transitions of their own.

A stream is solved in blocks; the last window of a block is not closed but begins the next one,
so only the end of a partition is padded beyond what the program chose.

Defined cases: null and empty texts hold the end id alone; repeated rows are packed each by
itself, ordered by text within an id; null ids come first; an empty table gives no pieces.
Texts are tokenized whole, whatever their length; columns besides id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.tokens import encoded, encoder

#: Cost of a cut after a sentence and of a cut elsewhere, in tokens of padding.
SENTENCE_CUT, HARD_CUT = 8, 64
#: Places for hard cuts are this many tokens apart, where nothing else allows a cut.
HARD_STEP = 512
#: Tokens of a stream that are solved at once.
BLOCK_TOKENS = 262_144

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
)


def padded(length: int, limit: int) -> int:
    """Tokens that a window of this length takes: its own number at a power of two, else the limit."""
    return length if length & (length - 1) == 0 else limit


def choose_cuts(places: list[int], penalties: list[int], limit: int) -> list[int]:
    """Indexes of the chosen places, first and last included, at the least padding plus penalties.

    places rise, start at 0 and are at most limit apart; the last one ends the stream.
    """
    index = {place: k for k, place in enumerate(places)}
    powers = [1 << k for k in range(limit.bit_length()) if 1 << k < limit]
    cost, back = [0] * len(places), [0] * len(places)
    queue: deque[int] = deque([0])
    keys = [0] * len(places)  # cost + place: what a later place pays for coming from here, but for its own share
    for j in range(1, len(places)):
        place = places[j]
        while place - places[queue[0]] > limit:
            queue.popleft()
        i = queue[0]
        best = keys[i] + limit - place
        for power in powers:
            k = index.get(place - power)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        cost[j] = best + penalties[j]
        back[j] = i
        keys[j] = key = cost[j] + place
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    chosen = [len(places) - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


class _Stream:
    """The ids of a partition that are not packed yet, with their documents and places for cuts."""

    def __init__(self, limit: int, first_sequence: int):
        self.limit, self.sequence = limit, first_sequence
        self.docs: list[list] = []  # id, ids, sentence ends, start of the part still to pack
        self.held = 0

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append([doc_id, ids, ends, 0])
        self.held += len(ids)

    def _places(self) -> tuple[list[int], list[int]]:
        found, base = [np.zeros((1, 2), np.int64)], 0
        for _, ids, ends, start in self.docs:
            inner = ends[(ends > start) & (ends < len(ids))] - start + base
            last = base + len(ids) - start
            found += [np.stack([inner, np.full(len(inner), SENTENCE_CUT)], 1), np.array([[last, 0]])]
            base = last
        at = np.concatenate(found)
        step = min(HARD_STEP, self.limit)
        gaps = np.flatnonzero(np.diff(at[:, 0]) > step)
        if len(gaps):
            hard = np.concatenate([np.arange(at[k, 0] + step, at[k + 1, 0], step) for k in gaps])
            at = np.concatenate([at, np.stack([hard, np.full(len(hard), HARD_CUT)], 1)])
            at = at[np.argsort(at[:, 0], kind="stable")]
        return at[:, 0].tolist(), at[:, 1].tolist()

    def pack(self, last: bool):
        """Rows of closed windows; all windows at the end of the stream, else all but the last."""
        if not self.held:
            return
        places, penalties = self._places()
        cuts = [places[k] for k in choose_cuts(places, penalties, self.limit)]
        if not last:
            cuts = cuts[:-1]
        at, k = 0, 0
        for begin, end in zip(cuts, cuts[1:]):
            while at < end:
                doc = self.docs[k]
                take = min(len(doc[1]) - doc[3], end - at)
                part = doc[1][doc[3] : doc[3] + take]
                yield (doc[0], doc[3], take, zlib.crc32(part), len(doc[1]), self.sequence, at - begin, end - begin)
                doc[3] += take
                at += take
                k += doc[3] == len(doc[1])
            self.sequence += 1
        self.docs = self.docs[k:]
        self.held -= at


def pack(
    docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece of a document: where it lies in its document and in which window.

    sequence_id is the number of the range partition times 2^32 plus the number of the window in it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def pieces(batches):
        tokens = encoder(tokenizer)
        vocabulary = tokens.tokenizer.get_vocab()
        is_end, is_line, is_start = (np.zeros(max(vocabulary.values(), default=0) + 1, bool) for _ in range(3))
        for word, k in vocabulary.items():  # Ċ and Ġ are the byte letters of a newline and a space
            is_end[k], is_line[k], is_start[k] = word[-1] in ".!?", word[-1] == "Ċ", word[0] in "ĠĊ"
        stream = _Stream(limit, TaskContext.get().partitionId() << 32)

        def batch(rows):
            columns = list(zip(*rows)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split(" ")[0] for x in PIECES.split(", ")])

        for got in batches:
            doc_ids = got.column(0).to_pylist()
            for first, ids, begins in encoded(got.column(1), tokens):
                rows = []
                for doc_id, a, b in zip(doc_ids[first:], begins[:-1].tolist(), begins[1:].tolist()):
                    own = ids[a:b]
                    ends = np.flatnonzero(is_line[own[:-1]] | is_end[own[:-1]] & is_start[own[1:]]) + 1
                    stream.add(doc_id, np.append(own, np.uint32(end_id)).astype("<u4"), ends)
                    if stream.held >= block_tokens:
                        rows += stream.pack(False)
                yield batch(rows)
        yield batch(list(stream.pack(True)))

    return rows.mapInArrow(pieces, PIECES)
