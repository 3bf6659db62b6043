"""Exact token counts of texts, through the tokenizers library inside Arrow batches.

Byte-level BPE never joins what lies before a single space and what follows it, when both neighbours
of that space are not white space. Texts are cut there, and a piece that comes again is not encoded
again. Texts with other white space by a space or an added token go to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

#: Bytes of texts that are counted at once, and pieces that a worker remembers.
BYTES_AT_ONCE, KNOWN_PIECES = 4_000_000, 500_000
#: Longer pieces are encoded each time.
LONGEST_KNOWN = 48

_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BY_A_SPACE = f" {_SPACES}|{_SPACES} "

_COUNTERS: dict[str, Counter] = {}


class Counter:
    """Counts tokens of texts; remembers those of pieces."""

    def __init__(self, tokenizer):
        self.tokenizer, self.known = tokenizer, {}
        made = json.loads(tokenizer.to_str())
        self.added = [x["content"] for x in made.get("added_tokens") or [] if x["content"]]
        before = made.get("pre_tokenizer") or {}
        self.byte_level = (
            made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True
            and before.get("add_prefix_space") is False
        )

    def _encoded(self, texts: list[str], special: bool = False) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=special)]

    def _after_a_space(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        found = list(map(self.known.get, words))
        new = [word for word, n in zip(words, found) if n is None]
        made = dict(zip(new, self._encoded([" " + word for word in new])))
        self.known.update((word, n) for word, n in made.items() if len(word) <= LONGEST_KNOWN)
        return np.array([made[word] if n is None else n for word, n in zip(words, found)], np.int64)

    def count(self, texts: pa.Array, special: bool = False) -> np.ndarray:
        """Number of tokens of each text."""
        texts = texts.cast(pa.large_string())
        if not len(texts) or special or not self.byte_level:
            return np.array(self._encoded(texts.to_pylist(), special), np.int64)
        odd = pc.match_substring_regex(texts, _BY_A_SPACE)
        for mark in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        cut = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        begins = cut.offsets.to_numpy().astype(np.int64)
        begins -= begins[0]
        coded = cut.flatten().dictionary_encode()
        words, word = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        counts = self._after_a_space(words)[word]
        counts[begins[:-1]] = self._encoded([words[k] for k in word[begins[:-1]]])  # the first piece has no space before it
        found = np.add.reduceat(counts, begins[:-1])
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        found[at] = self._encoded(texts.take(pa.array(at)).to_pylist())
        return found


def _counter(path: str) -> Counter:
    """The counter of this Python worker for a tokenizer file."""
    if path not in _COUNTERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _COUNTERS[path] = Counter(Tokenizer.from_file(path))
    return _COUNTERS[path]


def _runs(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about so many bytes."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + BYTES_AT_ONCE)))
        yield texts.slice(start, stop - start)
        start = stop


def token_count(text: Column, path: str, special: bool = False) -> Column:
    """Number of tokens of a text under the tokenizer in a file; 0 for a null.

    The file has to lie where every executor can read it. Each worker loads it once. Counting does
    not cut texts: a column of any length is counted whole.
    """

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(path)
        for texts in batches:
            runs = [counter.count(run, special) for run in _runs(texts.fill_null(""))]
            yield pa.array(np.concatenate(runs) if runs else [], pa.int64())

    # Else a filter on the count goes below it and counts a second time what it keeps.
    return count.asNondeterministic()(text)
