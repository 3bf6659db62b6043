"""Words and word shingles of whole texts as 64-bit hashes, for Arrow tasks.

Hashes of words come from xxhash; those of shingles mix the hashes of their words by position.
Two different shingles share a hash with probability 2^-64; the operators treat equal hashes as
equal shingles.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of texts that are taken apart at once.
BYTES_AT_ONCE = 4_000_000


_LIBC = ctypes.CDLL(None) if sys.platform.startswith("linux") else None


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: Functions that drop what another operator has cached in this Python worker.
FORGET: list[Callable[[], None]] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which all bits depend on all bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Multipliers by position in a shingle: odd numbers from the mixer.
_POSITION = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def portions(texts: pa.Array, most: int = BYTES_AT_ONCE):
    """(first, stop) of runs of texts of about so many bytes. What a worker has cached for other work is dropped."""
    for forget in FORGET:
        forget()
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    first = 0
    while first < len(texts):
        before = size[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(size, before + most)))
        yield first, stop
        release_memory()
        first = stop


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and where each text begins; A-Z lower-cased on request."""
    texts = texts.cast(pa.large_string())
    cut = pc.ascii_split_whitespace(texts)
    begins = cut.offsets.to_numpy().astype(np.int64)
    begins -= begins[0]
    coded = cut.flatten().dictionary_encode()
    keys, word = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    raw = [key.encode().lower() for key in keys] if lower else keys  # bytes change A-Z only
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
    if "" in keys:  # before the first and after the last word of a text
        real = word != keys.index("")
        begins = np.concatenate([[0], np.cumsum(real)])[begins]
        word = word[real]
    return hashes[word], begins


def shingles(words: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words in order, and where each text begins.

    A text of fewer words has one shingle of all of them; one without words has none.
    """
    counts = np.diff(begins)
    n = len(words)
    total = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        total += words[i : n - k + 1 + i] * _POSITION[i] if n >= k else total
    own = np.maximum(counts - k + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(own)])
    out = np.zeros(starts[-1], np.uint64)
    text = np.repeat(np.arange(len(counts)), own)
    at = begins[:-1][text] + np.arange(len(out)) - starts[:-1][text]
    long = (counts >= k)[text]
    out[long] = mixed(total[at[long]])
    for j in np.flatnonzero((counts < k) & (counts > 0)):
        part = words[begins[j] : begins[j + 1]]
        out[starts[j]] = mixed((part * _POSITION[: len(part)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(part)))[0]
    return out, starts


def distinct(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, sorted, and where each text begins."""
    parts = [np.unique(values[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts) if parts else values[:0], np.concatenate([[0], np.cumsum(sizes)])
