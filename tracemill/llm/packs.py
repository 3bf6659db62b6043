"""Small packs of words and whole numbers that Arrow tasks send to each other as one binary value."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1, write_content_size=True), zstandard.ZstdDecompressor()


def _narrow(values: np.ndarray) -> np.ndarray:
    """The values, none below zero, in as few bytes as the largest needs."""
    most = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def pack(words: pa.Array, *arrays: np.ndarray) -> bytes:
    """Words without a blank, and arrays of numbers."""
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), " ")[0].as_py() if len(words) else ""
    text = joined.encode()
    narrow = [_narrow(values) for values in arrays]
    head = struct.pack(f"<IIB{'IB' * len(narrow)}", len(words), len(text), len(narrow), *(x for a in narrow for x in (len(a), a.itemsize)))
    return _ZIP.compress(b"".join([head, text, *(a.tobytes() for a in narrow)]))


def unpack(data: bytes) -> tuple[pa.Array, list[np.ndarray]]:
    """The words and the arrays, as 64-bit numbers."""
    raw = _UNZIP.decompress(data)
    words, size, k = struct.unpack_from("<IIB", raw)
    heads = struct.unpack_from(f"<{'IB' * k}", raw, 9)
    at = 9 + 5 * k
    text = pa.array([raw[at : at + size].decode()], pa.large_string())
    found = pc.split_pattern(text, " ").flatten() if words else pa.array([], pa.large_string())
    at += size
    arrays = []
    for length, width in zip(heads[::2], heads[1::2]):
        arrays.append(np.frombuffer(raw, f"<u{width}", length, at).astype(np.int64))
        at += length * width
    return found, arrays
