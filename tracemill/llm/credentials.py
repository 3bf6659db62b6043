"""Secrets in texts: assignments and tokens by their shape, keys and signed tokens by their structure.

A run of base64 or hex characters is no finding by itself. It is decoded, and only what parses is
reported: DER private keys whose nested lengths all agree (PKCS#1, PKCS#8, encrypted PKCS#8, SEC1),
OpenSSH private keys whose length-prefixed fields fill them, and signed tokens (JWS) whose header
names an algorithm, whose payload is a JSON object and whose signature has the algorithm's length. A
run that decodes to text is searched once more, so a key file inside base64 is found as well.

Texts are passed over in bulk first, by patterns that every finding matches; the few left are
taken apart one by one. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from functools import partial
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

from tracemill.llm.line_rules import fresh
from tracemill.llm.words import portions

#: Kinds in the order of ties: the base ones, then those that structure confirms.
KINDS = ("assign", "access", "hex", "key", "openssh", "jws")
#: Levels of text inside encoded text that are searched.
DEPTH = 2

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run is as long as it can be, so shorter ones are passed over
_HEX = re.compile(r"[0-9a-f]{16,}")

# What every finding matches, for the pass in bulk.
_MAYBE_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
_MAYBE_OTHER = r"AKIA[A-Z0-9]{14}|[0-9A-Fa-f]{16}|[A-Za-z0-9+/_-]{20}"

# A DER sequence begins with the byte 30; an OpenSSH key with its name; a JSON object with { and a blank, a quote or a brace.
_DER_64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n))M[A-P][A-Za-z0-9+/_-]{14}")
_SSH_64 = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\n))b3BlbnNzaC1rZXktdjEA")
_JWS = re.compile(r"(?<![A-Za-z0-9_.-])(e[yw][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,})")
_LONG_HEX = re.compile(r"[0-9A-Fa-f]{32,}")
_LONG_64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_GAP = re.compile(r"(?:\\r)?(?:\\n)?[\x09\x20\r\n]*")
_IN_LINE = re.compile(r"[A-Za-z0-9+/_-]+")

#: Bytes of a signature: fixed for HMAC and elliptic curves, at least that of a 1024-bit key for RSA.
_SIGNATURE = {
    "HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132),
    "EdDSA": (64, 114), "RS256": (128, 2048), "RS384": (128, 2048), "RS512": (128, 2048), "PS256": (128, 2048), "PS384": (128, 2048), "PS512": (128, 2048),
}


def _item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, first byte and end of the contents of the DER item at a place, if it ends by end."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size = int.from_bytes(data[at : at + n])
        if size < 128 or size >> (8 * (n - 1)) == 0:  # DER takes the shortest form
            return None
        at += n
    return (tag, at, at + size) if at + size <= end else None


def _items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The items that fill a range exactly."""
    found = []
    while at < end:
        item = _item(data, at, end)
        if item is None:
            return None
        found.append(item)
        at = item[2]
    return found


def der_key(data: bytes) -> bool:
    """Whether the bytes are one DER private key; every nested length has to fit."""
    outer = _item(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    parts = _items(data, outer[1], outer[2])
    if not parts:
        return False
    tags = [tag for tag, _, _ in parts]
    value = [data[a:b] for _, a, b in parts]
    if tags[0] == 0x02:
        if len(tags) >= 9 and set(tags[:9]) == {0x02} and value[0] in (b"\0", b"\1"):
            return len(value[1]) >= 32 and len(value[3]) >= 16  # PKCS#1: version, modulus, exponents, primes
        if tags[1:3] == [0x30, 0x04] and value[0] in (b"\0", b"\1"):  # PKCS#8: version, algorithm, key
            named = _items(data, parts[1][1], parts[1][2])
            inner = _item(value[2], 0, len(value[2]))
            return bool(named) and named[0][0] == 0x06 and inner is not None and inner[2] == len(value[2]) and inner[0] in (0x30, 0x04, 0x02)
        if value[0] == b"\1" and tags[1:2] == [0x04]:  # SEC1: version, key, [0] curve, [1] public key
            return 16 <= len(value[1]) <= 72 and all(
                tag in (0xA0, 0xA1) and _items(data, a, b) is not None for tag, a, b in parts[2:]
            )
        return False
    if tags == [0x30, 0x04]:  # encrypted PKCS#8: algorithm with parameters, ciphertext
        named = _items(data, parts[0][1], parts[0][2])
        return bool(named) and len(named) == 2 and named[0][0] == 0x06 and named[1][0] == 0x30 and len(value[1]) >= 16
    return False


def ssh_key(data: bytes) -> int:
    """Length of the OpenSSH private key that the bytes begin with, or 0."""
    name = b"openssh-key-v1\0"
    at = len(name)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4]) if at + 4 <= len(data) else len(data)
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if not data.startswith(name):
        return 0
    cipher, _, _ = field(), field(), field()
    if cipher is None or at + 4 > len(data):
        return 0
    keys, at = int.from_bytes(data[at : at + 4]), at + 4
    if not 1 <= keys <= 16 or any(not field() for _ in range(keys)):
        return 0
    secret = field()
    if not secret or len(secret) % 8 or (cipher == b"none" and secret[:4] != secret[4:8]):
        return 0
    return at


def _unwrapped(text: str, start: int, most: int) -> tuple[bytes, list[int]]:
    """Base64 from a place on, over line ends and escaped line ends: the bytes, and where in the text each character ends."""
    chars, ends, at = [], [], start
    while len(chars) < most and (run := _IN_LINE.match(text, at)):
        stop = min(run.end(), at + most - len(chars))
        chars += text[at:stop]
        ends += range(at + 1, stop + 1)
        gap = _GAP.match(text, stop)
        if stop < run.end() or gap.end() == stop:
            break
        at = gap.end()
    got = "".join(chars).replace("-", "+").replace("_", "/")
    return base64.b64decode(got + "A" * (-len(got) % 4)), ends


def _padded(text: str, end: int) -> int:
    """The end of a run with the = signs behind it."""
    return end + (2 if text.startswith("==", end) else text.startswith("=", end))


def _from_64(run: str) -> bytes:
    """The bytes of a run in either alphabet, padded or not."""
    run = run.rstrip("=").replace("+", "-").replace("/", "_")
    return base64.urlsafe_b64decode(run + "=" * (-len(run) % 4))


def _object(part: str):
    try:
        found = json.loads(_from_64(part))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_token(header: str, payload: str, signature: str) -> bool:
    """Whether three base64 parts are a signed token."""
    named = _object(header)
    limits = _SIGNATURE.get(named.get("alg")) if named and isinstance(named.get("alg"), str) else None
    size = len(signature) * 3 // 4
    return limits is not None and len(signature) % 4 != 1 and limits[0] <= size <= limits[1] and _object(payload) is not None


def confirmed(text: str, depth: int = DEPTH) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the keys and signed tokens in a text."""
    found = []
    for m in _JWS.finditer(text):
        if signed_token(*m.groups()):
            found.append((m.start(), m.end(), "jws"))
    for m in _DER_64.finditer(text):
        head, _ = _unwrapped(text, m.start(), 8)
        size = head[1] if head[1] < 0x80 else int.from_bytes(head[2 : 2 + (head[1] & 0x7F)])
        size += 2 + (head[1] & 0x7F if head[1] & 0x80 else 0)
        if not 30 <= size <= 1 << 16:
            continue
        chars = -(-size * 4 // 3)
        data, ends = _unwrapped(text, m.start(), chars)
        if len(ends) == chars and der_key(data[:size]):
            found.append((m.start(), _padded(text, ends[-1]), "key"))
    for m in _SSH_64.finditer(text):
        data, ends = _unwrapped(text, m.start(), 1 << 16)
        if size := ssh_key(data[: len(ends) * 3 // 4]):
            found.append((m.start(), _padded(text, ends[-(-size * 4 // 3) - 1]), "openssh"))
    taken = sorted(found)
    inside = lambda a, b: any(x < b and a < y for x, y, _ in taken)
    for pattern, decode in ((_LONG_HEX, bytes.fromhex), (_LONG_64, _from_64)):
        for m in pattern.finditer(text):
            if inside(*m.span()) or (pattern is _LONG_HEX and len(m[0]) % 2):
                continue
            try:
                data = decode(m[0])
            except (ValueError, binascii.Error):
                continue
            if pattern is _LONG_HEX and der_key(data):
                found.append((*m.span(), "key"))
            elif pattern is _LONG_HEX and ssh_key(data) == len(data):
                found.append((*m.span(), "openssh"))
            elif depth > 1:
                try:
                    inner = confirmed(data.decode(), depth - 1)
                except UnicodeDecodeError:
                    continue
                found += [(*m.span(), kind) for kind in dict.fromkeys(kind for _, _, kind in inner)]
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the assignments, access tokens and hex runs of a text, leftmost first and not overlapping per kind."""
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    return found + [(*m.span(), "hex") for m in _HEX.finditer(text)]


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _found(batches, at: int, names: list[str]):
    """The rows with their spans in four columns behind."""
    for got in batches:
        for first, stop in portions(got.column(at)):
            part = got.slice(first, stop - first)
            texts = part.column(at)
            maybe = pc.or_kleene(pc.match_substring_regex(texts, _MAYBE_ASSIGN), pc.match_substring_regex(texts, _MAYBE_OTHER))
            found = [[] for _ in range(len(texts))]
            for j in pc.indices_nonzero(pc.fill_null(maybe, False)).to_pylist():
                text = texts[j].as_py()
                found[j] = in_order(base_spans(text) + confirmed(text))
            offsets = pa.array(list(accumulate(map(len, found), initial=0)), pa.int32())
            flat = [span for own in found for span in own]
            columns = (
                pa.array([kind for _, _, kind in flat], pa.string()), pa.array([start for start, _, _ in flat], pa.int64()),
                pa.array([end for _, end, _ in flat], pa.int64()), pa.array([kind in KINDS[:3] for _, _, kind in flat], pa.bool_()),
            )
            lists = [pa.ListArray.from_arrays(offsets, c) for c in columns]
            yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, *names])


def spans(docs: DataFrame, text_col: str = "text", name: str = "secrets") -> DataFrame:
    """The rows with a column of structs (kind, start, end, base), by start and then kind.

    Places are code points, ends exclusive. base marks the kinds assign, access and hex, which are
    found by shape alone; key, openssh and jws are confirmed by decoding and parsing.

    Defined cases: a null or empty text has no spans; a span of equal kind, start and end counts
    once; every row is judged by itself, with or without an id; other columns come through, whatever
    their names; an empty table gives an empty one.
    """
    names = ["kind", "start", "end", "base"]
    types = [StringType(), LongType(), LongType(), BooleanType()]
    own = [fresh(f"_{x}", docs) for x in names]
    schema = StructType([*docs.schema.fields])
    for column, kind in zip(own, types):
        schema = schema.add(column, ArrayType(kind))
    marked = docs.mapInArrow(partial(_found, at=docs.columns.index(text_col), names=own), schema)
    pairs = F.arrays_zip(*[F.col(c).alias(n) for c, n in zip(own, names)])
    return marked.withColumn(fresh(name, docs), pairs).drop(*own)


def without(text: str, spans: list[tuple[int, int, str]], mark: str = "[{}]") -> str:
    """The text with each stretch covered by spans replaced by the kind of its first one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], mark.format(kind)]
        at = max(at, end)
    return "".join(out) + text[at:]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.concat_ws(",", F.transform(F.filter("secrets", lambda x: x["base"]), line))
    found = spans(rows, "text").select("doc_id", "secrets")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("secrets", line)).alias("spans"),
    )
