"""Token ids of whole texts inside Arrow tasks, through the tokenizers library.

Byte-level BPE never joins what lies before a single space and what follows it, when both
neighbours of that space are not white space. Texts are therefore cut there, unless they hold an
added token of the tokenizer, which the library finds first: these go to it whole. Equal pieces
are looked up once per run of texts, as Arrow strings, among those that came before. Of the others,
those of Latin letters, digits and ASCII marks are told apart as the tokenizer's pattern does it, and each
new part goes to its BPE model directly. The rest goes to the library in lines of pieces with single spaces
between them. Only the first token of such a piece begins with the byte letter of a space, which tells the
pieces of a line apart again. The ids equal those of the whole text.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracemill.llm.words import FORGET, release_memory

#: Pieces that a Python worker remembers, about 50 MB. Once they are more, those that the last texts did not hold go.
KNOWN_PIECES = 1_000_000
#: Pieces of more bytes are encoded each time and not kept.
LONGEST_KNOWN = 48
#: Bytes of texts that are tokenized at once, and bytes of a line (a longer piece ends its line).
BYTES_AT_ONCE, LINE = 12_000_000, 10_000

#: White space, for Arrow's expressions. Each text that has it next to a space is cut in Python.
_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BY_A_SPACE = f" {_SPACES}|{_SPACES} "
#: Pieces that stand in no line: of more than one word, empty, or with white space at an end.
_ALONE = f"^$|^{_SPACES}| |{_SPACES}$"
_CUT = re.compile(r"(?<=\S) (?=\S)")

#: Characters that the pattern of byte-level BPE keeps together whatever its version of Unicode. An apostrophe may begin a part of its own.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"
_PART = rf"[{_LETTERS}]+|[0-9]+|[{_MARKS}]+"
#: Pieces that are one part, and those of several, on lines one below the other.
_ONE = rf"^(?: ?(?:{_PART})| \n)$"
_SEVERAL = rf"^[{_LETTERS}0-9{_MARKS}](?:\n?[{_LETTERS}0-9{_MARKS}])+$"
_PARTS = re.compile(rf" ?(?:{_PART})|\n")

_ID = attrgetter("id")

_ENCODERS: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: its own, or the next from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()  # a tenth of the time of to_pylist


def _other_form(piece: str) -> str:
    """The text that a piece stands for, and the piece that stands for a text."""
    return piece[1:] if piece[:1] == " " else " " + piece


def _runs(ids: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ids one after the other."""
    at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return ids[at]


class Encoder:
    """Encodes texts to unsigned 32-bit ids.

    A piece that starts with a space stands for the text after that space (the first piece of a
    text); any other piece stands for itself with a space before it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.added = [x["content"] for x in made.get("added_tokens") or [] if x["content"]]
        before = made.get("pre_tokenizer") or {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.byte_level = (
            made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True
            and before.get("add_prefix_space") is False and not made["model"].get("continuing_subword_prefix")
            and not made["model"].get("ignore_merges") and "Ġ" in vocabulary
        )
        # Lines bring pieces of several texts together, where no added token is to be found.
        self.lines = Tokenizer(self.tokenizer.model)
        self.lines.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.after_space = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.after_space[[k for word, k in vocabulary.items() if word[:1] == "Ġ"]] = True
        self.letters = _byte_letters()
        self.known = pa.array([], pa.large_string())
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def whole(self, text: str) -> bytes:
        """Ids of one text without any cutting."""
        return np.array(self.tokenizer.encode(text, None, False, False).ids, "<u4").tobytes()

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(self.tokenizer.encode(text, None, False, False).ids, np.uint32) for text in texts]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _line(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.lines.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        begins = np.flatnonzero(self.after_space[ids])
        if len(begins) != len(words):  # not with a vocabulary that holds all byte letters
            return self._one_by_one([" " + word for word in words])
        return ids, np.diff(begins, append=len(ids))

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of one part."""
        spelt = "\0".join(map(_other_form, parts)).encode().decode("latin-1").translate(self.letters)
        found = list(map(self.tokenizer.model.tokenize, spelt.split(self.letters[0])))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(map(_ID, chain.from_iterable(found)), np.uint32, int(sizes.sum())), sizes

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Add pieces with their ids to the known ones. Where each of them lies there."""
        place = np.empty(len(pieces), np.int64)

        def add(at, found):
            place[at] = np.arange(len(self.known), len(self.known) + len(at))
            self.known = pa.concat_arrays([self.known, pieces.take(pa.array(at))])
            self.ids, self.sizes = (np.concatenate([own, *more]) for own, more in zip((self.ids, self.sizes), zip(*found)))

        one, several, alone = (pc.match_substring_regex(pieces, x).to_numpy(zero_copy_only=False) for x in (_ONE, _SEVERAL, _ALONE))
        size = pc.binary_length(pieces).to_numpy() + 1
        several &= ~one
        alone &= ~one
        for own, ids_of in ((one, self._parts), (~(one | several | alone), self._line)):
            if len(at := np.flatnonzero(own)):
                words, line = _strings(pieces.take(pa.array(at))), np.cumsum(size[at]) // LINE
                cuts = [0, *(np.flatnonzero(np.diff(line)) + 1).tolist(), len(words)]
                add(at, [ids_of(words[a:b]) for a, b in zip(cuts, cuts[1:])])
        if len(at := np.flatnonzero(alone)):
            add(at, [self._one_by_one([_other_form(x) for x in _strings(pieces.take(pa.array(at)))])])
        if len(at := np.flatnonzero(several)):
            words = _strings(pieces.take(pa.array(at)))
            parts = pa.array(_PARTS.findall(" " + " ".join(words)), pa.large_string())
            first = np.flatnonzero(pc.starts_with(parts, " ").to_numpy(zero_copy_only=False))
            coded = parts.dictionary_encode()
            own = self._places(pa.array(list(map(_other_form, _strings(coded.dictionary))), pa.large_string()))[coded.indices.to_numpy()]
            start, sizes = (np.cumsum(self.sizes) - self.sizes)[own], self.sizes[own]
            add(at, [(_runs(self.ids, start, sizes), np.add.reduceat(sizes, first))])
        return place

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where each of these different pieces lies among the known ones."""
        found = pc.index_in(pieces, value_set=self.known)
        place = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            place[place < 0] = self._learn(pieces.filter(found.is_null()))
        return place

    def _forget(self, used: np.ndarray) -> None:
        """Drop long pieces and, if there are too many, those that are not used."""
        kept = pc.less_equal(pc.binary_length(self.known), LONGEST_KNOWN).to_numpy(zero_copy_only=False)
        if len(kept) > KNOWN_PIECES:
            now = np.zeros(len(kept), bool)
            now[used] = True
            kept &= now
        if not kept.all():
            self.known, self.ids, self.sizes = self.known.filter(pa.array(kept)), self.ids[np.repeat(kept, self.sizes)], self.sizes[kept]

    def _pieces(self, texts: pa.Array) -> pa.Array:
        """A list of pieces for each text, one at least."""
        holds = np.zeros(len(texts), bool)
        for mark in self.added:
            holds |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        odd = holds | pc.match_substring_regex(texts, _BY_A_SPACE).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(odd)
        if not len(at):
            return pc.split_pattern(texts, " ")
        cut = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        own = [[text] if added else _CUT.split(text) for text, added in zip(texts.take(pa.array(at)).to_pylist(), holds[at])]
        order = np.arange(len(texts))
        order[at] = len(texts) + np.arange(len(at))
        return pa.concat_arrays([cut, pa.array(own, cut.type)]).take(pa.array(order))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins (and the last one ends)."""
        texts = texts.cast(pa.large_string())
        if not self.byte_level:  # another kind of tokenizer may join across spaces
            ids, sizes = self._one_by_one(texts.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        cut = self._pieces(texts)
        begins = cut.offsets.to_numpy().astype(np.int64)
        begins -= begins[0]
        flat, first = cut.flatten(), np.zeros(begins[-1], bool)
        first[begins[:-1]] = True  # no space lies before the first piece of a text
        coded = pc.replace_with_mask(flat, pa.array(first), pc.binary_replace_slice(flat.filter(pa.array(first)), 0, 0, " ")).dictionary_encode()
        place, word = self._places(coded.dictionary), coded.indices.to_numpy()
        start, sizes = (np.cumsum(self.sizes) - self.sizes)[place], self.sizes[place][word]
        ids = _runs(self.ids, start[word], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        self._forget(place)
        return ids, ends[begins]


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Other work in the same Python worker frees the tokenizers and their caches.
FORGET.append(_ENCODERS.clear)


def encoded(texts: pa.Array, tokens: Encoder, most: int = BYTES_AT_ONCE):
    """For runs of texts of about so many bytes: the position of the first, the ids, where each text begins."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    start = 0
    while start < len(texts):
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + most)))
        yield start, *tokens.encode(texts.slice(start, stop - start))
        release_memory()
        start = stop
