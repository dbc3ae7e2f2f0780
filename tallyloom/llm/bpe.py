"""Byte-level BPE of a public vocabulary, by a segment tree over the ranks of adjacent pairs.

A word's bytes are the first symbols. The leaves of the tree hold the merge rank of each
symbol with its right neighbour; the root yields the leftmost pair of the lowest rank.
A merge changes three leaves at most, each a logarithmic update, until no pair is left
that can be merged. Words of one text repeat, so a worker keeps what it has encoded.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from itertools import chain

import regex

#: Where the vocabulary is unless told otherwise.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Words kept per worker before the memory is cleared.
KEPT_WORDS = 400_000

# Fixed value: how this vocabulary splits texts into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# The same split for texts in which letters, digits and blanks are what the faster module takes them for.
_FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ODD = frozenset("\x1c\x1d\x1e\x1f").union(chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl"))
_ODD_ASCII = re.compile("[\x1c-\x1f]")

# A blank amid white space: there alone a cut before a blank may differ from the split of the whole.
_BLANK_RUN = re.compile(r"\s \s")

NONE = 1 << 40


def split_words(text: str) -> list[str]:
    """The words whose bytes are merged separately."""
    odd = _ODD_ASCII.search(text) if text.isascii() else not _ODD.isdisjoint(text)
    return (WORDS if odd else _FAST).findall(text)


def split_chunks(text: str) -> list[str]:
    """Larger pieces that never cut a word: words always end before a blank that no white space surrounds."""
    if _BLANK_RUN.search(text):
        return split_words(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


class Vocabulary:
    """Merges and ids of a byte-level BPE file in the JSON form."""

    def __init__(self, source: str):
        model = json.loads(source)["model"]
        ids = model["vocab"]
        self.byte_ids = [ids[sign] for sign in _byte_signs()]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[left] << 20 | ids[right]] = (rank, ids[left + right])

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word."""
        symbols = [self.byte_ids[b] for b in word]
        n, merges = len(symbols), self.merges
        if n < 2:
            return tuple(symbols)
        width = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            found = merges.get(symbols[i] << 20 | symbols[i + 1])
            if found:
                tree[width + i] = found[0]
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, rank: int) -> None:
            at = width + leaf
            tree[at] = rank
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                low = a if a <= b else b
                if tree[at] == low:
                    break
                tree[at] = low
                at >>= 1

        while tree[1] < NONE:
            low, at = tree[1], 1
            while at < width:
                at *= 2
                if tree[at] != low:
                    at += 1
            i = at - width
            j = after[i]
            symbols[i] = merges[symbols[i] << 20 | symbols[j]][1]
            symbols[j] = -1
            nxt = after[i] = after[j]
            put(j, NONE)
            if nxt < n:
                before[nxt] = i
                found = merges.get(symbols[i] << 20 | symbols[nxt])
                put(i, found[0] if found else NONE)
            else:
                put(i, NONE)
            prev = before[i]
            if prev >= 0:
                found = merges.get(symbols[prev] << 20 | symbols[i])
                put(prev, found[0] if found else NONE)
        return tuple(s for s in symbols if s >= 0)


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    signs, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in signs:
            signs[b] = chr(spare)
            spare += 1
    return [signs[b] for b in range(256)]


class Encoder(dict):
    """Word or larger piece -> ids, filled as they come."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        words = split_words(piece)
        if len(words) > 1:
            ids = tuple(chain.from_iterable(map(self.__getitem__, words)))
        else:
            ids = self.vocabulary.encode_word(piece.encode("utf-8", "replace"))
        if len(piece) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and empty texts."""
        return list(chain.from_iterable(map(self.__getitem__, split_chunks(text)))) if text else []

    def count(self, text: str | None) -> int:
        """How many ids a text has."""
        return sum(map(len, map(self.__getitem__, split_chunks(text)))) if text else 0


_encoders: dict[int, Encoder] = {}


def encoder_of(source: str) -> Encoder:
    """The worker's encoder for a vocabulary file's text."""
    key = hash(source)
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary(source))
    return _encoders[key]
