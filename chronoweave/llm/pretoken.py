"""Byte-level pre-tokens of many texts at once, as the byte-level tokenizers' split pattern cuts them.

Texts of ASCII and Latin letters are cut by array arithmetic on their bytes. Any other text is cut by the pattern
itself. Both give the same pieces, and the pieces of a text always cover all of its bytes.
"""

from __future__ import annotations

import json

import numpy as np
import regex

from chronoweave.llm.textbytes import span_hashes

#: Fixed value: the split pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPACE, _LETTER, _DIGIT, _OTHER, _RARE = range(5)
_CLASS = np.full(256, _RARE, np.uint8)
_CLASS[:128] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[28:32] = _RARE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[0x80:0xC0] = _LETTER  # continuation bytes; a rare lead byte marks the text
_CLASS[0xC3:0xC6] = _LETTER  # the leads of U+00C0 to U+017F: letters but for two signs

_ONE = np.zeros(256, bool)
_ONE[[ord(c) for c in "stmd"]] = True


class Splitter:
    """Cuts texts into pre-tokens; ``specials`` maps strings that stand for one token to their ids."""

    def __init__(self, specials: dict[str, int]):
        self.specials = specials
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.marks = sorted({s.encode()[:2] for s in specials})

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
        """(piece starts, piece ends, bounds of each text in the piece list, byte position -> id of special strings)."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), {}
        kind = _CLASS[data]
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        opens = np.zeros(n + 1, bool)
        opens[filled] = True
        opens[n] = True
        before = np.empty(n, np.uint8)
        before[1:] = kind[:-1]
        before[opens[:n]] = 9
        after = np.empty(n, np.uint8)
        after[:-1] = kind[1:]
        after[opens[1:]] = 9
        blank = np.zeros(n, bool)  # the byte before is a space of the same text
        blank[1:] = data[:-1] == 32
        blank[opens[:n]] = False
        space = kind == _SPACE
        start = np.where(space, (before != _SPACE) | ((after != _SPACE) & (after != 9)), (kind != before) & ~blank)
        start[opens[:n]] = True
        self._contractions(data, before, after, blank, opens, kind, start)

        odd = kind == _RARE
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        for mark in self.marks:
            hit = data[:-1] == mark[0]
            if len(mark) > 1:
                hit = hit & (data[1:] == mark[1])
            odd[:-1] |= hit
        special: dict[int, int] = {}
        for d in np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1):
            self._by_pattern(data, int(offsets[d]), int(offsets[d + 1]), start, special)
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets), special

    @staticmethod
    def _contractions(data, before, after, blank, opens, kind, start) -> None:
        n = len(data)
        at = np.flatnonzero((data == 39) & (before != _OTHER) & ~blank & (after == _LETTER))
        if not len(at):
            return
        one = at[_ONE[data[at + 1]]]
        two = at[at + 2 < n]
        two = two[~opens[two + 2]]
        a, b = data[two + 1], data[two + 2]
        two = two[((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108))]
        for hits, size in ((one, 2), (two, 3)):
            start[hits + 1] = False
            rest = hits[hits + size < n] + size
            rest = rest[~opens[rest] & (kind[rest] == _LETTER)]
            start[rest] = True

    def _by_pattern(self, data, low: int, high: int, start, special: dict[int, int]) -> None:
        text = data[low:high].tobytes().decode("utf-8", "replace")
        widths = np.ones(len(text), np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        for edge in (0x80, 0x800, 0x10000):
            widths += points >= edge
        place = np.concatenate([[0], np.cumsum(widths)]) + low
        start[low:high] = False
        spots: list[int] = []
        at = 0
        for hit in self.special.finditer(text) if self.special else ():
            spots += [at + m.start() for m in self.pattern.finditer(text[at : hit.start()])]
            spots.append(hit.start())
            special[int(place[hit.start()])] = self.specials[hit.group()]
            at = hit.end()
        spots += [at + m.start() for m in self.pattern.finditer(text[at:])]
        start[place[spots]] = True


class WordTable:
    """A bounded table from piece hashes to short integer lists, kept by a Python worker between batches."""

    def __init__(self, most: int = 2_000_000):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.where = [np.zeros(1, np.int64)]
        self.flat: list[np.ndarray] = [np.zeros(0, np.uint32)]
        self.used = self.size = 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted ``keys`` the table lacks; makes room for them."""
        if len(self.keys) + len(keys) > self.most:
            self._clear()
        if not len(self.keys):
            return np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] != keys

    def add(self, keys: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slots = np.insert(self.slots, at, np.arange(self.size, self.size + len(keys)))
        self.where.append(self.used + np.cumsum(lengths))
        self.flat.append(flat.astype(np.uint32))
        self.used += int(lengths.sum())
        self.size += len(keys)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        return self.slots[np.searchsorted(self.keys, keys)]

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, values) of all lists."""
        if len(self.where) > 1:
            self.where = [np.concatenate(self.where)]
            self.flat = [np.concatenate(self.flat)]
        return self.where[0], self.flat[0]


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct piece hashes, index of one piece of each, place of each piece among them)."""
    keys, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return keys, first, inverse


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def load_vocabulary(path: str) -> tuple[str, dict[str, int]]:
    """The text of a byte-level ``tokenizers`` file and its special strings with their ids; read on the driver."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return text, {t["content"]: t["id"] for t in json.loads(text)["added_tokens"]}
