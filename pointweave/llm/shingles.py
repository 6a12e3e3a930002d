"""Word hashes and rolling hashes of word windows over many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORD_INVERSE = np.uint64(pow(int(_WORD), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Tokens:
    """Lower-cased words of several texts in a row: hashes, and where each text's words begin."""

    hash: np.ndarray
    text: np.ndarray  # index of the word's text
    first: np.ndarray  # by text, with the end behind the last

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every window of ``size`` words within one text, by a running polynomial sum."""
        n = len(self.hash) - size + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * powers(_WORD_INVERSE, len(self.hash)), out=sums[1:])
        rolled = (sums[size:] - sums[:n]) * powers(_WORD, n)
        start = np.flatnonzero(self.text[:n] == self.text[size - 1:])
        return start, mix(rolled[start])


def tokens(texts: list[bytes]) -> Tokens:
    """Words are runs of other bytes than ASCII white space; A-Z count as a-z."""
    raw = np.frombuffer(b" " + b" ".join(texts).lower() + b" ", np.uint8)
    space = _SPACE[raw]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, size = change[::2], change[1::2] - change[::2]
    inside = raw[~space].astype(np.uint64) + np.uint64(1)
    begin = np.r_[0, np.cumsum(size)[:-1]] if len(size) else np.zeros(0, np.int64)
    place = np.arange(len(inside)) - np.repeat(begin, size)
    values = inside * powers(_BYTE, int(size.max()) if len(size) else 1)[place]
    hashes = mix(np.add.reduceat(values, begin)) if len(size) else np.zeros(0, np.uint64)
    offset = np.cumsum([1, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, offset)
    return Tokens(hashes, np.repeat(np.arange(len(texts)), np.diff(first)), first)
