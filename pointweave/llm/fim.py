"""Fill-in-the-middle by a wavelet matrix over character classes.

The bytes of a slice of texts are classed: inside a character, a character inside a word, the first of a word, a
blank, a line feed. A wavelet matrix over the classes answers how many bytes of a class stand in front of any place;
sums of such ranks count the characters or words of a text, and bisection on them finds the byte at which a unit
begins. Both cuts of all texts of a slice are searched at once. The matrix takes about a byte for each byte of text.

No step shuffles: every text is cut where it was read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pointweave.llm.common import bytes_of, schema_with, sliced, with_columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED, SUFFIX_FIRST = 90, 20  # per cent of texts that are rearranged, and of those that begin with the suffix
INSIDE, INNER, FIRST, BLANK, FEED = range(5)  # classes of bytes
LEVELS = 3  # bits of a class
#: Classes whose bytes begin a unit.
UNITS = {"char": (INNER, FIRST, BLANK, FEED), "word": (FIRST,)}


def classes(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Class of every byte of UTF-8 texts in a row; ``begins`` are the places where texts begin."""
    blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    after = np.r_[True, blank[:-1]] if len(raw) else blank
    after[begins[begins < len(raw)]] = True
    code = np.where(after, FIRST, INNER).astype(np.uint8)
    code[blank] = BLANK
    code[raw == 0x0A] = FEED
    code[raw & 0xC0 == 0x80] = INSIDE
    return code


class WaveletMatrix:
    """Ranks of small codes: one bit vector for each bit, with a count of ones for each 64 bits."""

    def __init__(self, codes: np.ndarray, levels: int = LEVELS):
        self.rows = []
        for level in reversed(range(levels)):
            bit = (codes >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, "<u8")
            words.view(np.uint8)[:len(packed)] = packed
            ones = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
            self.rows.append((level, words, ones, len(bit) - int(ones[-1])))
            codes = np.concatenate([codes[~bit], codes[bit]])

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` codes are ``code``."""
        low, at = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for level, words, ones, zeros in self.rows:
            low, at = (self._step(i, words, ones, zeros, code >> level & 1) for i in (low, at))
        return at - low

    @staticmethod
    def _step(at, words, ones, zeros, bit):
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        one = ones[at >> 6] + np.bitwise_count(words[at >> 6] & mask)
        return zeros + one if bit else at - one


class Cutter:
    """Counts and places of units in a slice of texts."""

    def __init__(self, texts: list[bytes], unit: str):
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.ends - [len(t) for t in texts]
        self.matrix = WaveletMatrix(classes(np.frombuffer(b"".join(texts), np.uint8), self.starts))
        self.unit = unit

    def count(self, at: np.ndarray, unit: str | None = None) -> np.ndarray:
        """Units that begin before each place."""
        return sum(self.matrix.rank(c, at) for c in UNITS[unit or self.unit])

    def sizes(self) -> np.ndarray:
        return self.count(self.ends) - self.count(self.starts)

    def place(self, units: np.ndarray) -> np.ndarray:
        """The byte behind the first ``units`` units of each text; what stands before its first unit goes with that."""
        wanted = self.count(self.starts) + units + 1
        low, high = self.starts.copy(), self.ends.copy()  # the unit behind the cut begins before high, if at all
        while (low < high).any():
            middle = (low + high) // 2
            enough = self.count(np.minimum(middle + 1, self.ends)) >= wanted  # a text that is settled at its end asks for no byte beyond it
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return np.where(units > 0, low, self.starts)


def _draws(seed: int, key) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def rearrange(df: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "char", seed: int = 1,
              changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Add ``n`` (units of the text), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` to every row.

    Both cuts fall between units, after as many as a digest of seed and key says. ``form`` is ``psm`` (prefix, suffix,
    middle, each behind its marker), ``spm`` (suffix first) or ``plain``: the text as it is, if it is empty, holds a
    marker or is not drawn; then the two lengths, in code points, are null. A null text counts as empty, a null
    key as the empty one; repeated rows come out alike; texts of any length are cut whole; an empty table gives an
    empty one. Other columns pass through, and one that already has a name of the new ones is refused.
    """
    schema = schema_with(df, n="bigint", form="string", prefix_chars="bigint", middle_chars="bigint", output="string")
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches):
        for batch in sliced(batches, text):
            texts = bytes_of(batch, text)
            draws = [_draws(seed, k) for k in batch[key].to_pylist()]
            cutter = Cutter(texts, unit)
            n = cutter.sizes()
            ends = np.sort(np.array([d[:2] for d in draws], np.int64) % (n + 1)[:, None], axis=1)
            places = [cutter.place(e) for e in ends.T]
            chars = [cutter.count(at, "char") for at in (cutter.starts, *places)]
            first, second = (at - cutter.starts for at in places)
            forms, outputs = [], []
            for raw, (_, _, h3, h4), a, b in zip(texts, draws, first.tolist(), second.tolist()):
                if not raw or p in raw or s in raw or m in raw or h3 % 100 >= changed:
                    forms.append("plain"), outputs.append(raw)
                elif h4 % 100 < suffix_first:
                    forms.append("spm"), outputs.append(b"".join([s, raw[b:], p, raw[:a], m, raw[a:b]]))
                else:
                    forms.append("psm"), outputs.append(b"".join([p, raw[:a], s, raw[b:], m, raw[a:b]]))
            plain = np.array([f == "plain" for f in forms])
            yield with_columns(
                batch, n=pa.array(n, pa.int64()), form=pa.array(forms), prefix_chars=pa.array(chars[1] - chars[0], pa.int64(), mask=plain),
                middle_chars=pa.array(chars[2] - chars[1], pa.int64(), mask=plain), output=pa.array(outputs, pa.binary()).cast(pa.string()))

    return df.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of. No marker begins as another ends, so the first one found is it."""

    def pieces(first: str, second: str):
        body = F.substring(output, len(first) + 1, 2 ** 31 - 1)
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = pieces(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = pieces(SUFFIX, PREFIX)
    return (F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix))
            .otherwise(F.concat(prefix2, middle2, suffix2)))
