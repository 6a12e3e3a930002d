"""Byte-level BPE by recursive DuckDB queries inside Spark tasks.

A task keeps token rows of the words it has not met lately; each names the token at its right. One recursive query
looks pairs up in the merge table, contracts the leftmost pair of minimum rank of every word, and repeats this
until no word has a pair left. A query keeps the rows of all its rounds, at most the square of a word's length, so the
words of one query are counted by their squares. Decoding joins ids with the vocabulary and puts the bytes together by
an ordered aggregation. No step shuffles: every text is encoded where it was read.

Memory of a worker: one slice of texts, two generations of ``REMEMBERED`` bytes and a slice of encoded words, which it
keeps until another operator works in it, and at most half of ``ROWS_AT_A_TIME`` token rows.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from pointweave.llm.common import kept, schema_with, sliced, texts_of, with_columns

REMEMBERED = 40 << 20  # bytes that fill a generation; a worker keeps two of them
ENTRY = 150  # bytes that an entry takes beside its text and ids
ROWS_AT_A_TIME = 2_500_000  # sum of the squared lengths of the words in one recursive query
TEXT_BYTES = 2 << 20  # text encoded at a time
LONG = 256  # bytes; a longer single word is merged through a heap, as the rounds of a query are its number of merges
DECODED_AT_A_TIME = 200_000  # ids in one decoding query; one longer text makes a query of its own

# White space as the pattern's \s means it (Unicode White_Space).
_WS = "\t-\r \x85\xa0  -     　"
# No match of the pattern runs from other characters into white space, so these parts encode independently.
_PARTS = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")

# Of a pair that is contracted the right row stays, for it knows the next token. A candidate is made << 40 | pos << 8 |
# size, so the minimum is the leftmost pair of least rank.
_CONTRACT = """
WITH RECURSIVE state(word, pos, size, tok, nxt, made, step) AS (
  SELECT s.word, s.pos, 1::SMALLINT, s.tok, s.nxt, p.made, 0::SMALLINT
  FROM start s LEFT JOIN pairs p ON p.pair = ((s.tok::BIGINT << 32) | s.nxt)
  UNION ALL
  SELECT n.word, n.pos, n.size, n.tok, n.nxt, p.made, n.step FROM (
    SELECT s.word, CASE WHEN s.pos = b.stop THEN b.pos ELSE s.pos END AS pos,
           CASE WHEN s.pos = b.stop THEN (s.pos + s.size - b.pos)::SMALLINT ELSE s.size END AS size,
           CASE WHEN s.pos = b.stop THEN b.made ELSE s.tok END AS tok,
           CASE WHEN s.pos + s.size = b.pos THEN b.made ELSE s.nxt END AS nxt, (s.step + 1)::SMALLINT AS step
    FROM state s JOIN (
      SELECT word, (best >> 40)::INTEGER AS made, ((best >> 8) & 4294967295)::INTEGER AS pos,
             (((best >> 8) & 4294967295) + (best & 255))::INTEGER AS stop
      FROM (SELECT word, min((made::BIGINT << 40) | (pos::BIGINT << 8) | size) AS best
            FROM state WHERE made IS NOT NULL GROUP BY word)) b ON s.word = b.word
    WHERE s.pos <> b.pos) n LEFT JOIN pairs p ON p.pair = ((n.tok::BIGINT << 32) | n.nxt)
)
SELECT s.word, s.tok FROM state s JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) last
  ON s.word = last.word AND s.step = last.step ORDER BY s.pos
"""

_DECODE = """
SELECT t.text, string_agg(v.piece, '' ORDER BY t.pos) AS decoded, count(*) FILTER (v.piece IS NULL) AS unknown
FROM ids t LEFT JOIN vocabulary v USING (id) GROUP BY t.text ORDER BY t.text
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Memory:
    """Entries of the last slices: when a generation is full it becomes the old one, and the one before is forgotten.

    All entries that a slice asks for are in ``young`` until ``turn`` ends the slice.
    """

    def __init__(self, size: int):
        self.size, self.held, self.young, self.old = size, 0, {}, {}

    def lacking(self, keys: set[str]) -> set[str]:
        """The keys that have no entry; the entries of the others are in ``young``."""
        lacking = keys - self.young.keys()
        again = {k: self.old[k] for k in lacking & self.old.keys()}
        self.add(again)
        return lacking - again.keys()

    def add(self, entries: dict[str, bytes]) -> None:
        self.young.update(entries)
        self.held += sum(map(len, entries)) + sum(map(len, entries.values())) + ENTRY * len(entries)

    def turn(self) -> None:
        if self.held > self.size:  # a generation that one huge text has made far too large is forgotten at once
            self.old = self.young if self.held <= 2 * self.size else {}
            self.held, self.young = 0, {}


class Codec:
    """Encoder and decoder of one vocabulary, with an embedded database of its tables."""

    def __init__(self, path: str, pattern: str, remembered: int | None = None):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        if max(map(len, self.ranks)) > 255:
            raise ValueError("a token of more than 255 bytes does not fit the packed rows")
        self.memory = Memory(REMEMBERED if remembered is None else remembered)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "128MB", "temp_directory": ""})
        self.loaded: set[str] = set()

    def _with_pairs(self) -> None:
        """The merge table; workers that only decode do without it."""
        if "pairs" in self.loaded:
            return
        left, right, made = array("q"), array("q"), array("i")
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        self._load("pairs", pair=np.asarray(left) << 32 | np.asarray(right), made=np.asarray(made))

    def _with_vocabulary(self) -> None:
        # One character for each byte, because aggregates put strings together, not blobs.
        if "vocabulary" not in self.loaded:
            self._load("vocabulary", id=np.array(list(self.ranks.values()), np.int32), piece=[t.decode("latin-1") for t in self.ranks])

    def _load(self, name: str, **columns) -> None:
        self.db.register("loading", pa.table(columns))
        self.db.sql(f"CREATE TABLE {name} AS SELECT * FROM loading")
        self.db.unregister("loading")
        self.loaded.add(name)

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word."""
        self._with_pairs()
        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        nxt = np.append(tok[1:], np.int32(-1))
        nxt[np.cumsum(sizes) - 1] = -1  # no pair has it
        self.db.register("start", pa.table({"pos": np.arange(len(tok), dtype=np.int32), "word": word, "tok": tok, "nxt": nxt}))
        out = self.db.sql(_CONTRACT).to_arrow_table()
        self.db.unregister("start")
        ends = np.cumsum(np.bincount(out["word"].to_numpy(), minlength=len(words))) * 4
        packed = out["tok"].to_numpy().astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _long(self, word: bytes) -> bytes:
        """The same merges in the same order for one very long word, in n log n time."""
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))  # token that starts at i ends at end[i]; 0 once it is merged away
        begin = list(range(-1, n - 1)) + [n - 1]  # start of the token before the one that starts at i
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (rank := ranks.get(word[i:end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            begin[stop] = i
            offer(i)
            if begin[i] >= 0:
                offer(begin[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i:end[i]]])
            i = end[i]
        return np.array(out, "<u4").tobytes()

    def _ids_of(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of distinct words."""
        ids, open_ = {}, []
        for word, raw in zip(words, map(str.encode, words)):
            whole = self.ranks.get(raw)
            if whole is not None:
                ids[word] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                ids[word] = self._long(raw)
            else:
                open_.append((len(raw), word, raw))
        open_.sort(key=lambda w: w[0])  # words of one query end after about as many rounds
        rows = np.cumsum([size * size for size, _, _ in open_])
        at = done = 0
        while at < len(open_):
            stop = int(np.searchsorted(rows, done + ROWS_AT_A_TIME, side="right"))
            block = open_[at:stop]
            ids.update(zip([word for _, word, _ in block], self._contract([raw for _, _, raw in block])))
            at, done = stop, int(rows[stop - 1])
        return ids

    def _split(self, part: str) -> list[str]:
        letters = part[1:] if part[0] == " " else part
        return [part] if letters.isalpha() else self.pattern.findall(part)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [_PARTS.findall(t) for t in texts]
        split = {part: self._split(part) for part in self.memory.lacking(set().union(*cut))}
        self.memory.add(self._ids_of(self.memory.lacking(set().union(*split.values()))))
        ids_of = self.memory.young.__getitem__
        self.memory.add({part: b"".join(map(ids_of, words)) for part, words in split.items() if len(words) > 1})
        packed = [b"".join(map(ids_of, parts)) for parts in cut]
        self.memory.turn()
        return packed

    def decode(self, packed: list[bytes]) -> list[bytes]:
        self._with_vocabulary()
        out: list[bytes] = []
        at = 0
        while at < len(packed):
            stop, size = at, 0
            while stop < len(packed) and (stop == at or size + len(packed[stop]) // 4 <= DECODED_AT_A_TIME):
                size += len(packed[stop]) // 4
                stop += 1
            block = packed[at:stop]
            ids = np.frombuffer(b"".join(block), "<i4")
            text = np.repeat(np.arange(len(block), dtype=np.int32), [len(p) // 4 for p in block])
            self.db.register("ids", pa.table({"text": text, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
            found = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("ids")
            if sum(found["unknown"].to_pylist()):
                raise ValueError("an id is not in the vocabulary")
            decoded = dict(zip(found["text"].to_pylist(), found["decoded"].to_pylist()))
            out += [decoded.get(i, "").encode("latin-1") for i in range(len(block))]
            at = stop
        return out


def codec(path: str, pattern: str, remembered: int | None = None) -> Codec:
    """The worker's codec, with its tables; a Python worker loads them once for its tasks in a row."""
    return kept((path, pattern, remembered), lambda: Codec(path, pattern, remembered))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit integers) and ``n_tokens`` to every row.

    ``path`` names a rank file that every worker can open, ``pattern`` the pre-tokenizer. Special tokens are
    not looked for. A null or empty text has no ids; repeated rows stay; a text of any length is encoded
    whole; an empty table gives an empty one. Other columns pass through; a column that is already called
    ``ids`` or ``n_tokens`` is refused by name.
    """
    return df.mapInArrow(_coder(path, pattern, text, False), schema_with(df, ids="binary", n_tokens="bigint"))


def encode_and_decode(df: DataFrame, path: str, pattern: str, text: str = "text", *, remembered: int | None = None,
                      at_a_time: int = TEXT_BYTES) -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that each task needs one Python worker and one database.

    A worker with little memory may keep generations of ``remembered`` bytes and handle ``at_a_time`` bytes of text:
    it then encodes words anew more often, with the same results.
    """
    return df.mapInArrow(_coder(path, pattern, text, True, remembered, at_a_time), schema_with(df, ids="binary", n_tokens="bigint", decoded="binary"))


def _coder(path: str, pattern: str, text: str, back: bool, remembered: int | None = None, at_a_time: int = TEXT_BYTES):
    def run(batches):
        held = codec(path, pattern, remembered)
        for batch in sliced(batches, text, at_a_time, (path, pattern, remembered)):
            ids = held.encode(texts_of(batch, text))
            more = {"decoded": pa.array(held.decode(ids), pa.binary())} if back else {}
            yield with_columns(batch, ids=pa.array(ids, pa.binary()), n_tokens=pa.array([len(i) // 4 for i in ids], pa.int64()), **more)

    return run


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary): the bytes that the ids of each row stand for.

    Null or empty ids give no bytes; an id outside the vocabulary raises. Other columns pass through.
    """
    schema = schema_with(df, decoded="binary")

    def run(batches):
        for batch in sliced(batches, ids, TEXT_BYTES, (path, pattern, None)):
            packed = [p or b"" for p in batch[ids].to_pylist()]
            yield with_columns(batch, decoded=pa.array(codec(path, pattern).decode(packed), pa.binary()))

    return df.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of tokens, digest of the ids and digest of the decoded bytes."""
    coded = encode_and_decode(docs.select("doc_id", "text"), path, pattern).drop("text")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
