"""Repeated passages by sparse suffix arrays.

Every window of ``WINDOW`` word shingles keeps its minimiser, so the positions kept depend on the words alone and
two texts that share ``PASSAGE`` words keep the same position within its first ``WINDOW`` shingles. Only the suffixes
at these positions are retained. They are sorted by the sequence of their first ``PREFIX`` words, range by range over
the cluster, and every one is compared with its neighbours in that order; the last one of a range meets the first one of the
next. Words order by a code of ``CODE`` bytes, so a suffix takes ``PREFIX * CODE`` bytes in the sort, whatever its words.

A suffix with an equal neighbour is extended to the left, word by word, up to ``WINDOW`` - 1 words, and the passages
of ``PASSAGE`` words that it reaches are compared with those of the other documents by 64-bit hashes. Passages in a row
are joined, which extends a match left and right to its full length. The result is exact but for those hashes: every window
of ``PASSAGE`` words that another document holds too, and no other.

Equal suffixes are told apart by a hash of their place, so the ranges of a passage that a third of all documents
share are as long as any others. A range is compared in one pass that holds one batch and the row before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pointweave.llm.common import bytes_of, sliced
from pointweave.llm.shingles import tokens
from pointweave.session import cut

PASSAGE = 50  # words
SHINGLE = 5  # words whose hash orders positions
WINDOW = 29  # shingles
PREFIX = PASSAGE - WINDOW + 1  # words that two suffixes share at least where texts share a passage
CODE = 3  # bytes of a word in the order of suffixes
_PLACE = np.uint64((1 << 24) - 1)  # low bits of a shingle's rank: the place, so the leftmost of equal hashes is kept


def _minimisers(start: np.ndarray, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Word positions kept: the least shingle of each window of shingles within one text, leftmost first."""
    n = len(start) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    rank = (hashes & ~_PLACE) | (np.arange(len(start), dtype=np.uint64) & _PLACE)
    width, least = 1, rank
    while width < WINDOW:  # minima of windows twice as wide, the last step overlapping
        step = min(width, WINDOW - width)
        least = np.minimum(least[:len(least) - step], least[step:])
        width += step
    whole = text[:n] == text[WINDOW - 1:]
    first = np.arange(n)[whole]
    place = (least[:n][whole] & _PLACE).astype(np.int64)
    index = first + ((place - first) & int(_PLACE))  # the place is known up to a multiple of 2^24
    return start[np.unique(index)]


def suffixes(docs: DataFrame) -> DataFrame:
    """(suffix, doc_id, place): codes of the first ``PREFIX`` words of every kept suffix, and where it begins."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches, "text"):
            found = tokens(bytes_of(batch))
            start, hashes = found.windows(SHINGLE)
            kept = _minimisers(start, hashes, found.text[start])
            kept = kept[kept + PREFIX <= found.first[found.text[kept] + 1]]
            codes = found.hash.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :CODE]
            suffix = codes[kept[:, None] + np.arange(PREFIX)].ravel()
            ends = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * (PREFIX * CODE))
            text = found.text[kept]
            yield pa.RecordBatch.from_arrays(
                [pa.Array.from_buffers(pa.binary(), len(kept), [None, ends.buffers()[1], pa.py_buffer(suffix)]),
                 batch["doc_id"].take(pa.array(text)), pa.array((kept - found.first[text]).astype(np.int32))],
                names=["suffix", "doc_id", "place"])

    return docs.mapInArrow(run, f"suffix binary, doc_id {kind}, place int")


def _beside(batches):
    """Rows of a sorted range with an equal neighbour, and its first and last row with their suffix as ``edge``."""

    def chosen(rows, equal, edge):
        kept = np.flatnonzero(equal | edge)
        suffix = rows["suffix"].take(pa.array(kept, mask=~edge[kept]))
        return pa.RecordBatch.from_arrays(
            [rows["doc_id"].take(pa.array(kept)), rows["place"].take(pa.array(kept)), pa.array(equal[kept]), suffix],
            names=["doc_id", "place", "equal", "edge"])

    held, matched, first = None, False, True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        suffix, n = rows["suffix"], rows.num_rows
        same = pc.equal(suffix.slice(0, n - 1), suffix.slice(1)).to_numpy(zero_copy_only=False).astype(bool)
        before = np.r_[matched, same]  # whether a row equals the one before it
        edge = np.zeros(n, bool)
        edge[0] = first
        yield chosen(rows.slice(0, n - 1), before[:-1] | same, edge[:-1])
        held, matched, first = rows.slice(n - 1), bool(before[-1]), first and n == 1
    if held is not None:
        yield chosen(held, np.array([matched]), np.array([True]))


def neighbours(rows: DataFrame) -> DataFrame:
    """(doc_id, place) of the suffixes that have an equal one beside them in the order of all suffixes."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "suffix", F.xxhash64("doc_id", "place")).sortWithinPartitions("suffix")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = cut(ordered.mapInArrow(_beside, f"doc_id {kind}, place int, equal boolean, edge binary"))
    borders = found.where("edge IS NOT NULL")  # two rows of a range at most
    again = borders.groupBy("edge").count().where("count > 1").select("edge")
    across = borders.where("NOT equal").join(again, "edge", "left_semi")
    return found.where("equal").unionByName(across.select(*found.columns)).select("doc_id", "place")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key another document holds too."""
    classes = rows.groupBy(key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most")
    # Dealt out otherwise than the join needs, so that it deals both sides itself and may split a key with many rows.
    dealt = classes.select(F.col(key).alias("__key")).repartition(F.xxhash64("__key"))
    return rows.join(dealt, F.col(key) == F.col("__key"), "left_semi")


def _extended(kind: str):
    """Hashes of the passages that the candidate suffixes of each document reach to the left."""

    def run(batches):
        for batch in sliced(batches, "text"):
            found = tokens(bytes_of(batch))
            start, hashes = found.windows(PASSAGE)
            places = batch["places"]
            offsets = places.offsets.to_numpy()
            flat = places.values.to_numpy()[offsets[0]:offsets[-1]] if len(places) else np.zeros(0, np.int64)
            at = flat + np.repeat(found.first[:-1], np.diff(offsets))
            at = at[at < np.repeat(found.first[1:], np.diff(offsets))]  # the places may be of another text with this id
            reach = np.zeros(len(found.hash) + 1, np.int64)
            np.add.at(reach, np.maximum(at - WINDOW + 1, found.first[found.text[at]]), 1)
            np.add.at(reach, at + 1, -1)
            kept = np.cumsum(reach)[start] > 0
            start, hashes = start[kept], hashes[kept]
            text = found.text[start]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), batch["doc_id"].take(pa.array(text)), pa.array((start - found.first[text]).astype(np.int32))],
                names=["passage", "doc_id", "place"])

    return run, f"passage bigint, doc_id {kind}, place int"


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_repeated, spans) of every document that shares a passage of ``PASSAGE`` words with another one.

    Words are runs of other characters than ASCII white space, A-Z counting as a-z; spans are (start, end) in
    words, longest possible and apart; n_repeated is the number of words in them. Null, empty and short texts share
    nothing; rows with a null id are left out, as no result could name them; repeated rows of a document are one
    document and do not repeat each other; an empty table gives an empty one; other columns are not read.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    candidates = cut(neighbours(suffixes(docs)).groupBy("doc_id").agg(F.collect_set("place").alias("places")))
    run, schema = _extended(docs.schema["doc_id"].dataType.simpleString())
    passages = docs.join(candidates, "doc_id").select("doc_id", "text", "places").mapInArrow(run, schema)
    starts = _shared(passages, "passage").groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("starts"))
    size = F.lit(PASSAGE)
    # A start within the span before it, or just behind, prolongs that span.
    opens = F.filter("starts", lambda s, i: F.coalesce(s > F.get("starts", i - 1) + size, F.lit(True)))
    closes = F.filter("starts", lambda s, i: F.coalesce(F.get("starts", i + 1) > s + size, F.lit(True)))
    spans = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("start"), (b + size).alias("end")))
    return starts.select("doc_id", spans.alias("spans")).select(
        "doc_id", F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).alias("n_repeated"), "spans")
