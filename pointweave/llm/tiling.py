"""Benchmark decontamination by greedy string tiling.

Shared seeds, the hashes of ``MATCH`` words, join documents to benchmark items. A pair with enough seeds is tiled:
a running Karp-Rabin hash finds the longest match between words that no tile covers yet, all matches of that
length are marked, and so on down to ``MATCH`` words. An item is leaked if tiles cover ``COVERAGE`` of its words,
in whatever order they stand in the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pointweave.llm.common import bytes_of, sliced
from pointweave.llm.shingles import Tokens, tokens
from pointweave.session import cut

MATCH = 5  # words of the shortest tile; a shorter item is matched as a whole
COVERAGE = 0.7  # of an item's words
FILTER_BITS = 1 << 24  # of the bitmap of seeds that tasks ask before they send a seed
FILTERED = 1 << 20  # positions up to which the bitmap is of use, and rows of seeds up to which they are broadcast
ITEMS = 256  # items that one row of a document is compared with
_PAIR = "struct<doc_start:int,item_start:int,size:int>"


def _seeds(found: Tokens, sizes: list[int]):
    """(text, hash) of the windows of each size; the size is part of the hash."""
    for size in sizes:
        start, h = found.windows(size)
        yield found.text[start], (h ^ np.uint64(size)).view(np.int64)


def item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, n_words, seed, n): seeds of every item with their number of places in it."""

    def run(batches):
        for batch in sliced(batches, "text"):
            found = tokens(bytes_of(batch))
            counts = np.diff(found.first)
            text, seed = [], []
            for size in range(1, MATCH + 1):
                for t, h in _seeds(found, [size]):
                    own = counts[t] == size if size < MATCH else counts[t] >= MATCH
                    text.append(t[own]), seed.append(h[own])
            text, seed = np.concatenate(text), np.concatenate(seed)
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(text)), pa.array(counts[text].astype(np.int32)), pa.array(seed)],
                                             names=["item_id", "n_words", "seed"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(run, f"item_id {kind}, n_words int, seed bigint").groupBy("item_id", "n_words", "seed").agg(
        F.count("*").alias("n"))


def document_seeds(docs: DataFrame, sizes: list[int], bitmap=None) -> DataFrame:
    """(doc_id, seed): distinct seeds of every document that the bitmap, a broadcast of fixed size, lets through."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches, "text"):
            found = tokens(bytes_of(batch))
            for text, seed in _seeds(found, sizes):
                if bitmap is not None:
                    held = bitmap.value
                    bit = seed.view(np.uint64) % np.uint64(FILTER_BITS)
                    hit = held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 != 0
                    text, seed = text[hit], seed[hit]
                order = np.lexsort((seed, text))
                text, seed = text[order], seed[order]
                new = np.r_[True, (text[1:] != text[:-1]) | (seed[1:] != seed[:-1])] if len(text) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(text[new])), pa.array(seed[new])], names=["doc_id", "seed"])

    return docs.mapInArrow(run, f"doc_id {kind}, seed bigint")


def tiles(doc: np.ndarray, item: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the document, place in the item, size), longest first, of two sequences of word hashes."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []

    def at(words: np.ndarray, free: np.ndarray, size: int):
        start, h = Tokens(words, np.zeros(len(words), np.int64), np.array([0, len(words)])).windows(size)
        if len(start):
            taken = np.r_[0, np.cumsum(~free)]
            open_ = taken[start + size] == taken[start]
            start, h = start[open_], h[open_]
        return start, h

    def matches(size: int):
        d, dh = at(doc, free_doc, size)
        i, ih = at(item, free_item, size)
        hit = np.isin(dh, ih)
        return d[hit], dh[hit], i, ih

    longest = min(len(doc), len(item))
    while longest >= shortest:
        low, high = shortest - 1, longest  # a match of ``low`` words exists, as far as known; none of more than ``high``
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(matches(middle)[0]) else (low, middle - 1)
        longest = low
        if longest < shortest:
            break
        d, dh, i, ih = matches(longest)
        places: dict[int, list[int]] = {}
        for p, h in zip(i.tolist(), ih.tolist()):
            places.setdefault(h, []).append(p)
        for p, h in zip(d.tolist(), dh.tolist()):
            if not free_doc[p:p + longest].all():
                continue
            for q in places[h]:
                if free_item[q:q + longest].all() and (doc[p:p + longest] == item[q:q + longest]).all():
                    free_doc[p:p + longest], free_item[q:q + longest] = False, False
                    out.append((p, q, longest))
                    break
        if not free_item.any():
            break
    return out


def _tile_rows(batches):
    kind = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("size", pa.int32())]))
    for batch in batches:
        for row, doc in enumerate(bytes_of(batch, "text")):
            items = batch["items"].slice(row, 1).flatten()
            d, out = tokens([doc]).hash, []
            for item in bytes_of(pa.RecordBatch.from_arrays([pc.struct_field(items, "item_text")], names=["text"])):
                i = tokens([item]).hash
                shortest = min(MATCH, len(i))
                # Only places that a shared seed covers can be in a tile; a gap stands for the words between them.
                start, h = Tokens(d, np.zeros(len(d), np.int64), np.array([0, len(d)])).windows(shortest)
                own = Tokens(i, np.zeros(len(i), np.int64), np.array([0, len(i)])).windows(shortest)[1]
                covered = np.zeros(len(d) + 1, np.int64)
                hits = start[np.isin(h, own)]
                np.add.at(covered, hits, 1)
                np.add.at(covered, hits + shortest, -1)
                inside = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
                gaps = np.flatnonzero(np.diff(inside) > 1) + 1
                words = np.insert(d[inside], gaps, np.arange(len(gaps), dtype=np.uint64))
                places = np.insert(inside, gaps, -1)
                out.append([{"doc_start": int(places[p]), "item_start": q, "size": n} for p, q, n in tiles(words, i, shortest)])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(np.full(len(out), row))), pc.struct_field(items, "item_id"), pc.struct_field(items, "n_words"),
                 pa.array([sum(t["size"] for t in ts) for ts in out], pa.int32()), pa.array(out, kind)],
                names=["doc_id", "item_id", "n_words", "n_covered", "tiles"])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, coverage, tiles) of every document and item that it leaks.

    Reads doc_id and text of ``docs``, item_id and text of ``items``, whatever else they hold. Null and empty texts
    have no words and match nothing; rows with a null id are compared with nothing, as no result could name them;
    repeated rows of a document or an item give one row; empty tables give an empty one. A pair is tiled if its
    shared seeds could reach the coverage: tiles over c words hold c / MATCH seeds at least, so none is missed.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    items = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    seeds = cut(item_seeds(items))
    sizes = sorted({r[0] for r in seeds.select(F.least("n_words", F.lit(MATCH))).distinct().collect()})  # 1 to MATCH
    bits = seeds.select(F.pmod("seed", F.lit(FILTER_BITS)).cast("int").alias("bit")).distinct().limit(FILTERED + 1).toArrow()["bit"].to_numpy()
    few, bitmap = len(bits) <= FILTERED, None
    if few:  # else the bitmap would let most seeds through and the seeds are too many to broadcast
        bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
        np.bitwise_or.at(bitmap, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
        bitmap = docs.sparkSession.sparkContext.broadcast(bitmap)
    small = seeds.limit(FILTERED + 1).count() <= FILTERED  # items with many seeds in common have few positions and many rows
    shared = document_seeds(docs, sizes, bitmap).join(F.broadcast(seeds) if small else seeds, "seed")
    pairs = cut(shared.groupBy("doc_id", "item_id", "n_words").agg(F.sum("n").alias("n"))
                .where(F.col("n") * F.least(F.lit(MATCH), "n_words") >= F.col("n_words") * COVERAGE).drop("n"))
    named = items.withColumnRenamed("text", "item_text")
    # A document is sent once for every ITEMS items that it may leak.
    chunks = pairs.groupBy("doc_id").agg(F.ceil(F.count("*") / ITEMS).alias("chunks"))
    dealt = pairs.join(chunks, "doc_id").withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.col("chunks"))).join(named, "item_id")
    asked = dealt.groupBy("doc_id", "chunk").agg(F.collect_list(F.struct("item_id", "n_words", "item_text")).alias("items"))
    met = docs.join(cut(asked), "doc_id").select("doc_id", "text", "items")
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString() if c == 'doc_id' else items.schema[c].dataType.simpleString()}"
                      for c in ("doc_id", "item_id"))
    tiled = met.mapInArrow(_tile_rows, f"{kinds}, n_words int, n_covered int, tiles array<{_PAIR}>")
    found = tiled.withColumn("coverage", F.col("n_covered") / F.col("n_words")).where(F.col("coverage") >= COVERAGE)
    return found.select("doc_id", "item_id", "n_words", "n_covered", "coverage", "tiles").dropDuplicates(["doc_id", "item_id"])


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document leaks no item; rows with a null id stay."""
    leaked = cut(leaks(docs, items).select("doc_id").distinct())
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)
