"""Source divergence audit by a recount through minimal perfect hashes.

A first pass counts exactly in how many documents of its language every term occurs; frequent ones are kept. They
are dealt by hash over shards of about ``SHARD_KEYS``, and every shard gets a minimal perfect hash: bit levels, each
holding the keys that meet no other there, so that the ranks of the set bits number the keys without gaps. The second
pass reads the texts again with the shards broadcast. A term is looked up, compared with the key stored at its slot,
and counted in the dense slots of its (language, source) group.

Broadcast is one round of ``ROUND`` shards at a time, at most ``STORED`` bytes a key; a larger vocabulary takes more
rounds. Tasks hold one slice of texts, a bounded dictionary of counts and ``SLOT_BYTES`` of slots, whatever their input.
What compares the groups runs on counts only: per shard of terms and block of sources, in whole numbers throughout.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from pointweave.llm.common import bytes_of, sliced
from pointweave.llm.shingles import mix
from pointweave.session import cut

MIN_DOCUMENTS = 10
TOP = 10  # terms listed for a group
SHARD_KEYS = 1 << 13
ROUND = 64  # shards broadcast at once
STORED = 64  # bytes of a key; of a longer one a digest is stored
HELD = 1 << 17  # distinct terms that a task counts before it looks them up
HELD_TEXT = 64 << 20  # bytes of text between lookups, which bounds what long terms can take
SLOT_BYTES = 64 << 20
BLOCK = 64  # sources compared at a time
_LOWER = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of other than ASCII characters, A-Z as a-z."""
    return text.translate(_LOWER).split()


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs): documents of the language that hold the term; rows of one task may repeat a term."""

    def rows(held):
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), len(counts)), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "term", "docs"])

    def run(batches):
        held, text_bytes = {}, 0
        for batch in sliced(batches, "text"):
            for lang, raw in zip(batch["lang"].to_pylist(), bytes_of(batch)):
                held.setdefault(lang, Counter()).update(set(terms(raw)))
                text_bytes += len(raw)
            if text_bytes >= HELD_TEXT or sum(map(len, held.values())) >= HELD:
                yield from rows(held)
                held, text_bytes = {}, 0
        yield from rows(held)

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, docs bigint")


def _key(lang: bytes, term: bytes) -> bytes:
    """What stands for a kept term in a shard: language and term, or a digest that no term can be."""
    key = lang + b"\0" + term
    return key if len(key) <= STORED else b"\0\0" + hashlib.sha256(key).digest()


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _position(h1: np.ndarray, h2: np.ndarray, level: int, size: np.ndarray) -> np.ndarray:
    return (mix(h1 + np.uint64(level + 1) * h2) % size.astype(np.uint64)).astype(np.int64)


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(level sizes, bits of all levels, key at every slot) of a minimal perfect hash."""
    left, sizes, bits, where, base = np.arange(len(h1)), [], [], np.zeros(len(h1), np.int64), 0
    while len(left):
        if len(sizes) == 64:
            raise ValueError("two terms have the same 128-bit hash")
        size = -(-2 * len(left) // 64) * 64
        at = _position(h1[left], h2[left], len(sizes), np.full(len(left), size))
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        where[left[mine]] = base + at[mine]
        left = left[~mine]
        sizes.append(size), bits.append(alone)
        base += size
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), np.argsort(where)


def shards(kept: DataFrame, n_shards: int) -> DataFrame:
    """(shard, sizes, bits, stored, keys): one row for each shard; ``stored`` and ``keys`` in the order of slots."""

    def deal(batches):
        for batch in batches:
            langs, words = (batch[c].cast(pa.binary()).to_pylist() for c in ("lang", "term"))
            h1, _ = _hashes([_key(a, b) for a, b in zip(langs, words)])
            yield pa.RecordBatch.from_arrays([pa.array((h1 % np.uint64(n_shards)).astype(np.int32)), batch["lang"], batch["term"]],
                                             names=["shard", "lang", "term"])

    def one(table: pa.Table) -> pa.Table:
        langs, words = (table[c].combine_chunks() for c in ("lang", "term"))
        stored = [_key(a, b) for a, b in zip(langs.cast(pa.binary()).to_pylist(), words.cast(pa.binary()).to_pylist())]
        sizes, bits, order = build(*_hashes(stored))
        keys = [{"lang": a, "term": b} for a, b in zip(langs.take(pa.array(order)).to_pylist(), words.take(pa.array(order)).to_pylist())]
        return pa.table({
            "shard": table["shard"].slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int32())),
            "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
            "stored": pa.array([[stored[i] for i in order]], pa.list_(pa.binary())),
            "keys": pa.array([keys], pa.list_(pa.struct([("lang", pa.string()), ("term", pa.string())])))})

    dealt = kept.select("lang", "term").mapInArrow(deal, "shard int, lang string, term string")
    return dealt.groupBy("shard").applyInArrow(
        one, "shard int, sizes array<int>, bits binary, stored array<binary>, keys array<struct<lang:string,term:string>>")


class Round:
    """The shards of one round, ready for lookups. Slots of the round are numbered anew for each language."""

    def __init__(self, rows: pa.Table, n_shards: int):
        self.shard = rows["shard"].to_numpy()
        self.row = np.full(n_shards, -1)
        self.row[self.shard] = np.arange(len(self.shard))
        sizes = rows["sizes"].to_pylist()
        self.size = np.zeros((len(sizes), max(map(len, sizes), default=0)), np.int64)
        for i, s in enumerate(sizes):
            self.size[i, :len(s)] = s
        per_shard = self.size.sum(axis=1)
        shard_base = np.cumsum(per_shard) - per_shard
        self.base = shard_base[:, None] + np.cumsum(self.size, axis=1) - self.size
        self.words = np.frombuffer(b"".join(rows["bits"].to_pylist()), "<u8")  # every level fills whole words
        self.ones = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
        self.first = self.ones[shard_base >> 6]  # slot of the round at which a shard's slots begin
        self.stored = pa.chunked_array([c.flatten() for c in rows["stored"].chunks], pa.binary()).combine_chunks()
        langs = pa.chunked_array([c.flatten() for c in rows["langs"].chunks], pa.string()).combine_chunks().dictionary_encode()
        code = langs.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(langs.dictionary))).astype(int).tolist()
        #: slots of each language, and the place of every slot among those of its language
        self.slots = {lang: order[a:z] for lang, a, z in zip(langs.dictionary.to_pylist(), [0, *ends[:-1]], ends)}
        self.place = np.zeros(len(code), np.int64)
        for slots in self.slots.values():
            self.place[slots] = np.arange(len(slots))

    def find(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are in the round, their slots)."""
        if not keys or not len(self.stored):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h1, h2 = _hashes(keys)
        row = self.row[(h1 % np.uint64(len(self.row))).astype(np.int64)]
        slot = np.full(len(keys), -1)
        open_ = np.flatnonzero(row >= 0)
        for level in range(self.size.shape[1]):
            open_ = open_[self.size[row[open_], level] > 0]
            size = self.size[row[open_], level]
            at = self.base[row[open_], level] + _position(h1[open_], h2[open_], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = self.words[word] >> bit & np.uint64(1) != 0
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[open_[hit]] = (self.ones[word] + below)[hit]
            open_ = open_[~hit]
        found = np.flatnonzero(slot >= 0)
        same = pc.equal(self.stored.take(pa.array(slot[found])), pa.array(keys, pa.binary()).take(pa.array(found)))
        found = found[same.to_numpy(zero_copy_only=False)]
        return found, slot[found]


def recount(docs: DataFrame, round_) -> DataFrame:
    """(shard, slot, source, n) of the kept terms of a broadcast round; a group's counts may come in several rows."""

    def rows(slots, held: Round):
        for (lang, source), n in slots.items():
            used = np.flatnonzero(n)
            at = held.slots[lang][used]
            row = np.searchsorted(held.first, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.shard[row], pa.int32()), pa.array((at - held.first[row]).astype(np.int32)), pa.repeat(pa.scalar(source, pa.string()), len(at)), pa.array(n[used])],
                names=["shard", "slot", "source", "n"])
        slots.clear()

    def run(batches):
        held = round_.value
        slots, counts, text_bytes = {}, {}, 0

        def settle():
            for (lang, source), counted in counts.items():
                raw = lang.encode()
                found, slot = held.find([_key(raw, w) for w in counted])
                if not len(found):
                    continue
                if (lang, source) not in slots:
                    if 8 * (sum(map(len, slots.values())) + len(held.slots[lang])) > SLOT_BYTES:
                        yield from rows(slots, held)
                    slots[lang, source] = np.zeros(len(held.slots[lang]), np.int64)
                slots[lang, source][held.place[slot]] += np.fromiter(counted.values(), np.int64, len(counted))[found]
            counts.clear()

        for batch in sliced(batches, "text"):
            for lang, source, raw in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), bytes_of(batch)):
                counts.setdefault((lang, source), Counter()).update(terms(raw))
                text_bytes += len(raw)
            if text_bytes >= HELD_TEXT or sum(map(len, counts.values())) >= HELD:
                yield from settle()
                text_bytes = 0
        yield from settle()
        yield from rows(slots, held)

    return docs.mapInArrow(run, "shard int, slot int, source string, n bigint")


def kept_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, term, shard, slot) of the kept terms and (shard, slot, source, n) of their counts in each group."""
    spark = docs.sparkSession
    kept = cut(document_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCUMENTS))
    n_shards = max(1, -(-kept.count() // SHARD_KEYS))
    held = cut(shards(kept, n_shards))
    keys = held.select("shard", F.posexplode("keys").alias("slot", "key")).select("shard", "slot", "key.*")
    counts = None
    for start in range(0, n_shards, ROUND):
        rows = held.where(F.col("shard").between(start, start + ROUND - 1)).select("shard", "sizes", "bits", "stored", F.col("keys.lang").alias("langs")).orderBy("shard").toArrow()
        given = spark.sparkContext.broadcast(Round(rows, n_shards))
        part = cut(recount(docs, given).groupBy("shard", "slot", "source").agg(F.sum("n").alias("n")))
        given.destroy()
        counts = part if counts is None else counts.unionByName(part)
    return keys, counts


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1000000000 * (n + 2) / (total + 2 * kept)) in whole numbers of any size."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", F.lit(1000000000).cast("decimal(10,0)") * wide(n + 2), F.nullif(wide(total + 2 * kept), F.lit(0)))


def _apart(p, q):
    return (p - q) * (p - q) // (p + q)


def _blocks(size: int):
    """Sums over one shard of a language for the pairs (a, b), a < b, of two blocks of ``size`` of its sources.

    Rows without a slot name the sources with their share of an absent term, and how many terms the shard has.
    """

    def run(table: pa.Table) -> pa.Table:
        lang, low, high = table["lang"][0].as_py(), table["low"][0].as_py(), table["high"][0].as_py()
        number, p = table["number"].to_numpy(), table["p"].to_numpy()
        named = pc.is_null(table["slot"]).to_numpy()
        order = np.argsort(number[named])
        names, absent = number[named][order], p[named][order]
        width = int(pc.max(table["terms"]).as_py())
        columns, column = np.unique(table["slot"].filter(pa.array(~named)).to_numpy(), return_inverse=True)
        share = np.repeat(absent[:, None], len(columns), axis=1)
        share[np.searchsorted(names, number[~named]), column] = p[~named]
        others = np.flatnonzero(names // size == high)
        a, b, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(names // size == low).tolist():
            j = others[names[others] > names[i]]
            a.append(np.full(len(j), names[i])), b.append(names[j])
            value.append(_apart(share[i], share[j]).sum(axis=1) + (width - len(columns)) * _apart(absent[i], absent[j]))
        a, b, value = (np.concatenate(c) for c in (a, b, value))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a, "b": b, "value": value})

    return run


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of each language are apart, and by which terms.

    Part ``pair`` has every other source of the language, by the sum over all kept terms; part ``term`` the terms that
    a source uses more than its language does, the first ``TOP``. Ranks go by value, then by item.

    Null texts, languages and sources count as empty; a repeated row is a document of its own; texts of any length
    are counted whole; a language without kept terms has pairs of value 0 and no terms; an empty table gives an empty
    one; other columns are not read.
    """
    docs = _named(docs)
    keys, counts = kept_counts(docs)
    keys = cut(keys)
    entries = cut(counts.join(keys, ["shard", "slot"]))
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = docs.select("lang", "source").distinct().withColumn("number", (F.row_number().over(by_source) - 1).cast("long"))
    kept = keys.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sum("total").alias("lang_total"), F.floor(F.max("number") / BLOCK).alias("last"))
    stats = groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").join(of_lang, "lang").na.fill(0, ["total", "kept", "lang_total"])
    stats = cut(stats.withColumn("absent", F.coalesce(_share(F.lit(0), F.col("total"), F.col("kept")), F.lit(1)).cast("long")))

    shared = cut(entries.join(stats, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")).cast("long")))
    of_term = entries.groupBy("shard", "slot").agg(F.sum("n").alias("lang_n"))
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).cast("long")
    ahead = shared.join(of_term, ["shard", "slot"]).withColumn("q", q).where("p > q")
    terms_ = ahead.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))

    per_shard = keys.groupBy("lang", "shard").agg(F.count("*").alias("terms"))
    named = stats.select("lang", "number", "last", F.col("absent").alias("p")).join(per_shard, "lang", "left").select(
        "lang", F.coalesce("shard", F.lit(-1)).alias("shard"), "number", "last", F.lit(None).cast("int").alias("slot"), "p", F.coalesce("terms", F.lit(0)).alias("terms"))
    rows = named.unionByName(shared.select("lang", "shard", "number", "last", "slot", "p", F.lit(None).cast("long").alias("terms")))
    own = F.floor(F.col("number") / BLOCK)
    facing = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).select(
        "lang", "shard", "number", "slot", "p", "terms", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"))
    sums = facing.groupBy("lang", "shard", "low", "high").applyInArrow(_blocks(BLOCK), "lang string, a bigint, b bigint, value bigint")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("number"), F.col("b").alias("other")), F.struct(F.col("b").alias("number"), F.col("a").alias("other"))))
    both = sums.select("lang", "value", ways.alias("w")).select("lang", "value", "w.*")
    names = stats.select("lang", "number", "source")
    pairs = both.join(names, ["lang", "number"]).join(
        names.select("lang", F.col("number").alias("other"), F.col("source").alias("item")), ["lang", "other"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms_).where(F.col("rank") <= TOP))
