"""Near copies by the Jaccard similarity of word shingles.

Texts are sets of ``SHINGLE``-word shingles; two are near copies if their sets have a Jaccard similarity of at least
4 / 5. Candidates meet in one of ``BANDS`` buckets, each keyed by ``ROWS`` minima of differently scrambled shingle
hashes: a pair at the threshold misses all buckets with probability (1 - 0.8^3)^24 = 3.3e-8, a closer one less often.
Every candidate pair is then decided on the full sets (hashes have 64 bits), so no pair below the threshold links.

Only distinct sets are indexed, so copies cost one row. Sets are made again for those texts only that share a bucket. First
every member of a bucket is compared with its hub, the member with the least digest, which is the same in all buckets of a
group. Buckets whose members are connected then are done. Of the others, those with the same members count once, and buckets
that share members make a cluster. A cluster is compared as one, so that a set is sent once and not once for each of its
buckets, unless its buckets one by one need fewer rows. What is left to compare are the members outside the largest component with all
the others: both are dealt over blocks, and a block of the ones meets a block of the others in one group. Blocks grow with the number
of sets, so that a set is sent about as often whatever the size of the table, up to ``MOST`` members or ``BLOCK_BYTES``; a group
holds two blocks. It counts shared shingles by an index of its sets and leaves a forest of links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pointweave.llm.common import bytes_of, one_of_components, sliced
from pointweave.llm.shingles import mix, tokens
from pointweave.operators.components import component_roots
from pointweave.session import cut

SHINGLE = 5  # words
SEED = 42
BANDS, ROWS = 24, 3
_RNG = np.random.default_rng(SEED)
_FLIP, _FACTOR = _RNG.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FACTOR |= np.uint64(1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FIT = "9 * least(n, m) >= 4 * (n + m)"  # what both may share is enough for the threshold
LEAST, MOST = 256, 4096  # members of a block: the share of one task, within these bounds
BLOCK_BYTES = 4 << 20  # of the sets of a block, about
FILTER_BITS = 1 << 24  # of the bitmap of candidates that tasks ask before they make a set
FILTERED = 1 << 20  # candidates up to which the bitmap is of use


def shingled(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending text by text, and where each text's begin, with the end behind the last.

    A text of fewer words than a shingle has one hash, of all its words.
    """
    found = tokens(texts)
    start, hashes = found.windows(SHINGLE)
    owner = found.text[start]
    short = np.flatnonzero(np.bincount(owner, minlength=len(texts)) == 0)
    whole = [xxhash.xxh64_intdigest(b" ".join(texts[i].lower().split()), SEED) for i in short]
    owner, hashes = np.r_[owner, short], np.r_[hashes, np.array(whole, np.uint64)]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])]
    owner, hashes = owner[fresh], hashes[fresh]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def _digests(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for each set, whatever the order of its members."""
    return np.add.reduceat(mix(hashes ^ _SPREAD), first[:-1]).view(np.int64)


def _bands(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys (text, band) of the buckets."""
    keys = np.zeros((len(first) - 1, BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        h = (hashes ^ _FLIP[k]) * _FACTOR[k]
        h = (h ^ h >> np.uint64(32)) * _SPREAD
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] * _SPREAD + np.minimum.reduceat(h, first[:-1]))
    return keys.view(np.int64)


def _marks(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, node, n, bands) of every row: digest and size of its set and the keys of its buckets."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches, text):
            hashes, first = shingled(bytes_of(batch, text))
            keys = _bands(hashes, first)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch[key], pa.array(_digests(hashes, first)), pa.array(np.diff(first)), bands], names=[key, "node", "n", "bands"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, node bigint, n bigint, bands array<bigint>")


def _sets(df: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """(node, members) of the given nodes: their distinct shingle hashes as bytes, ascending.

    Texts are not shuffled: tasks read them again and ask a bitmap of fixed size which sets are wanted. With too many
    candidates for the bitmap all sets are made; the join with ``nodes`` decides in any case.
    """
    bits = nodes.select(F.pmod("node", F.lit(FILTER_BITS)).cast("int").alias("bit")).distinct().limit(FILTERED + 1).toArrow()["bit"].to_numpy()
    given = None
    if len(bits) <= FILTERED:
        bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
        np.bitwise_or.at(bitmap, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
        given = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in sliced(batches, text):
            hashes, first = shingled(bytes_of(batch, text))
            node = _digests(hashes, first)
            kept = np.arange(len(node))
            if given is not None:
                bit = node.view(np.uint64) % np.uint64(FILTER_BITS)
                kept = np.flatnonzero(given.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            members = [hashes[first[i]:first[i + 1]].tobytes() for i in kept.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(members, pa.binary())], names=["node", "members"])

    made = df.select(text).mapInArrow(run, "node bigint, members binary")
    return made.groupBy("node").agg(F.first("members").alias("members")).join(nodes, "node", "left_semi")


def _near(batches):
    """Those pairs (a, b) whose sets are near copies."""
    for batch in batches:
        kept = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch["x"], batch["y"])):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = np.sort(np.concatenate([x, y]))
            shared = np.count_nonzero(both[1:] == both[:-1])
            kept[i] = 5 * shared >= 4 * (len(both) - shared)
        yield batch.select(["a", "b"]).filter(pa.array(kept))


def _decided(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among candidate pairs (a, b). Sets of ``b`` are sent along; those of ``a``, the hubs, stay where they are."""
    pairs = cut(pairs)  # narrow, so that its true size tells how to meet the wide sets
    hubs = cut(sets.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi"))
    x = hubs.select(F.col("node").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return cut(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_near, "a bigint, b bigint"))


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with the root of their node."""
    roots = component_roots(links)
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _blocks(table: pa.Table) -> pa.Table:
    """A forest of the links between the sets that ask and those that answer; a pair of both is compared in one direction."""
    node, root, outer, asks, answers = (table[c].to_numpy() for c in ("node", "root", "outer", "asks", "answers"))
    root = root.copy()
    members = [np.frombuffer(m.as_buffer(), "<u8") for m in table["members"]]
    n, hashes = np.array([len(m) for m in members]), np.concatenate(members)
    first = np.r_[0, np.cumsum(n, dtype=np.int64)]
    _, shingle = np.unique(hashes, return_inverse=True)
    holders = np.repeat(np.arange(len(n)), n)[np.argsort(shingle, kind="stable")]
    ends = np.cumsum(np.bincount(shingle))
    a, b = [], []
    for i in np.flatnonzero(asks).tolist():
        facing = answers & (root != root[i]) & (~outer | (node > node[i])) & (9 * np.minimum(n, n[i]) >= 4 * (n + n[i]))
        if not facing.any():
            continue
        own = shingle[first[i]:first[i + 1]]
        begin = np.where(own > 0, ends[own - 1], 0)
        size = ends[own] - begin
        place = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        shared = np.bincount(holders[place], minlength=len(n))
        near = np.flatnonzero(facing & (9 * shared >= 4 * (n + n[i])))
        for r, k in zip(*np.unique(root[near], return_index=True)):
            a.append(node[i]), b.append(node[near[k]])
            root[root == r] = root[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _dealt(inside: DataFrame) -> DataFrame:
    """Members of open buckets (band, value, low, node, root, n) dealt over groups (band, value, low, high).

    Any two members of a bucket with different roots meet in a group, where one ``asks`` and the other ``answers``.
    ``low`` of the input is the least node of its bucket. A cluster of buckets has band -1.
    """
    whole = component_roots(inside.select(F.col("node").alias("a"), F.col("low").alias("b"))).withColumnRenamed("root", "cluster")
    labelled = cut(inside.join(whole, "node", "left").select(
        F.coalesce("cluster", "node").alias("cluster"), "band", "value", "node", "root", "n"))
    as_one = labelled.select("cluster", F.lit(-1).alias("band"), F.col("cluster").alias("value"), "node", "root", "n").distinct()
    units = cut(labelled.unionByName(as_one))
    parts = int(inside.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = min(MOST, max(LEAST, units.where("band = -1").count() // parts))

    key = ["cluster", "band", "value"]
    blocks = lambda c, n: F.greatest(F.ceil(c / block), F.ceil(n * 8 / BLOCK_BYTES))
    by_root = units.groupBy(*key, "root").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    size = by_root.groupBy(*key).agg(F.max(F.struct("c", "m", "root")).alias("main"), F.sum("c").alias("c"), F.sum("m").alias("m")).select(
        *key, "main", (F.col("c") - F.col("main.c")).alias("others"), blocks(F.col("c"), F.col("m")).alias("blocks"),
        blocks(F.col("c") - F.col("main.c"), F.col("m") - F.col("main.m")).alias("outer_blocks"))
    size = cut(size.withColumn("sent", F.expr("others * (blocks + outer_blocks - 1) + main.c * outer_blocks")))
    best = size.groupBy("cluster").agg(F.expr("sum(if(band < 0, sent, 0)) <= sum(if(band < 0, 0, sent))").alias("one"))
    chosen = cut(size.join(best, "cluster").where(F.col("one") == (F.col("band") < 0)).select("band", "value", F.col("main.root").alias("main"), "blocks", "outer_blocks"))

    place = lambda blocks: F.pmod(F.xxhash64("node", F.lit(blocks)), F.col(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    met = units.join(chosen.repartition(F.xxhash64("band", "value")), ["band", "value"]).select(
        "band", "value", "node", "root", (F.col("root") != F.col("main")).alias("outer"),
        "blocks", "outer_blocks", place("blocks").alias("own"), place("outer_blocks").alias("own_outer"))
    row = ["band", "value", "low", "high", "node", "root", "outer", "asks", "answers"]
    asks = met.where("outer").withColumn("high", every("blocks")).withColumns(
        {"low": F.col("own_outer"), "asks": F.lit(True), "answers": F.col("high") == F.col("own")}).select(*row)
    answers = met.withColumn("low", every("outer_blocks")).where("not outer or low <> own_outer").withColumns(
        {"high": F.col("own"), "asks": F.lit(False), "answers": F.lit(True)}).select(*row)
    return asks.unionByName(answers)


def near_links(classes: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """Links (a, b) that connect exactly the near copies among ``classes`` (node, smallest, n, bands), transitively."""
    rows = classes.select("node", F.col("n").cast("int"), F.posexplode("bands").alias("band", "value"))
    key = ["band", "value"]
    buckets = cut(rows.groupBy(*key).agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1"))
    # Most rows are alone in their bucket. A table of bounded size keeps them from being shuffled once more.
    bits = cut(buckets.select(F.pmod("value", F.lit(FILTER_BITS)).cast("int").alias("bit")).distinct())
    if bits.count() <= FILTERED:
        rows = rows.join(F.broadcast(bits), F.pmod("value", F.lit(FILTER_BITS)) == F.col("bit"), "left_semi")
    # Dealt out otherwise than the join needs, so that it deals both sides itself and may split a bucket with many rows.
    met = cut(rows.join(buckets.repartition(F.xxhash64(*key)), key).select(*key, "node", "n", "size", F.col("hub.node").alias("hub"), F.col("hub.n").alias("m")))
    sets = cut(_sets(texts, text, met.select("node").distinct()))
    links = _decided(met.where(F.expr(_FIT)).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets)

    # A bucket of two is decided; of buckets with the same members the first one stands for all.
    rooted = cut(_rooted(met.where("size > 2").select(*key, "node", "n", "size"), links))
    parts = rooted.groupBy(*key, "root").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("low"), F.max("node").alias("high"))
    apart = parts.groupBy(*key).agg(F.count("*").alias("roots"), F.sum("c").alias("size"), F.bit_xor("members").alias("members"),
                                    F.min("low").alias("low"), F.max("high").alias("high")).where("roots > 1")
    one = cut(apart.groupBy("members", "size", "low", "high").agg(F.min(F.struct(*key)).alias("k")).select("k.*", "low"))
    inside = cut(rooted.join(one.repartition(F.xxhash64(*key)), key).select(*key, "low", "node", "root", "n"))
    placed = cut(_dealt(inside)).join(sets, "node")
    more = placed.groupBy(*key, "low", "high").applyInArrow(_blocks, "a bigint, b bigint")
    return links.unionByName(cut(more))


def near_copies(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, component_id) of every row with a key; component_id is the smallest key that links reach.

    Words are runs of other characters than ASCII white space, A-Z counting as a-z. Null and empty texts and texts
    without words are copies of each other. Rows with a null key are left out and link nothing. Repeated rows share
    their component. An empty table gives an empty one; other columns are not read.
    """
    df = df.where(F.col(key).isNotNull())
    marked = cut(_marks(df, text, key))
    classes = cut(marked.groupBy("node").agg(F.min(key).alias("smallest"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    rooted = _rooted(classes.select("node", "smallest"), near_links(classes, df, text))
    smallest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    classed = rooted.join(smallest, "root").select("node", "component_id")
    return marked.join(classed, "node").select(key, "component_id")


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` without near copies; repeated rows and null keys as in ``one_of_components``."""
    return one_of_components(df, cut(near_copies(df, text, key)), key)
