"""Near duplicates by SimHash and deletion-variant signatures.

A 64-bit fingerprint is cut into two segments, so of two fingerprints that differ in at most three bits one
segment differs in at most one. Every segment is indexed under its 32 one-wildcard variants; fingerprints that
meet in a bucket are verified. Only distinct fingerprints are indexed, so copies cost one row. A bucket is
streamed from its sorted partition and leaves a forest of its links, never all pairs. A bucket of more than
``BUCKET`` fingerprints is not compared at once: its members are indexed again by quarters of the bits that the
bucket leaves open (three differences leave one quarter equal), up to three times, after which 14 open bits bound
a bucket to 16,384 members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pointweave.llm.common import bytes_of, one_of_components, sliced
from pointweave.operators.components import component_roots, contract
from pointweave.session import cut

SHINGLE = 3  # words
SEED = 42
NEAR = 3  # differing bits
BUCKET = 4096  # fingerprints compared within one bucket
DEPTH = 3  # times that a crowded bucket is indexed anew
HASHES_AT_A_TIME = 1 << 16
PAIRS_AT_A_TIME = 1 << 20
_LOW = 0xFFFFFFFF


def fingerprint(text: bytes) -> int:
    """SimHash of the word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()
    n = len(words) - SHINGLE + 1
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_A_TIME):
        stop = min(n, at + HASHES_AT_A_TIME)
        hashes = np.array([digest(joined[a:b - 1], SEED) for a, b in zip(starts[at:stop], ends[at + SHINGLE - 1:stop + SHINGLE - 1])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp) of every row; fp holds the 64 bits as a signed long."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches, text):
            bits = np.array([fingerprint(t) for t in bytes_of(batch, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(bits)], names=[key, "fp"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def _variants(fps: DataFrame) -> DataFrame:
    """64 rows (slot, fixed, fp) for each fingerprint: ``fixed`` marks the bits of a segment but for the wildcard."""
    segment = F.when(F.col("slot") < 32, F.lit(_LOW)).otherwise(F.lit(-(1 << 32)))
    wild = F.expr("shiftleft(1L, slot)")
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot")).select(
        "slot", segment.bitwiseAND(F.bitwise_not(wild)).alias("fixed"), "fp")


def _by_bucket(rows: DataFrame) -> DataFrame:
    value = F.col("fp").bitwiseAND(F.col("fixed"))
    return (rows.repartition("slot", "fixed", value).withColumn("value", value)
            .sortWithinPartitions("slot", "fixed", "value"))


def _quarters(fixed: int) -> list[int]:
    """Masks that add each quarter of the open bits to the fixed ones."""
    open_bits = [b for b in range(64) if not fixed >> b & 1]
    return [fixed | sum(1 << int(b) for b in part) for part in np.array_split(open_bits, NEAR + 1)]


def _links(slot: np.ndarray, run: np.ndarray, fp: np.ndarray):
    """Forests of the links between rows of the same run; every link counts in one slot of a segment only.

    Equal segments meet under all 32 wildcards and count under the first; segments that differ in a bit meet
    under that bit.
    """
    last = np.searchsorted(run, run, side="right") - 1
    left, right, held = [], [], 0
    at, step = np.flatnonzero(last > np.arange(len(run))), 1
    segment = np.where(slot < 32, np.uint64(_LOW), np.uint64(_LOW << 32))
    wild = np.uint64(1) << slot.astype(np.uint64)
    while len(at):
        differ = fp[at] ^ fp[at + step]
        within = differ & segment[at]
        near = (np.bitwise_count(differ) <= NEAR) & ((within == wild[at]) | ((within == 0) & (slot[at] % 32 == 0)))
        if near.any():
            left.append(fp[at[near]].view(np.int64)), right.append(fp[at[near] + step].view(np.int64))
            held += int(near.sum())
            if held >= PAIRS_AT_A_TIME:
                a, b = contract(np.concatenate(left), np.concatenate(right))
                left, right, held = [a], [b], len(a)
        step += 1
        at = at[at + step <= last[at]]
    return contract(np.concatenate(left), np.concatenate(right)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_SCANNED = "slot int, fixed bigint, a bigint, b bigint"  # a link a-b, or with null b a member of a crowded bucket


def _scan(bucket: int | None):
    """Read sorted buckets: links of those within ``bucket`` members, the others' members to be indexed anew."""

    def out(slot, fixed, a, b=None):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(slot, pa.int32()), pa.array(fixed, pa.int64()), pa.array(a, pa.int64()),
             pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64())], names=["slot", "fixed", "a", "b"])

    def linked(slot, fixed, value, fp):
        change = np.r_[False, (slot[1:] != slot[:-1]) | (fixed[1:] != fixed[:-1]) | (value[1:] != value[:-1])]
        a, b = _links(slot, np.cumsum(change), fp)
        if len(a):
            zeros = np.zeros(len(a), np.int64)
            yield out(zeros, zeros, a, b)

    def anew(slot, fixed, value, fp):
        for mask in _quarters(int(fixed[0]) & (1 << 64) - 1):
            signed = mask - (1 << 64) if mask >> 63 else mask
            yield out(slot, np.full(len(fp), signed), fp.view(np.int64))

    def run(batches):
        held: tuple[np.ndarray, ...] | None = None
        crowded = None  # the bucket whose members pass on
        for batch in batches:
            new = tuple(batch[c].to_numpy() for c in ("slot", "fixed", "value")) + (batch["fp"].to_numpy().view(np.uint64),)
            if not len(new[0]):
                continue
            now = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            start = len(same) - int(same[::-1].argmin()) if not same.all() else 0  # of the bucket that may go on
            done, held = tuple(x[:start] for x in now), tuple(x[start:] for x in now)
            if crowded is not None and len(done[0]):
                first = (done[0] == crowded[0]) & (done[1] == crowded[1]) & (done[2] == crowded[2])
                n = int(first.argmin()) if not first.all() else len(first)
                if n:
                    yield from anew(*(x[:n] for x in done))
                done, crowded = tuple(x[n:] for x in done), None
            if len(done[0]):
                yield from big_apart(*done)
            if bucket and (len(held[0]) > bucket or crowded is not None):
                yield from anew(*held)
                crowded = tuple(x[-1] for x in held[:3])
                held = None
        if held is not None:
            yield from big_apart(*held)

    def big_apart(*rows):
        """Whole buckets; one batch may hold several that are too large."""
        slot, fixed, value, fp = rows
        change = np.flatnonzero((slot[1:] != slot[:-1]) | (fixed[1:] != fixed[:-1]) | (value[1:] != value[:-1])) + 1
        edges = np.r_[0, change, len(slot)]
        sizes = np.diff(edges)
        large = np.flatnonzero(sizes > bucket) if bucket else np.zeros(0, int)
        for k in large:
            yield from anew(*(x[edges[k]:edges[k + 1]] for x in rows))
        keep = np.repeat(~np.isin(np.arange(len(sizes)), large), sizes)
        if keep.any():
            yield from linked(*(x[keep] for x in rows))

    return run


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly those within ``NEAR`` bits, transitively."""
    rows, links = _variants(fps), None
    for depth in range(DEPTH + 1):
        scanned = cut(_by_bucket(rows).mapInArrow(_scan(BUCKET if depth < DEPTH else None), _SCANNED))
        found = scanned.where(F.col("b").isNotNull()).select("a", "b")
        links = found if links is None else links.unionByName(found)
        members = scanned.where(F.col("b").isNull())
        if members.isEmpty():
            break
        rows = members.select("slot", "fixed", F.col("a").alias("fp"))
    return links


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id) of every row; component_id is the smallest key that links reach.

    Null and empty texts and texts without words have fingerprint zero and link like any other. Repeated rows
    share their component. A row with a null key takes part in links but names no component: where all keys of
    a component are null, so is component_id. An empty table gives an empty one; other columns are not read.
    """
    marked = cut(fingerprints(df, text, key))
    classes = marked.groupBy("fp").agg(F.min(key).alias("smallest"))
    roots = component_roots(near_links(classes.select("fp")))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "smallest", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    classed = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(classed, "fp").select(key, "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the row with the smallest key stays.

    Of repeated rows with that key one stays. Rows with a null key cannot be named, so all of them stay.
    """
    return one_of_components(df, cut(near_duplicates(df, text, key)), key)
