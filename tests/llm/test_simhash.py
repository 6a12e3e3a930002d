import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pointweave.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Smallest index reachable over pairs within three bits."""
    root = list(range(len(fps)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeÉÀ") for _ in range(rng.randint(1, 5)))
    out = [None, "", " \t\n", "One two", "one TWO", "one two three", "\x1cone \x85two three"]
    for _ in range(30):
        base = [word() for _ in range(rng.randint(60, 200))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out + ["long " * 70000, "long " * 70000 + "tail"]


def test_fingerprints_and_components_are_those_of_brute_force(docs):
    rows = texts()
    fps = [plain_fingerprint(t) for t in rows]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(rows).withColumnRenamed("lang", "fp")).withColumn(
        "hex", simhash.as_hex(F.col("fp"))).collect()}
    assert [got[i].hex for i in range(len(rows))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(rows))] == plain_components(fps)


@pytest.mark.parametrize("bucket", [2, 7, 4096])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    fps = []
    for _ in range(4):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(60):
            f = centre
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    index = {s: i for i, s in enumerate(signed)}
    root = list(range(len(fps)))
    find = lambda i: i if root[i] == i else find(root[i])
    for r in links:
        a, b = find(index[r.a]), find(index[r.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == plain_components(fps)


def test_null_keys_repeated_rows_and_empty_table(docs, spark):
    df = docs(["a b c d", "a b c d", "x y z"])
    df = df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 2]
    assert kept.where("doc_id is null").count() == 3
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.one_of_each(docs([])).count() == 0
