import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from pointweave.llm import overlaps


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_components(texts):
    """Smallest index reachable over all pairs with a Jaccard similarity of 0.8 or more."""
    sets = [plain_set(t) for t in texts]
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeÉÀ") for _ in range(rng.randint(1, 6)))
    out = [None, "", " \t\n", "One two", "one TWO", "two one", "a b c d e", "A b\tc d e", "a b c d f"]
    for _ in range(40):
        base = [word() for _ in range(rng.randint(20, 300))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(1, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    base = [word() for _ in range(100)]
    for _ in range(60):  # a large group at about the threshold
        copy = list(base)
        for at in rng.sample(range(100), 2):
            copy[at] = word()
        out.append(" ".join(copy))
    return out + ["long " * 70000, "long " * 70000 + "tail"]


def test_components_are_those_of_all_pairs(docs):
    rows = texts()
    got = {r.doc_id: r.component_id for r in overlaps.near_copies(docs(rows).withColumnRenamed("lang", "node")).collect()}
    want = plain_components(rows)
    assert 50 < len(set(want)) < len(rows) - 50
    assert [got[i] for i in range(len(rows))] == want


def crowd():
    """Two crowds of texts, each at about the threshold, whose members share many buckets."""
    rng, out = random.Random(3), []
    for size in (300, 120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(size):
            copy = list(base)
            for at in rng.sample(range(100), rng.randint(2, 5)):
                copy[at] = f"w{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


def test_a_member_of_many_buckets_is_sent_few_times(docs, monkeypatch):
    rows, sent, whole = crowd(), [], overlaps.cut

    def cut(df, *more):
        written = whole(df, *more)
        if "asks" in df.columns:
            sent.append(written.count())
        return written

    monkeypatch.setattr(overlaps, "cut", cut)
    got = {r.doc_id: r.component_id for r in overlaps.near_copies(docs(rows)).collect()}
    assert [got[i] for i in range(len(rows))] == plain_components(rows)
    assert 0 < max(sent) <= 4 * len(rows)


def test_any_two_open_members_of_a_bucket_meet_in_one_direction(docs, spark, monkeypatch):
    rng = random.Random(8)
    buckets = [rng.sample(range(30), 12) for _ in range(8)] + [rng.sample(range(100, 400), 60) for _ in range(3)] + [[500 + i, 530 + i, 560] for i in range(20)]
    rows = [(b % 24, b, min(nodes), i, i % 7 + 1000 * (i // 7 % 2), 50) for b, nodes in enumerate(buckets) for i in nodes]
    inside = spark.createDataFrame(rows, "band int, value long, low long, node long, root long, n int")
    for least in (4, 256):
        monkeypatch.setattr(overlaps, "LEAST", least), monkeypatch.setattr(overlaps, "MOST", least)
        groups = {}
        for r in overlaps._dealt(inside).collect():
            groups.setdefault((r.band, r.value, r.low, r.high), []).append(r)
        met = set()
        for members in groups.values():
            assert len({r.node for r in members}) == len(members) <= 8 * least
            met |= {frozenset((x.node, y.node)) for x in members if x.asks for y in members
                    if y.answers and x.root != y.root and (not y.outer or y.node > x.node)}
        root = {i: r for _, _, _, i, r, _ in rows}
        want = {frozenset((i, j)) for nodes in buckets for i in nodes for j in nodes if root[i] != root[j]}
        assert want <= met


def test_null_keys_repeated_rows_and_empty_table(docs):
    df = docs(["a b c d e f", "a b c d e f", "x y z"])
    df = df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))
    kept = overlaps.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 2]
    assert kept.where("doc_id is null").count() == 3
    assert overlaps.near_copies(docs([])).count() == 0
    assert overlaps.one_of_each(docs([])).count() == 0


def test_the_stage_drops_copies_whose_fingerprints_are_far_apart(docs, spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [" ".join(base)]
    for at in (15, 40, 60, 80, 105):
        rows.append(" ".join(base[:at] + ["other"] + base[at + 1:]))
    rows.append(" ".join(base[:60]))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs(rows), "").collect()}
    assert kept == {0, 6}
