import random

import numpy as np

from pointweave.llm import tiling
from pointweave.llm.shingles import tokens

ITEMS = "item_id long, text string, source string, coverage int"


def plain_tiles(doc, item, shortest):
    """Greedy tiling by trying every pair of places."""
    doc, item = list(doc), list(item)
    used_d, used_i, covered = set(), set(), 0
    while True:
        best, found = shortest - 1, []
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in used_d and q + n not in used_i:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= shortest:
                    found.append((p, q))
        if not found:
            return covered
        for p, q in found:
            if not any(p + k in used_d or q + k in used_i for k in range(best)):
                used_d.update(range(p, p + best)), used_i.update(range(q, q + best))
                covered += best


def test_tiles_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        doc = rng.integers(0, 3, rng.integers(1, 40)).astype(np.uint64)
        item = rng.integers(0, 3, rng.integers(1, 25)).astype(np.uint64)
        shortest = min(int(rng.integers(2, 6)), len(item))
        got = tiling.tiles(doc, item, shortest)
        assert sum(n for *_, n in got) == plain_tiles(doc, item, shortest)
        assert all((doc[p:p + n] == item[q:q + n]).all() for p, q, n in got)


def test_leaks(docs, spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    noise = lambda n: " ".join(word() for _ in range(n))
    items = [noise(40) for _ in range(5)]
    w = items[0].split()
    halves = " ".join(w[20:]) + " " + noise(5) + " " + " ".join(w[:20]).upper()
    edited = " ".join(x if i % 9 else word() for i, x in enumerate(items[1].split()))
    scattered = " ".join(x if i % 4 else word() for i, x in enumerate(items[1].split()))
    texts = [None, "", noise(300), noise(10) + "\n" + items[0] + " " + noise(10), halves, edited, scattered, " ".join(items[2].split()[:18]),
             items[3] + " " + items[4], "short item here", noise(40000) + " " + items[2], items[3], items[3]]
    bench = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(items)] + [(3, items[3], "s", 1), (7, "short item", "s", 1), (8, "", "s", 1), (9, None, "s", 1),
                                  (None, items[4], "s", 1)], ITEMS)
    df = docs(texts).withColumnRenamed("lang", "item_id")
    got = {(r.doc_id, r.item_id) for r in tiling.leaks(df, bench).collect()}
    assert got == {(3, 0), (4, 0), (5, 1), (8, 3), (8, 4), (9, 7), (10, 2), (11, 3), (12, 3)}
    rows = tiling.leaks(df, bench).where("doc_id = 4").first()
    assert (rows.n_words, rows.n_covered, len(rows.tiles)) == (40, 40, 2)
    kept = tiling.without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 6, 7]


def test_a_document_that_holds_very_many_items(docs, spark, monkeypatch):
    monkeypatch.setattr(tiling, "ITEMS", 4)
    items = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(50)]
    bench = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(items)], ITEMS)
    df = docs([" ".join(items), items[7], "nothing"])
    assert {(r.doc_id, r.item_id) for r in tiling.leaks(df, bench).collect()} == {(0, i) for i in range(50)} | {(1, 7)}


def test_many_seeds_need_no_bitmap_and_empty_tables(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(1, "one two three four five six seven", "s", 1)], ITEMS)
    df = docs(["zero one two three four five six seven eight", "one two three"])
    monkeypatch.setattr(tiling, "FILTERED", 0)
    assert [r.doc_id for r in tiling.leaks(df, bench).collect()] == [0]
    monkeypatch.undo()
    assert tiling.leaks(docs([]), bench).count() == 0
    assert tiling.leaks(df, bench.limit(0)).count() == 0


def test_word_hashes_tell_texts_and_words_apart():
    found = tokens([b"a b", b"", b"A\tB c", b"ab"])
    assert found.first.tolist() == [0, 2, 2, 5, 6]
    assert found.hash[0] == found.hash[2] and found.hash[1] == found.hash[3] and len(set(found.hash.tolist())) == 4
    start, h = found.windows(2)
    assert start.tolist() == [0, 2, 3] and h[0] == h[1] != h[2]
