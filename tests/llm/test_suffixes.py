import random
from collections import defaultdict

from pyspark.sql import functions as F

from pointweave.llm import suffixes


def plain(texts):
    held, words = defaultdict(set), {}
    for i, t in enumerate(texts):
        w = words[i] = (t or "").lower().split()
        for a in range(len(w) - 49):
            held[tuple(w[a:a + 50])].add(i)
    out = {}
    for i, w in words.items():
        inside = set()
        for a in range(len(w) - 49):
            if len(held[tuple(w[a:a + 50])]) > 1:
                inside.update(range(a, a + 50))
        if inside:
            spans = []
            for p in sorted(inside):
                if spans and spans[-1][1] == p:
                    spans[-1][1] = p + 1
                else:
                    spans.append([p, p + 1])
            out[i] = [tuple(s) for s in spans]
    return out


def texts():
    rng = random.Random(7)
    noise = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(n))
    out = [None, "", "short", noise(49), "the " * 500, "The " * 130 + noise(30), noise(20000)]
    for n in (49, 50, 51, 52, 60, 75, 200):
        p = noise(n)
        out += [noise(rng.randint(0, 60)) + " " + p + " " + noise(rng.randint(0, 60)), p.upper() + "\n" + noise(9), noise(5) + "\t" + p]
        w = p.split()
        out.append(noise(3) + " " + " ".join(w[:n // 2]) + " x " + " ".join(w[n // 2:]))
        out.append(" ".join(w[10:]) + " " + noise(30))
    q = noise(55)
    out += [q + " " + noise(2) + " " + q, noise(70) + " " + q, out[6], " ".join(out[6].split()[500:700])]
    a, b, c = noise(100).split(), noise(100).split(), noise(100).split()
    out += [" ".join(a + b), " ".join(b + c), " ".join(a[60:] + b[:15] + c[:5])]
    return out


def test_spans_are_those_of_brute_force(docs):
    rows = texts()
    df = docs(rows).withColumnRenamed("lang", "place").withColumnRenamed("source", "passage")
    got = {r.doc_id: r for r in suffixes.repeats(df).collect()}
    want = plain(rows)
    assert {i: [(s.start, s.end) for s in r.spans] for i, r in got.items()} == want
    assert all(r.n_repeated == sum(b - a for a, b in want[i]) for i, r in got.items())


def test_repeated_rows_null_ids_and_empty_table(docs):
    long = " ".join(f"w{i}" for i in range(80))
    df = docs([long, "x", long + " end"])
    again = df.where("doc_id = 0")
    assert suffixes.repeats(again.unionByName(again)).count() == 0
    assert suffixes.repeats(df.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))).count() == 0
    assert sorted(r.doc_id for r in suffixes.repeats(df.unionByName(again)).collect()) == [0, 2]
    assert suffixes.repeats(docs([])).count() == 0


def test_an_id_on_two_texts(docs):
    long = " ".join(f"w{i}" for i in range(300))
    df = docs(["a short text", long, long + " end", "a short text"])  # a short one comes last, whatever the order
    df = df.withColumn("doc_id", F.when(F.col("doc_id") == 1, F.lit(0)).otherwise(F.lit(2)).cast("long")).coalesce(1)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffixes.repeats(df).collect()}
    assert got == {0: [(0, 300)], 2: [(0, 300)]}


def test_neighbours_across_the_borders_of_ranges(docs, spark):
    rng = random.Random(3)
    rows = [(bytes([rng.randrange(40)]) * 3, i, 0) for i in range(60)] + [(b"\x50" * 3, i, 1) for i in range(90)]
    df = spark.createDataFrame(rows, "suffix binary, doc_id long, place int")
    times = defaultdict(int)
    for suffix, _, _ in rows:
        times[suffix] += 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (1, 7, 200):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sorted((r.doc_id, r.place) for r in suffixes.neighbours(df).collect())
        assert got == sorted((i, p) for s, i, p in rows if times[s] > 1)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert suffixes.neighbours(df.limit(0)).count() == 0


def test_a_passage_at_every_place_and_length(docs):
    rng = random.Random(11)
    noise = lambda n: [f"{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for n in range(48, 58):
        p = noise(n)
        rows += [" ".join(noise(rng.randint(0, 45)) + p + noise(rng.randint(0, 45))) for _ in range(4)]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffixes.repeats(docs(rows)).collect()}
    assert got == plain(rows)
