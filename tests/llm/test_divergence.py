import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pointweave.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def plain(rows, least=10):
    """Every row of the audit of rows (text, lang, source), from dense counts."""
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words, lang, source = plain_terms(text), lang or "", source or ""
        groups[lang].add(source)
        held[lang].update(set(words))
        counts[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(total)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            words = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", words)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i) for i, (v, item) in enumerate(found, 1) if part == "pair" or i <= 10}
    return out


def corpus(n=400, sources=9):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeFGé日") for _ in range(rng.randint(1, 6))) for _ in range(150)] + ["long" * 40, "LONG" * 41]
    rows = [(None, None, None), ("", "", ""), (" 1 2 _ ", "en", "only"), (None, "en", "s0"), ("x y z", "few", None), ("x", "few", "b"), ("a" * 200, "few", "c")]
    for _ in range(n):
        s = rng.randrange(sources)
        words = rng.choices(vocabulary, [1 + (i * (s + 1)) % 17 for i in range(len(vocabulary))], k=rng.randint(0, 40))
        rows.append((rng.choice([" ", "1", "_", "\n", "\x00"]).join(words), rng.choice(["en", "en", "de", None]), f"s{s}" if s else None))
    rows += [rows[-1]] * 12 + [("a b " * 60000, "en", "s1")]
    return rows


DDL = "text string, lang string, source string"


def rows_of(df):
    return {(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()}


def test_rows_are_those_of_the_plain_version(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DDL).withColumns({"term": F.lit("clash"), "shard": F.lit(1)})
    got = D.audit(df)
    assert rows_of(got) == plain(rows) and got.count() == len(plain(rows))


def test_many_rounds_blocks_and_flushes_give_the_same_rows(spark, monkeypatch):
    rows = corpus(sources=23)
    for name, value in dict(SHARD_KEYS=40, ROUND=2, HELD=30, SLOT_BYTES=2000, BLOCK=4).items():
        monkeypatch.setattr(D, name, value)
    assert rows_of(D.audit(spark.createDataFrame(rows, DDL))) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [("a", "en", "x"), ("b", "en", "y")]])
def test_tables_without_frequent_terms(spark, rows):
    assert rows_of(D.audit(spark.createDataFrame(rows, DDL))) == plain(rows)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=90), max_size=300), st.sets(st.binary(min_size=1, max_size=90), max_size=50))
def test_perfect_hashes_find_their_keys_and_no_other(keys, others):
    stored = [D._key(b"en", k) for k in sorted(keys)]
    rows, n_shards = [], 4
    for shard in range(n_shards):
        own = [k for k in stored if int(D._hashes([k])[0][0]) % n_shards == shard]
        if own:
            sizes, bits, order = D.build(*D._hashes(own))
            assert sorted(order.tolist()) == list(range(len(own)))
            rows.append({"shard": shard, "sizes": sizes, "bits": np.packbits(bits, bitorder="little").tobytes(), "stored": [own[i] for i in order], "langs": ["en"] * len(own)})
    kind = pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("stored", pa.list_(pa.binary())), ("langs", pa.list_(pa.string()))])
    held = D.Round(pa.Table.from_pylist(rows, kind), n_shards)
    asked = [D._key(b"en", k) for k in sorted(keys | others)]
    found, slot = held.find(asked)
    assert [asked[i] for i in found.tolist()] == [k for k in asked if k in set(stored)]
    assert sorted(slot.tolist()) == list(range(len(stored)))


def test_shares_of_huge_counts_are_exact(spark):
    n, total, kept = 3 * 10 ** 12, 10 ** 15, 10 ** 7
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(D._share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).first()
    assert row.p == 1 + 1000000000 * (n + 2) // (total + 2 * kept)
