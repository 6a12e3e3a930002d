import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pointweave.llm import mixing


words = lambda text: re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), epochs=2):
    """Shares by weight, cut at the cap and shared out again until none is above it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= epochs * sizes[s]}
        if not over:
            out.update({s: left * weight[s] / total for s in free})
            break
        out.update({s: Fraction(epochs * sizes[s]) for s in over})
        left -= sum(out[s] for s in over)
        free -= over
    return out


def plain(rows):
    """(doc_id, size, source_size, target, taken) of rows (doc_id, text, source), one by one in their random order."""
    sized = [(d, s, len(words(t))) for d, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n in sized:
        sizes[s] += n
    target = plain_targets(sizes)
    place = lambda d: hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest()[:16]
    out = []
    for source, size in sizes.items():
        own = sorted((place(d), d is not None, d or 0, n) for d, s, n in sized if s == source)
        left, taken = int(target[source]), [0] * len(own)
        while size and left:
            for i, row in enumerate(own):
                step = min(left, row[3])
                taken[i] += step
                left -= step
        out += [(row[2] if row[1] else None, row[3], size, round(float(target[source]), 6), t) for row, t in zip(own, taken)]
    return Counter(out)


ROWS = [
    (1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (4, " \t\n", None), (5, "one two\xa0three four", None), (6, "w " * 5000, "x"),
    (7, "b c", "é"), (7, "b c", "é"), (7, "b c d", "é"), (None, "q r s", "x"), (None, "q r s t", "x"), (8, "z", ""), (9, "k " * 40, "\U0001F600"),
    *[(100 + i, "m n o p " * (i % 7), "big") for i in range(200)],
]
DDL = "doc_id long, text string, source string"


def rows_of(planned):
    return Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in planned.collect())


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=2)), st.integers(0, 50), max_size=7))
def test_shares_of_the_plain_version_add_up(sizes):
    out = plain_targets(sizes)
    assert sum(out.values()) == Fraction(3, 2) * sum(sizes.values()) and all(out[s] <= 2 * sizes[s] for s in out)


def test_every_row_is_that_of_the_plain_version(spark):
    df = spark.createDataFrame(ROWS, DDL).withColumns({"size": F.lit("clash"), "content": F.lit(1)})
    want = plain(ROWS)
    assert rows_of(mixing.plan(df)) == want == rows_of(mixing.plan(df.repartition(7)))


def test_sources_with_many_caps(spark):
    rows = [(i, "w " * (1 + (i * 37) % 11 if i % 4 else 400), f"s{i % 13}") for i in range(150)]
    assert rows_of(mixing.plan(spark.createDataFrame(rows, DDL))) == plain(rows)


def test_one_document_in_many_copies_is_split(spark):
    rows = [(1, "a b c", "x")] * 300 + [(2, "d", "y")]
    planned = mixing.plan(spark.createDataFrame(rows, DDL))
    assert rows_of(planned) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, None, "b")]])
def test_tables_without_words(spark, rows):
    planned = mixing.plan(spark.createDataFrame(rows, DDL)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in planned] == [(0, 0, 0.0, 0)] * len(rows)


def test_shares_above_the_caps_take_everything(spark):
    planned = mixing.plan(spark.createDataFrame(ROWS, DDL), share=(9, 1), epochs=3).collect()
    assert all(r.taken == 3 * r["size"] for r in planned)


def test_the_mix_holds_the_words_taken(spark):
    df = spark.createDataFrame(ROWS, DDL).withColumn("body", F.lit("clash"))
    planned = mixing.plan(df)
    mixed = mixing.mixed_texts(df, planned).collect()
    got, want = defaultdict(int), defaultdict(int)
    for r in mixed:
        got[r.source] += len(words(r.text))
    for r in planned.collect():
        want[r.source] += r.taken
    assert got == {s: n for s, n in want.items() if n}
    whole = {(t or "") for _, t, _ in ROWS}
    cut = [r for r in mixed if r.text not in whole]
    assert len({r.source for r in cut}) == len(cut)  # at most one text of a source is cut
    assert all(any(" ".join(words(t)).startswith(r.text) for t in whole) for r in cut)
    assert mixing.mixed_texts(df.limit(0), mixing.plan(df.limit(0))).count() == 0
