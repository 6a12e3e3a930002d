import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pointweave.llm import fim

TEXTS = [None, "", "a", "ab", "two words", "é日\U0001F642 mixed é\n\nlines", "has <P> inside", "<S", "<M>", "almost <P <S <M > P>",
         "same", "same", "\n", " lead", "x" * 3000, "日本語 " * 40000, *[f"text number {i} <" + "S" * (i % 3) for i in range(60)]]


def plain(doc_id, text, per_unit=None):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    starts = [m.start() for m in re.finditer(per_unit or "(?s).", text)]
    n = len(starts)
    at = lambda k: 0 if k == 0 else starts[k] if k < n else len(text)
    a, b = sorted((at(h[0] % (n + 1)), at(h[1] % (n + 1))))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=400), st.data())
def test_ranks_are_counts(codes, data):
    matrix = fim.WaveletMatrix(np.array(codes, np.uint8))
    at = data.draw(st.integers(0, len(codes)))
    assert [int(matrix.rank(c, np.array([at]))[0]) for c in range(8)] == [codes[:at].count(c) for c in range(8)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\té日\U0001F642"), max_size=30), min_size=1, max_size=5), st.sampled_from([("char", "(?s)."), ("word", r"[^\x20\x09-\x0D]+")]))
def test_cuts_fall_where_units_begin(texts, unit):
    cutter = fim.Cutter([t.encode() for t in texts], unit[0])
    starts = [[m.start() for m in re.finditer(unit[1], t)] for t in texts]
    assert cutter.sizes().tolist() == [len(s) for s in starts]
    for k in range(max(map(len, starts)) + 1):
        units = np.array([min(k, len(s)) for s in starts])
        got = cutter.place(units) - cutter.starts
        for t, s, u, g in zip(texts, starts, units.tolist(), got.tolist()):
            assert g == len(t[:0 if u == 0 else s[u] if u < len(s) else len(t)].encode())


@pytest.mark.parametrize("unit", ["char", "word"])
def test_a_text_settled_at_the_end_of_a_full_word_of_bits_asks_for_nothing_beyond(unit):
    cutter = fim.Cutter([b"a" * 60, b"aaa"], unit)  # 63 bytes: the search in the first goes on when the second has come to its end
    assert cutter.place(np.array([1, 3])).tolist() == ([1, 63] if unit == "char" else [60, 63])


def test_rows_are_those_of_the_plain_version_and_are_restored(docs):
    df = docs(TEXTS).drop("n_chars").withColumnRenamed("lang", "Other Name")
    rows = fim.rearrange(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(TEXTS) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, TEXTS[r.doc_id])
        assert r.back == (TEXTS[r.doc_id] or "")


def test_words_null_keys_repeated_rows_and_empty_table(docs):
    df = docs(["one two  three\nfour", "five six"]).select(F.lit(None).cast("long").alias("doc_id"), "text")
    rows = fim.rearrange(df.unionByName(df), unit="word").collect()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(None, r.text, r"[^\x20\x09-\x0D]+")
    assert len(rows) == 4 and len(set(rows)) == 2
    assert fim.rearrange(docs([])).count() == 0
    with pytest.raises(ValueError, match="output"):
        fim.rearrange(docs(["x"]).withColumnRenamed("lang", "Output"))
