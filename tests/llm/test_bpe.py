import gc
import hashlib
import random
import weakref

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from pointweave.llm import bpe, common

PATH = P.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
CODEC = bpe.Codec(PATH, P.PATTERN)
TEXTS = [None, "", " ", "  a\n\n b", "The thing's there's 12,345 things", "a" * 3000, "\x1c\x1d x\x85y z", "Ünïcode ŝtuff 日本語 🙂🙂",
         "<|endoftext|>", "x" * 255 + "yz" * 200, "same", "same", " 　tail \t", "word " * 5000]


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_ids_are_those_of_the_library_and_decode_back(texts):
    packed = CODEC.encode(texts)
    assert [ids(p) for p in packed] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert CODEC.decode(packed) == [t.encode() for t in texts]


def test_long_words_and_short_ones_merge_alike():
    rng = random.Random(5)
    words = ["".join(rng.choice("abetnrsio") for _ in range(n)).encode() for n in [1, 2, 3, 50, 200, 256] * 5]
    assert CODEC._contract(words) == [CODEC._long(w) for w in words]
    word = "".join(rng.choice("abet") for _ in range(5000))
    assert ids(CODEC.encode([word])[0]) == LIBRARY.encode_ordinary(word)


@pytest.mark.parametrize("alphabet, size, words", [
    ("的一是不了在人有我他这中大来上国个到说们", 20, 2000), ("的一是不了在人有我他这中大来上国个到说们", 10, 4000),
    ("abetnrsio", 60, 3000), ("abetnrsio", 200, 800), ("0123456789abcdef", 128, 800)])
def test_many_distinct_long_words_fit_the_memory(alphabet, size, words):
    rng = random.Random(size)
    text = " ".join("".join(rng.choice(alphabet) for _ in range(size)) for _ in range(words))
    packed = bpe.Codec(PATH, P.PATTERN).encode([text])
    assert ids(packed[0]) == LIBRARY.encode_ordinary(text)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3 * bpe.ENTRY + 30)
    small = bpe.Codec(PATH, P.PATTERN)
    for text in ["one two three four", "five six", "one two"]:
        assert ids(small.encode([text])[0]) == LIBRARY.encode_ordinary(text)


def test_rows(docs):
    df = docs(TEXTS).withColumnRenamed("lang", "Text_2")
    rows = {r.doc_id: r for r in bpe.digests(df, PATH, P.PATTERN).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = LIBRARY.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_two_passes_give_what_one_gives(docs):
    df = docs(TEXTS)
    one = {r.doc_id: r for r in bpe.encode_and_decode(df, PATH, P.PATTERN).collect()}
    two = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    assert one == two and len(one) == len(TEXTS)


def test_empty_table_clash_and_unknown_id(docs, spark):
    assert bpe.digests(docs([]), PATH, P.PATTERN).count() == 0
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(docs(["x"]).withColumnRenamed("lang", "IDS"), PATH, P.PATTERN)
    with pytest.raises(ValueError, match="vocabulary"):
        CODEC.decode([np.array([60000], "<u4").tobytes()])


def test_a_worker_keeps_the_tables_of_the_operator_that_worked_in_it_last():
    held = bpe.codec(PATH, P.PATTERN)
    own = bpe._coder(PATH, P.PATTERN, "text", True)
    batch = pa.RecordBatch.from_pydict({"text": ["one two", None]})
    assert [b["n_tokens"].to_pylist() for b in own([batch])] == [[2, 0]]
    assert bpe.codec(PATH, P.PATTERN) is held
    list(common.sliced([batch], "text"))
    gone = weakref.ref(held)
    del held, own
    gc.collect()
    assert gone() is None


def test_memory_is_bounded_after_a_huge_text(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 100 * bpe.ENTRY)
    small = bpe.Codec(PATH, P.PATTERN)
    text = " ".join(f"word{i}of" for i in range(5000))
    for t in ["a few words", text, "a few words"]:
        assert ids(small.encode([t])[0]) == LIBRARY.encode_ordinary(t)
    assert len(small.memory.young) + len(small.memory.old) < 300


def test_little_memory_gives_the_same_rows(docs):
    df = docs(TEXTS)
    one = {r.doc_id: r for r in bpe.encode_and_decode(df, PATH, P.PATTERN).collect()}
    two = {r.doc_id: r for r in bpe.encode_and_decode(df, PATH, P.PATTERN, remembered=500, at_a_time=100).collect()}
    assert one == two and len(one) == len(TEXTS)
