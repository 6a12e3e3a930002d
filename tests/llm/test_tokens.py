import public_tokenizers as P
import pytest
import sentencepiece

from pointweave.llm import tokens

PATH = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [None, "", " ", "  a  b ", "<s>hi</s> <unk>", "ﬁ ２ ① 日本語", "same text", "same text", "▁x ▁▁y", "word " * 30000, "a\x00b"]


def test_counts_are_those_of_the_library_and_the_cache_is_reused(docs, folder, monkeypatch):
    cache = folder("cache")
    got = {r.doc_id: r for r in tokens.count_tokens(docs(TEXTS), PATH, cache).collect()}
    assert {i: (r.n_bytes, r.n_tokens) for i, r in got.items()} == {
        i: (len((t or "").encode()), len(LIBRARY.encode(t or ""))) for i, t in enumerate(TEXTS)}
    held = tokens.stored_counts(docs([]).sparkSession, cache)
    assert held.count() == len({t or "" for t in TEXTS})
    # A second run encodes the new text alone.
    tokens.count_tokens(docs([*TEXTS, "new text"]), PATH, cache).collect()
    assert held.sparkSession.read.parquet(cache).count() == len({t or "" for t in TEXTS}) + 1


def test_empty_table_and_clash(docs, folder):
    assert tokens.count_tokens(docs([]), PATH, folder("none")).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        tokens.count_tokens(docs(["x"]).withColumnRenamed("lang", "N_Tokens"), PATH, folder("clash"))
