import itertools
import random

import numpy as np
import pytest

from pointweave.llm import language

STEMS = {"aa": ["the", "ing", "tion", "er", "wh"], "bb": ["ção", "que", "os", "ll", "ñe"], "cc": ["ий", "ов", "ста", "про"]}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(prose(lang, 80, rng), lang) for lang in STEMS for _ in range(20)] + [(None, "aa"), ("text", None)]
    return language.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_held_out_texts_and_spans_of_mixed_ones(docs, model):
    rng = random.Random(2)
    texts = [prose(lang, rng.randint(4, 60), rng) for lang in STEMS for _ in range(20)]
    a, b, c = (prose(lang, 40, rng) for lang in STEMS)
    got = {r.doc_id: r for r in language.identify(docs([*texts, f"{a} {b} {b} {c}"]), model).collect()}
    assert [got[i].lang_pred for i in range(60)] == [lang for lang in STEMS for _ in range(20)]
    mixed = got[60]
    assert mixed.lang_pred == "bb" and [s.lang for s in mixed.lang_spans] == ["aa", "bb", "cc"]
    whole = f"{a} {b} {b} {c}"
    assert whole[mixed.lang_spans[2].start:mixed.lang_spans[2].end] == c.rstrip(".")


def test_edges(docs, model, spark):
    texts = [None, "", " 12 %% \n", "the", "the", "日本語", "İİ the ẞ", "ing " * 60000]
    got = {r.doc_id: r for r in language.identify(docs(texts), model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].lang_score == 0 for i in range(3))
    assert all(got[i].lang_pred in STEMS for i in range(3, 8)) and got[3][5:] == got[4][5:]
    assert language.identify(docs([]), model).count() == 0
    nothing = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert language.identify(docs(["the"]), nothing).first().lang_pred == "und"
    with pytest.raises(ValueError, match="lang_pred"):
        language.identify(docs(["x"]).withColumnRenamed("source", "LANG_PRED"), model)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    for n in range(1, 7):
        for _ in range(20):
            s = rng.normal(size=(n, 3)) * 8
            value = lambda p: s[range(n), p].sum() - 15.0 * sum(a != b for a, b in zip(p, p[1:]))
            best = max(map(value, map(list, itertools.product(range(3), repeat=n))))
            assert abs(value(list(language.viterbi(s, 15.0))) - best) < 1e-9
