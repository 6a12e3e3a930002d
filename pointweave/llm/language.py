"""Language identification of whole texts and of their spans.

Words are runs of letters. The script of a word narrows its candidate languages; character trigrams score it
under each of them; a Viterbi pass over the words with a penalty for switching labels spans, so a text in several
languages is cut where they change. The text's language is the one with most letters.

Counts cover every learned row. The model is a table of ``BUCKETS`` hashed trigrams for each language, so its
size depends on the number of languages only.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pointweave.llm.common import schema_with, sliced, texts_of, with_columns

BUCKETS = 1 << 16
SMOOTHING = 0.5
SWITCH = 15.0  # nats a change of language costs
USED = 0.01  # share of a language's words from which on a script counts as one of its own
IMPLAUSIBLE = -100.0  # nats of a word whose script the language does not use
UNDETERMINED = "und"

# First code point, end and name of the ranges of common scripts.
SCRIPTS = (
    (0x41, 0x250, "Latin"), (0x370, 0x400, "Greek"), (0x400, 0x530, "Cyrillic"), (0x530, 0x590, "Armenian"),
    (0x590, 0x600, "Hebrew"), (0x600, 0x780, "Arabic"), (0x900, 0x980, "Devanagari"), (0x980, 0xA00, "Bengali"),
    (0xB80, 0xC00, "Tamil"), (0xE00, 0xE80, "Thai"), (0x10A0, 0x1100, "Georgian"), (0x1100, 0x1200, "Hangul"),
    (0x1E00, 0x1F00, "Latin"), (0x1F00, 0x2000, "Greek"), (0x3040, 0x3100, "Kana"), (0x3400, 0xA000, "Han"),
    (0xAC00, 0xD7B0, "Hangul"),
)
_NAMES = ["other", *dict.fromkeys(name for *_, name in SCRIPTS)]


@functools.lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case where that is one character, its script."""
    points = range(0x110000)
    letter = np.fromiter((chr(p).isalpha() for p in points), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for p in np.flatnonzero(letter).tolist():
        c = chr(p).lower()
        if len(c) == 1:
            lower[p] = ord(c)
    script = np.zeros(0x110000, np.uint8)
    for first, end, name in SCRIPTS:
        script[first:end] = _NAMES.index(name)
    return letter, lower, script


@dataclass
class Words:
    """The words of several texts: code point spans, trigram buckets, scripts, and where each text's words begin."""

    start: np.ndarray
    size: np.ndarray
    buckets: np.ndarray  # of all words, as many for each as it has letters
    script: np.ndarray
    first: np.ndarray  # by text, with the end behind the last
    offset: np.ndarray  # code points before each text


def words(texts: list[str]) -> Words:
    letter, lower, script = _characters()
    points = np.frombuffer(("  " + "\n".join(texts) + "  ").encode("utf-32-le", "replace"), "<u4")
    is_letter = letter[points]
    c = np.where(is_letter, lower[points], np.uint32(32))
    change = np.flatnonzero(is_letter[1:] != is_letter[:-1]) + 1
    start, end = change[::2], change[1::2]
    mixed = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D))
    mixed = ((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    buckets = mixed[is_letter[1:-1]]  # trigrams that begin one before a letter
    sizes = np.array([len(t) + 1 for t in texts])
    offset = np.r_[0, np.cumsum(sizes)[:-1]] + 2
    first = np.searchsorted(start, np.r_[offset, len(points)])
    return Words(start, end - start, buckets, script[points[start]], first, offset)


def count_features(learned: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, feature, n) over every row with a language; features beyond ``BUCKETS`` count words by script."""
    width = BUCKETS + len(_NAMES)

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in sliced(batches, text):
            found, langs = words(texts_of(batch, text)), batch[lang].to_pylist()
            ends = np.r_[0, np.cumsum(found.size)]
            names = sorted(set(langs))
            index = np.array([names.index(x) for x in langs])
            of_word = np.repeat(index, np.diff(found.first))
            of_bucket = np.repeat(of_word, found.size)
            n = np.bincount(of_bucket * width + found.buckets, minlength=len(names) * width)
            n += np.bincount(of_word * width + BUCKETS + found.script, minlength=len(names) * width)
            assert ends[-1] == len(found.buckets)
            for k, name in enumerate(names):
                own = n[k * width:(k + 1) * width]
                total[name] = own + total[name] if name in total else own
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))],
                                             names=["lang", "feature", "n"])

    rows = learned.select(F.col(text).alias(text), F.col(lang).alias(lang)).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return rows.mapInArrow(run, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (BUCKETS, languages), log probabilities
    candidates: np.ndarray  # (scripts, languages)


def fit(learned: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from rows with a text and a language. At most ``BUCKETS`` and a few counts a language reach the driver."""
    counts = count_features(learned, text, lang).toArrow().sort_by([("lang", "ascending"), ("feature", "ascending")])
    names = counts["lang"].to_pylist()
    langs = sorted(set(names))
    n = np.zeros((BUCKETS + len(_NAMES), len(langs)))
    n[counts["feature"].to_numpy(), np.searchsorted(langs, names) if names else np.zeros(0, int)] = counts["n"].to_numpy()
    grams, scripts = n[:BUCKETS] + SMOOTHING, n[BUCKETS:]
    share = scripts / np.maximum(1, scripts.sum(axis=0))
    return Model(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), share >= USED)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; ties go to staying, then to the first language."""
    total = scores.sum(axis=0)
    best = int(total.argmax())
    # No stretch gains half a switch under another language: then no path with switches beats a single language.
    gain = np.cumsum(np.vstack([np.zeros(scores.shape[1]), scores - scores[:, best:best + 1]]), axis=0)
    if ((gain - np.minimum.accumulate(gain, axis=0)).max(axis=0) <= switch / 2).all():
        return np.full(len(scores), best)
    value, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(value)
        at, floor = value.index(top), top - switch
        back.append([k if v >= floor else at for k, v in enumerate(value)])
        value = [(v if v >= floor else floor) + s for v, s in zip(value, row)]
    label = value.index(max(value))
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return np.array(out[::-1])


def _label(model: Model, texts: list[str]):
    """Per text: language, score and spans."""
    found = words(texts)
    languages = len(model.langs)
    if len(found.start) and languages:
        per_letter = model.scores[found.buckets].astype(np.float64)
        scores = np.add.reduceat(per_letter, np.r_[0, np.cumsum(found.size)[:-1]], axis=0)
        allowed = model.candidates[found.script]
        none = ~allowed.any(axis=1)
        scores = np.where(none[:, None], 0.0, np.where(allowed, scores, scores.max(axis=1, keepdims=True) + IMPLAUSIBLE))
    for k in range(len(texts)):
        a, b = found.first[k], found.first[k + 1]
        if a == b or not languages:
            yield UNDETERMINED, 0.0, []
            continue
        labels = viterbi(scores[a:b])
        letters = np.bincount(labels, weights=found.size[a:b], minlength=languages)
        best = int(letters.argmax())
        edges = np.r_[0, np.flatnonzero(labels[1:] != labels[:-1]) + 1, b - a]
        start, size = found.start[a:b] - found.offset[k], found.size[a:b]
        spans = [{"start": int(start[i]), "end": int(start[j - 1] + size[j - 1]), "lang": model.langs[labels[i]]}
                 for i, j in zip(edges[:-1], edges[1:])]
        yield model.langs[best], float(letters[best] / letters.sum()), spans


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``lang_score`` and ``lang_spans`` to every row.

    Spans are (start, end in code points, language) from the first word under a label to the last. A null text, one
    without a letter and any text under a model of no language are ``und`` with score 0 and no span. Words in
    a script that no learned language uses follow their neighbours. Repeated rows get the same, an empty table
    gives an empty one, and columns that already have one of the three names are refused.
    """
    schema = schema_with(df, lang_pred="string", lang_score="double", lang_spans="array<struct<start:int,end:int,lang:string>>")

    def run(batches):
        for batch in sliced(batches, text):
            lang, score, spans = zip(*_label(model, texts_of(batch, text)))
            yield with_columns(batch, lang_pred=pa.array(lang, pa.string()), lang_score=pa.array(score, pa.float64()),
                               lang_spans=pa.array(spans, _SPANS))

    return df.mapInArrow(run, schema)
