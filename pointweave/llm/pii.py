"""Personal data by weak supervision.

Exact formats (``BASE``) are always reported. Further candidates, keys and passwords and telephone numbers without a
country code, are judged by labelers that vote yes, no or nothing: formats, a gazetteer of key prefixes and names,
the words around the span, and its characters. The patterns of votes are counted over all documents; expectation
maximisation estimates how reliable each labeler is without any labelled row, and the probabilities it gives train
a logistic classifier over the span's features, which decides.

Votes and features have few values, so their counts, a bounded table, are all that reaches the driver.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pointweave.llm.common import schema_with, sliced, texts_of, with_columns

BASE = ("email", "ip", "card", "phone")
MORE = ("local_phone", "secret")
KINDS = (*BASE, *MORE)
THRESHOLD = 0.5
ROUNDS = 200  # of expectation maximisation
CONTEXT = 40  # code points before a candidate that labelers read

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where its digits begin, and never gives digits back, so both run in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_TOKEN = re.compile(r"[A-Za-z0-9_+/-]{12,}={0,2}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_CANDIDATE = re.compile(r"[0-9@]")

# Prefixes of well-known keys, names of secrets, words before telephone numbers and before versions.
_KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "ya29")
_SECRET_NAMES = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential)s?[\"']?\s*(?:[:=]|is)?\s*[\"']?$")
_CALLS = re.compile(r"(?i)(?:phone|tel|telephone|mobile|cell|call|fax|contact|reach me|at)\W*$")
_PLAIN = re.compile(r"(?i)(?:version|release|isbn|doi|http\S*|www\S*|commit|rev|page|no|nr)\W*$")
_AREA_CODES = range(200, 1000)
_KEY_FORMAT = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[po]_[A-Za-z0-9]{36}|[0-9a-f]{32,}|eyJ[A-Za-z0-9_-]{20,}")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then start."""
    out = [("email", *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _entropy(token: str) -> float:
    counts = np.unique(np.frombuffer(token.encode("utf-32-le"), "<u4"), return_counts=True)[1] / len(token)
    return float(-(counts * np.log2(counts)).sum())


def candidates(text: str, taken: list[tuple[str, int, int]]):
    """(kind, start, end, votes, features) of spans beside the taken ones; a vote is 1 yes, 0 no, -1 none."""
    covered = sorted((a, b) for _, a, b in taken)
    starts, ends = [a for a, _ in covered], list(itertools.accumulate((b for _, b in covered), max))

    def free(a: int, b: int) -> bool:
        before = bisect.bisect_left(starts, b)  # spans that begin before b; none of them may end behind a
        return not before or ends[before - 1] <= a

    found = [("local_phone", m) for m in _LOCAL_PHONE.finditer(text)]
    found += [("secret", m) for m in _TOKEN.finditer(text) if _DIGIT.search(m.group()) and _LETTER.search(m.group())]
    for kind, m in found:
        if not free(m.start(), m.end()):
            continue
        span, before = m.group(), text[max(0, m.start() - CONTEXT):m.start()]
        digits = sum(c in "0123456789" for c in span)
        if kind == "secret":
            entropy = _entropy(span)
            format_ = 1 if _KEY_FORMAT.fullmatch(span) else -1
            gazetteer = 1 if span.startswith(_KEY_PREFIXES) or _SECRET_NAMES.search(before) else 0 if "/" in span else -1
            context = 1 if _SECRET_NAMES.search(before) else 0 if _PLAIN.search(before) else -1
            characters = 1 if entropy >= 3 and digits >= 2 else 0
        else:
            entropy = 0.0
            format_ = 1 if span[0] == "(" else -1
            gazetteer = 1 if int(re.sub("[^0-9]", "", span)[:3]) in _AREA_CODES else 0
            context = 1 if _CALLS.search(before) else 0 if _PLAIN.search(before) else -1
            characters = 1 if len({c for c in span if not c.isdigit()}) <= 4 else 0
        features = (int(kind == "secret"), int(format_ == 1), int(gazetteer == 1), int(context == 1), int(context == 0),
                    min(4, int(entropy)), min(5, int(math.log2(len(span)))), min(3, 4 * digits // len(span)))
        yield kind, m.start(), m.end(), (format_, gazetteer, context, characters), features


@dataclass(frozen=True)
class Model:
    prior: float
    reliability: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]  # labeler, truth, vote -1 / 0 / 1
    weights: tuple[float, ...]


def _design(features: np.ndarray) -> np.ndarray:
    f = np.asarray(features, float).reshape(-1, 8)
    return np.c_[np.ones(len(f)), f[:, :5], (f[:, 5:6] - 2) / 2, (f[:, 6:7] - 3) / 2, (f[:, 7:8] - 1.5) / 1.5]


def reliabilities(votes: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation maximisation over vote patterns: prior, table (labeler, truth, vote), probability of each pattern."""
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeler, vote
    yes, no = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    p = (1 + yes) / (2 + yes + no)  # begins as the share of yes, so that labelers are right more often than not
    for _ in range(ROUNDS):
        weight = np.stack([counts * (1 - p), counts * p])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        table = np.einsum("tp,plv->ltv", weight, one_hot) + 0.1
        table /= table.sum(axis=2, keepdims=True)
        logs = np.einsum("plv,ltv->tp", one_hot, np.log(table))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + math.log((1 - prior) / prior), -35, 35)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return float(prior), table, p


def fit(df: DataFrame, text: str = "text") -> Model:
    """Learn from the candidates of every row; without any, the model says no to all."""

    def run(batches):
        total: dict[tuple, int] = {}
        for batch in sliced(batches, text):
            for t in texts_of(batch, text):
                if _CANDIDATE.search(t):
                    for *_, votes, features in candidates(t, base_spans(t)):
                        total[votes + features] = total.get(votes + features, 0) + 1
        rows = np.array([[*k, n] for k, n in total.items()], np.int64).reshape(-1, 13)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, :12].tolist(), pa.list_(pa.int32())), pa.array(rows[:, 12])], names=["pattern", "n"])

    rows = df.select(text).mapInArrow(run, "pattern array<int>, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    held = sorted((tuple(r["pattern"]), r["n"]) for r in rows.collect())  # patterns are few by their making
    if not held:
        return Model(0.0, (), ())
    patterns, counts = np.array([k for k, _ in held]), np.array([n for _, n in held], float)
    prior, table, p = reliabilities(patterns[:, :4], counts)
    x = _design(patterns[:, 4:])
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps on probabilistic labels, regularised
        q = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (counts * q * (1 - q))[:, None]).T @ x + np.eye(len(w)), x.T @ (counts * (q - p)) + w)
        w -= step * min(1.0, 4 / max(4.0, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Model(prior, tuple(tuple(tuple(v) for v in t) for t in table.tolist()), tuple(w))


def spans(text: str, model: Model) -> list[tuple[str, int, int]]:
    """Base spans and the candidates that the classifier takes, by kind and then start."""
    if not _CANDIDATE.search(text):
        return []
    base = base_spans(text)
    found = list(candidates(text, base)) if model.weights else []
    if found:
        p = 1 / (1 + np.exp(-np.clip(_design(np.array([f[4] for f in found])) @ np.array(model.weights), -35, 35)))
        base += sorted((f[:3] for f, q in zip(found, p) if q >= THRESHOLD), key=lambda s: (KINDS.index(s[0]), s[1]))
    return base


def as_string(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``pii`` to every row: its spans (kind, start, end in code points), by kind and then start.

    Whole texts of any length are read; a null or empty one has no span. Repeated rows get the same, an empty table
    gives an empty one; a column that is already called ``pii`` is refused, others pass through.
    """
    schema = schema_with(df, pii="array<struct<kind:string,start:int,end:int>>")

    def run(batches):
        for batch in sliced(batches, text):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t, model)] for t in texts_of(batch, text)]
            yield with_columns(batch, pii=pa.array(found, _SPAN))

    return df.mapInArrow(run, schema)


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones together, replaced by its kind in brackets."""
    out, end = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with the text of every span replaced; a null text stays null, other columns stay as they are."""
    at = df.columns.index(text)

    def run(batches):
        for batch in sliced(batches, text):
            new = [None if t is None else redacted(t, spans(t, model)) for t in batch[text].to_pylist()]
            yield batch.set_column(at, text, pa.array(new, pa.string()))

    return df.mapInArrow(run, df.schema)


def report(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: counts of base kinds, digest of the base spans, all spans as text."""
    found = find(docs.select("doc_id", "text"), model).select("doc_id", "pii")
    own = lambda kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    text = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[F.size(own([k])).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(text(own(BASE)), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"))
