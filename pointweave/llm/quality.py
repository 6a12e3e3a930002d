"""Quality scores from compression with a good and a bad dictionary.

Two zstandard dictionaries are built from labelled text. A text is compressed in blocks with each of them and
with none; the difference of the two sizes, normalised by the plain compressed size, says which kind of text it
resembles. A logistic calibration of that difference, with the compression ratio and the length beside it,
turns it into the probability of a good label. The calibration is fitted on rows the dictionaries have not seen.

The model is bounded whatever the input: ``SAMPLE`` labelled keys of each class, chosen by a hash of the key. Half of them are cut
whole into pieces, of which ``PIECES`` train the dictionary of their class, chosen by a hash again; half are measured whole in the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from pointweave.llm.common import bytes_of, schema_with, sliced, with_columns
from pointweave.session import cut

SAMPLE = 4000  # labelled keys of each class, half for the dictionary and half for the calibration
PIECES = 8192  # pieces that a dictionary is trained on
PIECE = 1024  # bytes of a piece
DICTIONARY = 112_640  # bytes
BLOCK = 2048  # bytes compressed at a time: short enough that the dictionary outweighs the text's own history
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes  # dictionary
    bad: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the intercept first; empty where a class has no labelled row


def _dictionary(blocks: list[bytes]) -> bytes:
    size = min(DICTIONARY, max(256, sum(map(len, blocks)) // 4))
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:  # too few samples for statistics: their text itself serves as the dictionary
        return b"".join(blocks)[-DICTIONARY:]


def _compressor(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    bare = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**bare)
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, **bare)


def _sizes(compressors, text: bytes) -> tuple[int, int, int, int]:
    """Bytes of the whole text compressed with the good, the bad and no dictionary, and raw."""
    total = [0, 0, 0]
    for at in range(0, len(text), BLOCK):
        block = text[at:at + BLOCK]
        for k, c in enumerate(compressors):
            total[k] += len(c.compress(block))
    return *total, len(text)


def _features(sizes: np.ndarray) -> np.ndarray:
    good, bad, plain, raw = np.asarray(sizes, float).reshape(-1, 4).T
    difference = (good - bad) / (plain + 50)
    ratio = (plain + 50) / (raw + 50)
    length = np.log(raw + 50)
    return np.stack([difference, ratio, length, difference ** 2, ratio ** 2, length ** 2,
                     difference * ratio, difference * length, ratio * length], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Regularised logistic regression by Newton steps that are halved until the loss falls."""
    w = np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + ridge / 2 * w @ w
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, now = np.linalg.solve(hessian, gradient), loss(w)
        if np.abs(step).max() < 1e-8:
            break
        for _ in range(30):
            if loss(w - step) <= now:
                break
            step /= 2
        w = w - step
    return w


def probability(model: Model, sizes: np.ndarray) -> np.ndarray:
    if not model.weights:
        return np.full(len(np.asarray(sizes).reshape(-1, 4)), 0.5)
    x = (_features(sizes) - model.centre) / model.scale
    z = np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -35, 35)
    return 1 / (1 + np.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on the texts of ``docs`` that ``labels`` (key, label 0 or 1) marks; null keys, texts and labels are left out.

    Which keys enter depends on a hash of the key alone. A key counts once: of several labels the greatest holds, of several texts the
    least. Where a class is absent the model scores 0.5.
    """
    hashed = F.xxhash64(F.col("key").cast("string"))
    marks = labels.select(F.col(key).alias("key"), F.col("label").cast("int").alias("label")).dropna().groupBy("key").agg(F.max("label").alias("label"))
    picked = [marks.where(F.col("label") == k).orderBy(hashed, "key").limit(SAMPLE) for k in (0, 1)]
    # At most 2 * SAMPLE keys; the texts stay where they are until one for each key is left.
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).dropna().join(F.broadcast(picked[0].unionByName(picked[1])), "key")
    sample = found.groupBy("key", "label").agg(F.min("text").alias("text"))
    sample = cut(sample.withColumn("half", F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("half")), F.lit(2))))

    def pieces(batches):
        for batch in sliced(batches, "text"):
            for label, raw in zip(batch["label"].to_pylist(), bytes_of(batch)):
                parts = [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["label", "piece"])

    cut_up = cut(sample.where("half = 0").select("label", "text").mapInArrow(pieces, "label int, piece binary"))
    texts = {k: [bytes(r[0]) for r in cut_up.where(F.col("label") == k).orderBy(F.xxhash64("piece"), "piece").limit(PIECES).select("piece").collect()] for k in (0, 1)}
    if not any(texts[0]) or not any(texts[1]):
        return Model(b"", b"", (), (), ())
    good, bad = _dictionary(texts[1]), _dictionary(texts[0])

    def measure(batches):
        compressors = [_compressor(d) for d in (good, bad, None)]
        for batch in sliced(batches, "text"):
            sizes = [_sizes(compressors, t) for t in bytes_of(batch)]
            yield pa.RecordBatch.from_arrays([batch["label"].cast(pa.int32()), *(pa.array(c, pa.int64()) for c in zip(*sizes))],
                                             names=["label", "good", "bad", "plain", "raw"])

    measured = (sample.where("half = 1").select("label", "text")
                .mapInArrow(measure, "label int, good bigint, bad bigint, plain bigint, raw bigint")
                .orderBy("label", "raw", "plain", "good", "bad").collect())  # one row for each sampled key
    y = np.array([r["label"] for r in measured], float)
    if not 0 < y.sum() < len(y):
        return Model(b"", b"", (), (), ())
    x = _features(np.array([r[1:] for r in measured]))
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = _logistic(np.c_[np.ones(len(x)), (x - centre) / scale], y)
    return Model(good, bad, tuple(centre), tuple(scale), tuple(weights))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on) to every row.

    Only the text is read, whole. A null text scores as the empty one, which the calibration gives a score like
    any other; repeated rows score alike; an empty table gives an empty one. Other columns pass through, and
    one that is already called ``score`` or ``predicted`` is refused.
    """
    schema = schema_with(df, score="double", predicted="int")

    def run(batches):
        compressors = [_compressor(d) for d in (model.good, model.bad, None)]
        for batch in sliced(batches, text):
            p = probability(model, np.array([_sizes(compressors, t) for t in bytes_of(batch, text)]))
            yield with_columns(batch, score=pa.array(p), predicted=pa.array((p >= THRESHOLD).astype(np.int32)))

    return df.mapInArrow(run, schema)
