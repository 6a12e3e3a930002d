import random
import zlib

import pytest
from pyspark.sql import functions as F

from pointweave.llm import quality

WORDS = [a + b for a in ("th", "an", "er", "on", "in", "re") for b in ("ed", "ing", "tion", "ly", "and", "es")]


def texts(n, seed):
    rng = random.Random(seed)
    good = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 400))) + "." for _ in range(n)]
    bad = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 400))]
        bad.append([" ".join(w.upper() + "!!" for w in words), " | ".join(words)][i % 2])
    return good + bad


@pytest.fixture(scope="module")
def model(docs, spark):
    rows = texts(80, 1)
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)] + [(None, 1), (3, None)], "doc_id long, label int")
    return quality.fit(docs([*rows, None]), labels)


def test_held_out_accuracy(docs, model):
    rows = {r.doc_id: r for r in quality.score(docs(texts(60, 2)), model).collect()}
    assert sum(r.predicted == int(i < 60) for i, r in rows.items()) >= 117
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_edges(docs, model, spark):
    long = " ".join(WORDS * 20000)
    df = docs([None, "", "x", "x", long]).withColumnRenamed("lang", "Label")
    rows = {r.doc_id: r for r in quality.score(df, model).collect()}
    assert rows[0].score == rows[1].score and rows[2].score == rows[3].score and len(rows) == 5
    assert quality.score(docs([]), model).count() == 0
    with pytest.raises(ValueError, match="score"):
        quality.score(docs(["x"]).withColumnRenamed("lang", "Score"), model)
    one_class = quality.fit(docs(texts(4, 1)), spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, label int"))
    assert {r.score for r in quality.score(docs(["a", None]), one_class).collect()} == {0.5}


def test_held_out_rows_are_those_of_crc32(spark):
    from pyspark.sql import functions as F

    from pointweave.llm.common import held_out

    got = spark.range(200).select("id", held_out(F.col("id"), 5, 0).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_repeated_keys_and_labels_count_once(docs, spark, model):
    rows = docs(texts(80, 1))
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)] + [(150, 0)] * 5000 + [(0, 0)], "doc_id long, label int")
    copies = rows.where("doc_id between 150 and 152").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6000)))).drop("k")
    assert quality.fit(rows.unionByName(copies), labels) == quality.fit(rows, labels) == model


def test_scores_are_those_of_plain_compression(docs, model):
    import numpy as np
    import zstandard

    rows = [None, "", "x y z", *texts(5, 3)]
    bare = dict(level=quality.LEVEL, write_content_size=False, write_dict_id=False)
    tools = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **bare) for d in (model.good, model.bad)] + [zstandard.ZstdCompressor(**bare)]
    got = {r.doc_id: r.score for r in quality.score(docs(rows), model).collect()}
    for i, text in enumerate(rows):
        raw = (text or "").encode()
        good, bad, plain = (sum(len(t.compress(raw[at:at + quality.BLOCK])) for at in range(0, len(raw), quality.BLOCK)) for t in tools)
        d, ratio, length = (good - bad) / (plain + 50), (plain + 50) / (len(raw) + 50), np.log(len(raw) + 50)
        x = (np.array([d, ratio, length, d * d, ratio * ratio, length * length, d * ratio, d * length, ratio * length]) - model.centre) / model.scale
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model.weights[0] + x @ np.array(model.weights[1:])))))
