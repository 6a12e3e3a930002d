import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from pointweave.llm import bpe, simhash
from tests.llm.test_quality import WORDS


def test_every_stage_on_planted_cases(docs, spark, folder):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)) + "."
    good = [prose(rng.randint(150, 300)) for _ in range(100)]
    bad = [" ".join(rng.choice(WORDS).upper() + "!!" for _ in range(rng.randint(60, 300))) for _ in range(100)]
    item = prose(40)
    texts = [*good, *bad, good[0], good[1] + " extra", prose(200) + " " + item, good[3][:600] + " a.b@example.com +1 (555) 010-2030", None, ""]
    sf_dir = folder("sf")
    docs(texts).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        new = stage(spark, rows, sf_dir)
        if k < 4:
            assert new.columns == rows.columns
        new.write.parquet(folder(f"stage{k}"))
        rows = spark.read.parquet(folder(f"stage{k}"))
        held.append({r.doc_id: r for r in rows.collect()})
    assert all(i in held[0] for i in range(100)) and not any(i in held[0] for i in range(100, 200))
    assert not {200, 201} & held[1].keys() and {0, 1} <= held[1].keys()
    assert 202 in held[1] and 202 not in held[2]
    assert held[3][203].text.endswith(" [EMAIL] [PHONE]") and held[3][203].n_chars == len(held[3][203].text)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert held[4].keys() == held[3].keys()
    for i, r in held[4].items():
        text = held[3][i].text or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert corpus_pipeline.run(spark, sf_dir).count() == len(held[4])


def test_near_duplicates_of_simhash_go_whatever_shingles_they_share(docs, spark):
    loop = "one two three four five " * 50  # its five shingles outvote the tails
    rows = docs([loop + "red green blue pink", loop + "north south east west up down left right", "another text of its own words"])
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()}
    assert classes == {0: 0, 1: 0, 2: 2}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()} == {0, 2}
