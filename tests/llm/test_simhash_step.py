"""The near-copy stage names pairs by SimHash first."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from folioworks.llm import shingle_dups, simhash


def texts(seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(600)]
    rows = [(1, " ".join(base)), (2, " ".join(base + ["tail"])), (3, " ".join(["head"] + base))]
    return rows + [(i, " ".join(f"v{rng.randrange(10_000)}" for _ in range(600))) for i in range(4, 9)]


def test_the_stage_links_by_fingerprints(spark, frame, monkeypatch):
    rows = texts()
    prints = {i: simhash.fingerprint(t, shingle_dups.SHINGLE_WORDS) for i, t in rows}
    assert max((prints[1] ^ prints[i]).bit_count() for i in (2, 3)) <= shingle_dups.RADIUS
    for i, t in rows:
        assert shingle_dups.print_of(shingle_dups.shingle_set(t)) == int(np.uint64(prints[i]).view(np.int64))
    # Without the later step by keys the copies are still found.
    monkeypatch.setattr(shingle_dups, "ROUNDS", 0)
    monkeypatch.setattr(shingle_dups, "shared_enough", lambda open_: open_.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false"))
    kept = corpus_pipeline.near_dedup(spark, frame(rows), "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 4, 5, 6, 7, 8]
