"""The stage's candidates come from the operator of SimHash first."""

import random

import numpy as np

import corpus_pipeline
from tarnflow.llm import nearcopies, simhash


def copies(rng, n):
    """n texts of 300 words, each with a copy that differs in its last word."""
    for _ in range(n):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
        yield from (" ".join(w), " ".join([*w[:-1], "changed"]))


def bits(a, b):
    return (simhash.fingerprint(a, 5, 0) ^ simhash.fingerprint(b, 5, 0)).bit_count()


def test_stage_links_by_fingerprints(spark, documents, monkeypatch):
    """Before, no fingerprint was made: without the bands of MinHashes nothing was linked."""
    none = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "c long")
    monkeypatch.setattr(nearcopies, "candidates", lambda *_: none)
    texts = list(copies(random.Random(3), 30))
    within = [i for i in range(0, 60, 2) if bits(texts[i], texts[i + 1]) <= nearcopies.BITS]
    assert len(within) >= 25
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(texts), "").collect()}
    assert left == set(range(1, 61)) - {i + 2 for i in within}


def test_links_by_fingerprints_are_verified(spark, documents, monkeypatch):
    """Texts of other words whose fingerprints are equal are no copies."""
    monkeypatch.setattr(nearcopies, "edges", lambda fp, bits: fp.selectExpr("fp AS a", "min(fp) OVER () AS b").where("a <> b"))
    texts = [" ".join(f"w{random.Random(i).random()}" for _ in range(30)) for i in range(6)]
    assert corpus_pipeline.near_dedup(spark, documents(texts), "").count() == 6


def test_forest_of_close_classes_is_that_of_all_pairs(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(30)]
    fps += [f ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for f in fps for _ in range(3)]
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)]
    of = np.arange(len(fps))
    at = np.array([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= nearcopies.BITS])
    want = simhash.forest(len(fps), at[:, 0], at[:, 1])
    got = np.array([tuple(r) for r in nearcopies.close(spark.createDataFrame(rows, "c long, fp long")).collect()])
    assert len(got) < len(fps) and (want != of).sum() > 30
    assert simhash.forest(len(fps), got[:, 0], got[:, 1]).tolist() == want.tolist()
