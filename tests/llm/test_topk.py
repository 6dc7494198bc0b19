import math
import random

import numpy as np
from pyspark.sql import functions as F

from tarnflow.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, id long, rank int, v string, part long"


def brute(rows, k=20, step=20):
    whole = [(r[0], [math.floor(64 * float(np.float32(x))) for x in r[1]]) for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for q, a in {q: a for q, a in whole if q % step == 0}.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def sample(n, rng, width=8):
    rows = [(i, [rng.gauss(0, 1) * (1 + 4 * (i % 50 == 7)) for _ in range(width)], None, None, None, None, None) for i in range(n)]
    rows += [(n + i, rows[3][1], None, None, None, None, None) for i in range(45)]  # more ties than k
    bad = [None, [], [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [0.0] * 8]
    return rows + [(20 * (n + 100 + i), b, None, None, None, None, None) for i, b in enumerate(bad)] + [(None, [1.0] * 8, None, None, None, None, None)]


def run(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, **settings).select("query_id", "rank", "vec_id", "score").collect()))


def test_matches_brute_force(spark):
    rows = sample(1500, random.Random(1))
    assert run(spark, rows) == brute(rows)


def test_many_shards_and_blocks(spark):
    rows = sample(900, random.Random(2), 3)
    assert run(spark, rows, per_shard=120, per_block=16) == brute(rows)


def test_fewer_candidates_than_k(spark):
    rows = sample(5, random.Random(3))[:5]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == []


def test_tree_search_equals_a_full_scan():
    rng = np.random.default_rng(5)
    for x in (rng.integers(-200, 200, (3000, 16)), np.zeros((600, 4), np.int64), rng.integers(0, 2, (2000, 2))):
        ids = rng.permutation(len(x))
        q = np.vstack([x[:30], rng.integers(-200, 200, (10, x.shape[1]))])
        qid = np.concatenate([ids[:30], np.full(10, -1)])
        tree = topk.build(ids, x)
        kth = np.full(len(q), topk.NONE)
        scores, found = topk.search(tree, qid, q, 10, kth)
        again, same = topk.search(tree, qid, q, 10, scores[:, 9])  # starting from shared scores loses nothing
        for a, i, b, j, one, own in zip(scores, found, again, same, q, qid):
            s = x @ one
            order = [n for n in np.lexsort((ids, -s)) if ids[n] != own][:10]
            assert s[order].tolist() == a.tolist() == b.tolist() and ids[order].tolist() == i.tolist() == j.tolist()


def test_defined_cases(spark):
    assert run(spark, []) == []
    rows = [(0, [1.0], *[None] * 5), (0, [1.0], *[None] * 5), (1, [2.0], *[None] * 5), (1, [2.0], *[None] * 5)]
    got = run(spark, rows)
    assert {r[2] for r in got} == {1} and {r[3] for r in got} == {64 * 128}
