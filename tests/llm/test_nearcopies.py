import random

import numpy as np
import pytest

import corpus_pipeline
from tarnflow.llm import nearcopies


def jaccard(a, b):
    return nearcopies.similarity(*(nearcopies.shingles(nearcopies.tokens(x), 5) for x in (a, b)))


def planted(rng, low, high, n):
    """n pairs of texts whose five-word similarity is in the range."""
    out = []
    while len(out) < n:
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(80, 400))]
        v = list(w)
        for k in rng.sample(range(len(v)), rng.randint(1, max(1, len(v) // 30))):
            v[k] = "changed" + str(rng.randint(0, 10**6))
        if low <= jaccard(" ".join(w), " ".join(v)) < high:
            out.append((" ".join(w), " ".join(v)))
    return out


def test_stage_finds_copies_at_each_similarity(spark, documents):
    rng = random.Random(1)
    near = [p for low in (0.8, 0.85, 0.9, 0.95) for p in planted(rng, low, low + 0.05, 20)]
    apart = planted(rng, 0.6, 0.79, 20)
    texts = [x for p in near + apart for x in p]
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(texts), "").collect()}
    assert left == {i for i in range(1, len(texts) + 1) if i % 2 or i > 2 * len(near)}


def test_large_group_is_one_component(documents):
    rng = random.Random(2)
    w = [f"w{k}" for k in range(200)]
    texts = [" ".join(w[:k] + [f"new{k}"] + w[k + 1 :]) for k in range(150)] + [" ".join(f"x{rng.random()}" for _ in range(50)) for _ in range(20)]
    left = {r["doc_id"] for r in nearcopies.dedup(documents(texts)).collect()}
    assert left == {1, *range(151, 171)}


def test_odd_and_empty(odd, empty):
    got = nearcopies.dedup(odd)
    assert got.columns == odd.columns
    assert sorted(r["doc_id"] for r in got.select("doc_id").where("doc_id is not null").collect()) == [0, 3, 4, 5, 6, 7, 8]
    assert got.where("doc_id is null").count() == 1
    assert nearcopies.dedup(empty).count() == 0


@pytest.mark.parametrize("words", [0, 1, 4, 5, 6])
def test_short_texts_have_bands_or_none(words):
    assert len(nearcopies.bands(nearcopies.shingles([b"a%d" % k for k in range(words)], 5))) == (nearcopies.BANDS if words else 0)


@pytest.mark.parametrize("others", [60, 200])
def test_large_groups_are_held_together_by_what_they_come_from(documents, others):
    """Copies with changes of their own are like the first text, but hardly like each other."""
    rng = random.Random(others)
    w = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    texts = [" ".join(w)]
    for k in range(others):
        x = list(w)
        for at in rng.sample(range(300), 5):
            x[at] = f"changed{k}"
        texts.append(" ".join(x))
    sets = [nearcopies.shingles(nearcopies.tokens(t), 5) for t in texts]
    assert min(nearcopies.similarity(sets[0], s) for s in sets[1:]) >= 0.8
    assert sum(nearcopies.similarity(a, b) >= 0.8 for a, b in zip(sets[1:], sets[2:])) < others / 2
    assert [r["doc_id"] for r in nearcopies.dedup(documents(texts)).collect()] == [1]


def template(rng, groups, size, changes=17):
    """Texts of one template, each group with words of its own at the same places, and copies in it with few changes."""
    words = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    base, out = words(356), []
    for _ in range(groups):
        own = base + words(48)
        out.append(" ".join(own))
        for _ in range(size - 1):
            x = list(own)
            at = rng.randrange(0, 356 - changes)
            x[at : at + changes] = words(changes)
            out.append(" ".join(x))
    return out


@pytest.mark.parametrize("groups, size, changes", [(150, 2, 17), (40, 8, 8)])
def test_texts_of_one_template_lose_no_link(documents, groups, size, changes):
    """More classes share each band than are compared all with all; texts of other groups are just not alike enough."""
    texts = template(random.Random(groups), groups, size, changes)
    sets = [nearcopies.shingles(nearcopies.tokens(t), 5) for t in texts]
    assert all(nearcopies.similarity(sets[i], sets[i - i % size]) >= 0.8 for i in range(len(sets)))
    assert max(nearcopies.similarity(sets[0], s) for s in sets[size:]) < 0.8
    left = sorted(r["doc_id"] for r in nearcopies.dedup(documents(texts)).collect())
    assert left == list(range(1, len(texts) + 1, size))


def test_exact_search_finds_all_pairs(spark):
    """`allowed` holds every pair with a similarity of 0.8 or more, of sizes and changes of all kinds."""
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abcdefghijkl", k=rng.randint(1, 40))) for _ in range(60)]
    texts += [" ".join(f"w{k}" for k in range(a, b)) for a in (0, 3, 7, 30) for b in (40, 44, 60, 75, 80)]
    sets = [nearcopies.shingles(nearcopies.tokens(t), 5) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if nearcopies.similarity(sets[i], sets[j]) >= 0.8}
    df = spark.createDataFrame(list(enumerate(texts)), "c long, text string")
    none = spark.createDataFrame([], "id long, p long")
    got = {tuple(r) for r in nearcopies.allowed(df, none, 5, 0.8).collect()}
    assert want and want <= got
    joined = spark.createDataFrame([(i, 0) for i in range(len(texts))], "id long, p long")
    assert nearcopies.allowed(df, joined, 5, 0.8).count() == 0


def test_parity_sketches_bound_the_difference():
    rng = random.Random(3)
    for n in (0, 1, 50, 3000):
        a, b = ({rng.getrandbits(64) for _ in range(n)} for _ in range(2))
        b = set(list(a)[: n // 2]) | set(list(b)[: n // 3])
        x, y = (nearcopies.parity(np.array(sorted(v), np.uint64)) for v in (a, b))
        assert len(x) == nearcopies.SKETCH and sum(((i ^ j) & 0xFFFFFFFFFFFFFFFF).bit_count() for i, j in zip(x, y)) <= len(a ^ b)
