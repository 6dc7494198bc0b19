import random

import numpy as np
import xxhash

from tarnflow.llm import simhash


def slow_fingerprint(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    w = [x for x in lowered.split(" ") if x]
    if not w:
        return 0
    parts = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=2):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(ids))]


def sample():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 5)))
    texts = []
    for _ in range(40):
        w = [word() for _ in range(rng.randint(1, 400))]
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 5)):
            w = w[:]
            w[rng.randrange(len(w))] = word()
            texts.append("\t".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    texts += ["", None, " ", "a", "a b", "A b", texts[3], texts[3]]
    rng.shuffle(texts)
    return texts


def test_matches_brute_force(documents):
    texts = sample()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(texts)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    ids = list(range(1, len(texts) + 1))
    assert [int(got[i]["fingerprint"], 16) for i in ids] == fps
    assert all(len(r["fingerprint"]) == 16 and r["fingerprint"] == r["fingerprint"].lower() for r in got.values())
    assert [got[i]["component_id"] for i in ids] == brute_components(ids, fps)


def _close(n, rng):
    """Fingerprints with many at 1 to 5 bits from others."""
    base = rng.integers(0, 1 << 63, max(1, n // 6), dtype=np.uint64)
    out = rng.choice(base, n)
    for _ in range(5):
        flip = rng.random(n) < 0.5
        out[flip] ^= np.uint64(1) << rng.integers(0, 64, flip.sum()).astype(np.uint64)
    return np.unique(out)


def test_links_lose_no_pair():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (30, 7), (1200, 400)):
        fp = _close(n + m, rng)
        members, queries = fp[: max(1, len(fp) - m)], fp[max(1, len(fp) - m) :]
        a, b = simhash.links(members, queries, 2, leaf=16)
        at = {x: i for i, x in enumerate(fp.tolist())}
        got = simhash.forest(len(fp), np.array([at[x] for x in a.tolist()], int), np.array([at[x] for x in b.tolist()], int))
        i, j = np.nonzero(np.bitwise_count(members[:, None] ^ fp[None, :]) <= 2)
        np.testing.assert_array_equal(got, simhash.forest(len(fp), i, j))


def test_shards_meet_every_pair(spark):
    """Small shards, so that most links cross borders."""
    fp = _close(900, np.random.default_rng(8))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = simhash.components(simhash.edges(df, 2, per_shard=40)).collect()
    label = {r["id"]: r["p"] for r in got}
    signed = fp.view(np.int64).tolist()
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2)
    want = simhash.forest(len(fp), i, j)
    groups = {}
    for x, w in zip(signed, want.tolist()):
        groups.setdefault(w, []).append(x)
    for members in groups.values():
        assert {label.get(x, x) for x in members} == {min(members)}


def test_defined_cases(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    blank = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in blank} == {0, 1, 2} and {r["component_id"] for r in blank} == {0}
    same = [r for r in got if r["doc_id"] in (4, 20)]
    assert len(same) == 3 and {r["component_id"] for r in same} == {4}
    assert simhash.near_duplicates(empty).count() == 0


def test_one_of_each_component_stays(odd):
    found, kept = simhash.near_duplicates(odd).collect(), simhash.dedup(odd).collect()
    assert len(kept) == len({r["component_id"] for r in found if r["component_id"] is not None}) + 1  # and the one without an id
    assert {r["doc_id"] for r in kept} == {r["component_id"] for r in found}
    assert set(kept[0].asDict()) == set(odd.columns)
