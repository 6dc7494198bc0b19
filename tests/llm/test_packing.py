import random
from collections import defaultdict

from tarnflow.llm import packing


def brute(items, capacity):
    """Tightest compatible bin by looking at every open bin; items are (size, source, cluster) in falling order."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and source not in b["s"] and cluster not in b["c"]]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[k]["left"] -= size
        bins[k]["s"] |= {source} - {-1}
        bins[k]["c"] |= {cluster} - {-1}
        out.append(k)
    return out


def test_best_fit_finds_the_tightest_compatible_bin():
    for seed in range(30):
        rng = random.Random(seed)
        items = sorted(((rng.randint(1, 40), rng.randint(-1, 6), rng.randint(-1, 30)) for _ in range(rng.randint(0, 200))), reverse=True)
        sizes, sources, clusters = ([x[k] for x in items] for k in range(3))
        assert packing.best_fit(sizes, sources, clusters, 64) == brute(items, 64)


def check(rows, got, capacity):
    """Every word has one place; bins hold their capacity and no conflict."""
    words = {r[0]: len((r[1] or "").split()) for r in rows}
    source, cluster = {r[0]: r[3] for r in rows}, {r[0]: " ".join((r[1] or "").lower().split()) for r in rows}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["size"]))
        if r["bin"] is None:
            assert words[r["doc_id"]] == 0
        else:
            bins[r["shard"], r["bin"]].append(r)
    for i, n in words.items():
        at = 0
        for start, size in sorted(pieces[i]):
            assert start == at
            at += size
        assert at == n
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["size"]
        assert at <= capacity
        s = [source[r["doc_id"]] for r in held if source[r["doc_id"]] is not None]
        assert len(set(s)) == len(s) and len({cluster[r["doc_id"]] for r in held}) == len(held)
    return bins


def sample():
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["a", "b", "c"], k=rng.choice((0, 1, 3, 10, 50, 64, 65, 130, 200)))) for _ in range(400)]
    return [(i, t, None, None if i % 50 == 0 else f"s{int(rng.random() ** 2 * 40)}", None) for i, t in enumerate(texts)] + [(1000 + i, texts[9], None, f"s{i}", None) for i in range(40)]


def test_pack(documents):
    rows = sample()
    got = packing.pack(documents(rows), capacity=64, per_shard=100).collect()
    bins = check(rows, got, 64)
    assert len({r["shard"] for r in got if r["shard"] is not None}) > 2
    assert any(len(b) > 1 for b in bins.values())
    again = packing.pack(documents(rows).repartition(5, "source"), capacity=64, per_shard=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_a_shard_is_packed_as_brute_force_packs_it(documents):
    rows = sample()
    got = packing.pack(documents(rows), capacity=64, per_shard=10**6).collect()
    last = {}
    for r in got:
        if r["bin"] is not None and r["size"] < 64:
            last[r["doc_id"]] = r
    source = {r[0]: r[3] for r in rows}
    cluster = {r[0]: r[1] for r in rows}
    order = sorted(last, key=lambda i: (-last[i]["size"], i))
    want = brute([(last[i]["size"], source[i] if source[i] is not None else -1, cluster[i]) for i in order], 64)
    assert [last[i]["bin"] for i in order] == want


def test_every_shard_is_packed_as_brute_force_packs_it(documents):
    rows = sample()
    got = packing.pack(documents(rows), capacity=64, per_shard=90).collect()
    by_shard = defaultdict(dict)
    for r in got:
        if r["bin"] is not None and r["size"] < 64:
            by_shard[r["shard"]][r["doc_id"]] = r
    source, cluster = {r[0]: r[3] for r in rows}, {r[0]: r[1] for r in rows}
    assert len(by_shard) > 3
    for last in by_shard.values():
        order = sorted(last, key=lambda i: (-last[i]["size"], i))
        want = brute([(last[i]["size"], source[i] if source[i] is not None else -1, cluster[i]) for i in order], 64)
        assert [last[i]["bin"] for i in order] == want


def test_near_copies_of_several_sources_do_not_meet(documents):
    from tarnflow.llm import simhash

    rng = random.Random(3)
    w = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = [(i, " ".join([*w[:-1], f"end{i}"]), None, f"s{i}", None) for i in range(6)] + [(10 + i, f"other {i} words {i * i}", None, f"t{i}", None) for i in range(6)]
    df = documents(rows)
    found = simhash.components_of(df, bits=8)
    clustered = packing.items_in_components(packing.items(df), found)
    got = {r["doc_id"]: (r["shard"], r["bin"]) for r in packing.pack_items(clustered).collect()}
    of = {r["id"]: r["root"] for r in found.collect()}
    near = [i for i in range(6) if of[i] == of[0]]
    assert len(near) > 3 and len({got[i] for i in near}) == len(near)


def test_a_frequent_row_is_dealt_to_many_shards(documents):
    rows = [(None, "a b c", None, "s", None)] * 500
    got = packing.pack(documents(rows), per_shard=50).collect()
    assert sorted(r["copy"] for r in got) == list(range(500)) and len({r["shard"] for r in got}) == 10


def test_defined_cases(odd, empty):
    got = packing.pack(odd).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in odd.select("doc_id").collect()}
    twice = [(r["shard"], r["bin"]) for r in got if r["doc_id"] == 20]
    assert len(twice) == 2 and len(set(twice)) == 2
    assert packing.pack(empty).count() == 0


def test_given_clusters_conflict(spark):
    df = spark.createDataFrame([(i, "a b", f"s{i}", "same", 0) for i in range(5)], "doc_id long, text string, source string, c string, bin long")
    got = packing.pack(df, cluster="c").collect()
    assert len({(r["shard"], r["bin"]) for r in got}) == 5
