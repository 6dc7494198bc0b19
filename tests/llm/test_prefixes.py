import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tarnflow.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, n long, key string, depth int, part string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            d = hashlib.md5(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, d, r or "", x or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in turns}
    return {c: tuple(turns.get(c - c % 5, [])[: h[c]] + turns[c][h[c] :]) for c in turns}


def brute(seqs):
    """Rows of the trie of {conversation: sequence}, from every prefix."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in members.items()), key=repr)


def run(df, heads=True, **settings):
    convs = prefixes.gathered(df)
    return sorted(map(tuple, prefixes.trie(prefixes.with_heads(convs) if heads else convs, **settings).collect()), key=repr)


def sample(n, rng):
    """Conversations of few different turns, some copies, one long, ids with gaps."""
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.choice((1, 1, 2, 4, 7, 9))):
            rows.append((c, t, rng.choice("ua"), rng.choice(("x", "é", "longer text")), None, None, None, None))
    rows += [(5000, t, "u", f"{t % 3}", None, None, None, None) for t in range(300)]
    rows += [(5100, t, "u", f"{t % 3}" if t < 250 else "z", None, None, None, None) for t in range(300)]
    rows += [(c, t, "u", "copy", None, None, None, None) for c in range(6000, 6400, 3) for t in range(5)]
    return rows


@pytest.mark.parametrize("per_range", [32768, 7])
def test_matches_brute_force(spark, per_range):
    rows = sample(200, random.Random(per_range))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert run(df, per_range=per_range) == brute(rebuilt(rows))


def test_without_heads(spark):
    rows = sample(60, random.Random(3))
    turns = defaultdict(list)
    for c, t, r, x, *_ in sorted(rows):
        turns[c].append((r, x))
    assert run(spark.createDataFrame(rows, SCHEMA), False, per_range=11) == brute({c: tuple(v) for c, v in turns.items()})


def test_defined_cases(spark):
    """Nulls, repeated rows, equal turns, a very long text, turnless conversations (absent base, all own turns dropped)."""
    more = [None] * 4
    rows = [(1, None, None, None, *more), (1, 0, "u", "x" * 300_000, *more), (2, 3, "u", "a", *more), (2, 3, "u", "a", *more), (2, 3, "a", "a", *more), (None, 1, "u", "lost", *more), (0, 1, "u", "a", *more)]
    rows += [(c, 1, "u", "only", *more) for c in range(101, 110) if c % 5]  # no conversation 100 or 105
    df = spark.createDataFrame(rows, SCHEMA)
    want = rebuilt(rows)
    assert () in want.values()
    assert run(df) == brute(want)
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_ranges_agree_with_one():
    """Points of ranges, added up, are those of one range."""
    rng = random.Random(9)
    turn = {c: hashlib.md5(c.encode()).digest() for c in "abc"}
    seqs = sorted({b"".join(turn[c] for c in rng.choices("aaab", k=rng.randint(0, 12))) for _ in range(300)})
    sums = [np.arange(len(s) // 16 + 1) * 10 for s in seqs]

    def whole(cuts):
        total, borders = {}, [0, *cuts, len(seqs)]
        left, right = prefixes.outlook([prefixes.border(seqs[a:b]) for a, b in zip(borders, borders[1:])])
        for a, b, before_it, behind in zip(borders, borders[1:], left, right):
            for depth, key, above, n, conv, leaves, told, fresh, before, edge in prefixes.points(seqs[a:b], sums[a:b], [1] * (b - a), list(range(a, b)), before_it, behind):
                old = total.get((depth, key), (above, 0, conv, 0, 0, 0, before, None))
                assert old[0] == above and old[6] == before
                total[depth, key] = (above, old[1] + n, min(x for x in (old[2], conv, 1 << 60) if x is not None), old[3] + leaves, old[4] + told, old[5] + fresh, before, old[7] or edge)
        return total

    one = whole([])
    assert whole(list(range(1, len(seqs)))) == whole([5, 6, len(seqs) // 2]) == one
