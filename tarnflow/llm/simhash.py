"""SimHash near-dedup with vantage-point trees.

1. A fingerprint per document; the rest works on distinct fingerprints, so exact copies cost one row each.
2. A vantage-point tree of bounded depth is fitted on a bounded sample (by hash, so the same on every run). It
   partitions the space: at a node, fingerprints within `radius` of the vantage point go inside, the others outside.
   Every fingerprint is a member of one leaf (shard), and visits as a query the leaves that the triangle
   inequality can't rule out within `bits`. A pair is met where its member with the smaller leaf number is at home.
3. Each shard builds its own tree over its members and joins members and queries down both branches with the same
   bound, to leaves that are compared in full. It gives a spanning forest of its links instead of all pairs.
4. Components of the forests: min-label hooking and pointer jumping on DataFrames, cut at each round.

Exact at every size: the sample decides how evenly shards fill, never which pairs are found.

Defined cases: a null or blank text has fingerprint zero, linked like any other; a very long text is read whole, in
bounded memory; rows with equal fingerprints share a
component; null ids are ignored for the component's name unless a component has no other; an empty table gives an
empty one; columns besides the two named are ignored by `near_duplicates` and kept by `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import GIVEN, aside, back, cut, first_by_hash, given, release, store

Tree = list[tuple[int, int, int, int]]  # (vantage point, radius, inside, outside); a child below 0 is leaf -child - 1


def digests(w: list[bytes], shingle: int, seed: int) -> bytes:
    """64-bit hashes of the shingles of a text's words, repeats included, 8 bytes each."""
    if not w:
        return b""
    parts = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[i:] for i in range(shingle))))
    digest = xxhash.xxh64_digest
    return b"".join([digest(p, seed) for p in parts])


def majority(hashes: bytes) -> int:
    """Unsigned 64-bit SimHash of what `digests` gives."""
    n = len(hashes) // 8
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8 << 16):  # bounded memory for long texts
        ones += np.unpackbits(np.frombuffer(hashes[at : at + (8 << 16)], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    return majority(digests((text or "").encode("utf-8", "surrogatepass").lower().split(), shingle, seed))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, t, fp): t is a hash of the text, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(x, shingle, seed) for x in b["text"]], np.uint64)
            yield pd.DataFrame({"id": b["id"], "t": b["t"], "fp": fp.view(np.int64)})

    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, "id long, t long, fp long")


def far(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def split(points: np.ndarray, bits: int, tries: int = 12) -> tuple[np.uint64, int] | None:
    """Vantage point and radius with the fewest points near the border; None where no radius parts the points."""
    best, n = None, len(points)
    for v in points[:: max(1, n // tries)][:tries]:
        d = far(points, v)
        r = int(np.partition(d, n // 2)[n // 2])
        for radius in (r - 1, r):
            inside = np.count_nonzero(d <= radius)
            if 0 < inside < n:
                cost = max(inside, n - inside) + np.count_nonzero(np.abs(d - radius) <= bits)
                if best is None or cost < best[0]:
                    best = (cost, v, radius)
    return best and (best[1], best[2])


def build(sample: np.ndarray, shards: int, bits: int) -> Tree:
    """Tree with about `shards` leaves, or as many as the sample can tell apart."""
    tree: Tree = []
    leaves = 0

    def grow(points: np.ndarray, share: float) -> int:
        nonlocal leaves
        found = split(points, bits) if share > 1 and len(points) >= 16 else None
        if found is None:
            leaves += 1
            return -leaves
        at, inside = len(tree), far(points, found[0]) <= found[1]
        tree.append((0, 0, 0, 0))
        tree[at] = (int(found[0]), found[1], grow(points[inside], share * inside.mean()), grow(points[~inside], share * (1 - inside.mean())))
        return at

    grow(sample, shards)
    return tree


def visits(tree: Tree, fp: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, row numbers, is the leaf their home) for all leaves that rows reach within `bits`."""
    todo = [(0 if tree else -1, np.arange(len(fp)), np.ones(len(fp), bool))]
    while todo:
        node, rows, home = todo.pop()
        if not len(rows):
            continue
        if node < 0:
            yield -node - 1, rows, home
            continue
        v, radius, inside, outside = tree[node]
        d = far(fp[rows], np.uint64(v))
        for child, near, own in ((inside, d <= radius + bits, d <= radius), (outside, d > radius - bits, d > radius)):
            todo.append((child, rows[near], (home & own)[near]))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected number for each of n nodes under links a-b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        keep = x != y
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
    return label


def links(members: np.ndarray, queries: np.ndarray, bits: int, leaf: int = 256, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among members, and between members and queries. Both are distinct, and disjoint."""
    nodes = np.concatenate([members, queries])
    n, label, held, size = len(nodes), np.arange(len(nodes)), [], 0

    def merge() -> None:
        nonlocal held, size, label
        a, b = (np.concatenate(x) for x in zip(*held))
        label = forest(n, np.concatenate([np.arange(n), a]), np.concatenate([label, b]))
        held, size = [], 0

    todo = [(np.arange(len(members)), np.arange(len(members), n))]
    while todo:
        m, q = todo.pop()
        if not len(m):
            continue
        found = split(nodes[m], bits) if len(m) > leaf else None
        if found is None:
            for at in range(0, len(m), leaf):
                part = m[at : at + leaf]
                for start in range(0, len(others := np.concatenate([m[at:], q])), 4096):
                    block = others[start : start + 4096]
                    i, j = np.nonzero(np.bitwise_count(nodes[part][:, None] ^ nodes[block][None, :]) <= bits)
                    i, j = part[i], block[j]
                    keep = label[i] != label[j]
                    if keep.any():
                        held.append((i[keep], j[keep]))
                        size += int(keep.sum())
                        if size > most:
                            merge()
            continue
        v, radius = found
        dm, dq = far(nodes[m], v), far(nodes[q], v)
        inside = dm <= radius
        # A member outside but near the border also asks inside, so that each pair across it is met once.
        todo.append((m[inside], np.concatenate([q[dq <= radius + bits], m[~inside & (dm <= radius + bits)]])))
        todo.append((m[~inside], q[dq > radius - bits]))
    if held:
        merge()
    linked = np.flatnonzero(label != np.arange(n))
    return nodes[linked], nodes[label[linked]]


def shard_size(n: int) -> int:
    """Fingerprints of a shard: as many as keep the shards few, to a bound on a task's memory.

    In 64 bits nearly all distances are about 32, so at each level a good part of all points lies near the border and goes
    both ways: copies grow with the number of shards, not with n. Large shards cost their own tree's time only.
    """
    return int(np.clip(n // 32, 8192, 1 << 20))


def edges(classes: DataFrame, bits: int, per_shard: int | None = None, sample: int = 1024) -> DataFrame:
    """Forest of links (a, b) among the distinct fingerprints `fp` of classes.

    The driver sees `sample` fingerprints for each shard, 65,536 at least, to place the borders of the shards.
    """
    n = classes.count()
    shards = -(-n // (per_shard or shard_size(n)))
    hashed = classes.select("fp", F.xxhash64("fp").alias("h"))
    seen = first_by_hash(hashed, "h", min(max(65536, sample * shards), max(1, n // 4)), n, "fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = build(seen, shards, bits)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            # Leaves are numbered inside first: a pair across a border is met in the inner leaf, so queries go inward only.
            at_home = np.empty(len(fp), np.int64)
            reached = list(visits(tree, fp.view(np.uint64), bits))
            for shard, rows, home in reached:
                at_home[rows[home]] = shard
            for shard, rows, home in reached:
                go = home | (at_home[rows] > shard)
                yield pd.DataFrame({"shard": np.int64(shard), "fp": fp[rows[go]], "home": home[go]})

    def join(b: pd.DataFrame) -> pd.DataFrame:
        fp, home = b["fp"].to_numpy(np.int64).view(np.uint64), b["home"].to_numpy(bool)
        x, y = links(fp[home], fp[~home], bits)
        return pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

    return classes.select("fp").mapInPandas(place, "shard long, fp long, home boolean").groupBy("shard").applyInPandas(join, "a long, b long")


def components(edge: DataFrame) -> DataFrame:
    """(id, p): the smallest id connected to each id that occurs in links (a, b)."""
    both = store(edge.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edge.select("b", "a")).distinct())
    state = store(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("p")))
    before = None
    while True:
        total = state.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]
        if total == before:
            release(both)
            return state
        before = total
        up = state.select(F.col("id").alias("p"), F.col("p").alias("g"))
        jumped = store(state.join(up.hint("merge"), "p").select("id", "p", "g"))
        low = both.join(jumped.select(F.col("id").alias("v"), "g").hint("merge"), "v").groupBy("u").agg(F.min("g").alias("low"))
        near = jumped.join(low.withColumnRenamed("u", "id"), "id")
        best = F.least("g", "low")
        offers = near.select(F.explode(F.array(F.struct("id", best.alias("p")), F.struct(F.col("p").alias("id"), best.alias("p")))).alias("o"))
        old, state = state, store(offers.groupBy("o.id").agg(F.min("o.p").alias("p")))
        release(old, jumped)


def components_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, t, fp, root, component_id), one row for each row of df; root is the component's smallest fingerprint."""
    rows = cut(fingerprints(df, doc_id, text, shingle, seed))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("rep")))
    label = components(edges(classes, bits))
    rooted = classes.join(label.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "rep", F.coalesce("p", "fp").alias("root"))
    rooted = store(rooted)
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    names = store(rooted.join(named, "root").select("fp", "root", "component_id"))
    return rows.join(names.hint("merge"), "fp").select("id", "t", "fp", "root", "component_id")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of df."""
    found = components_of(df, doc_id, text, bits, shingle, seed)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The rows of df that stay: of each component the one with the smallest id, nulls last; of repeated rows one."""
    found = components_of(df, doc_id, text, bits, shingle, seed)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "t")).alias("first"))
    return only(df, first.select(F.col("first.id").alias("id"), F.col("first.t").alias("t")), doc_id, text)


def only(df: DataFrame, first: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of df whose id and hash of the text are in `first` (id, t); of repeated rows one."""
    first = store(first.distinct())
    rows = aside(df).withColumn("of", F.xxhash64(given(text)))
    rows = rows.join(first, given(doc_id).cast("long").eqNullSafe(F.col("id")) & (F.col("of") == F.col("t")), "left_semi")
    return back(rows.dropDuplicates([GIVEN + doc_id, "of"]).drop("of"))
