"""Near copies by SimHash with vantage-point trees, verified by the Jaccard similarity of their sets of word shingles.

1. Texts with the same words in lower case are one class; the rest works on classes.
2. A SimHash fingerprint of each class. The shards and trees of `simhash.edges` give a forest of the links within `BITS` bits;
   classes with one fingerprint are linked with the first of them. Links are verified, the others make components.
3. What differs in more bits (at a similarity of 0.8 some 10 of 64, where the trees rule out nothing): classes that share a band of
   MinHashes, and that step 2 left in different components. With 20 bands of 5, a pair at similarity 0.8 shares one with
   probability 0.9996, and one above it more surely.
4. Each pair is verified on its whole texts: no link without a similarity of `least` or more. What is linked late joins components.

Classes that share a band are compared all with all up to `most` of them. Beyond that a group is compared with three leaders first,
which joins most of a large group of copies by links in proportion to its size: the first leader is the most central class,
the one whose bands are shared most, as copies with changes of their own are held together by the text that they come
from. Then what the leaders left apart is looked for exactly, among all classes of such groups: shingles are ordered by how few
of these classes have them (as counted by remainders of their hashes), rarest first; two classes of a similarity of `least` share one of their first (1 - least) n ones,
their sizes and the places of the first shared one bound what else they can share, and sketches of their shingles' parities
bound what they differ in. Only pairs that these bounds allow, and that no link joins yet, are verified. So texts of one template that each fill with words of their own are not compared all with
all, and none of their links is lost.

Defined cases: null and blank texts are one class, of which one row stays; a text of fewer words than a shingle is one
shingle; very long texts are read whole; of ties the smallest id stays, null ids last; of repeated rows one stays; other
columns pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import cut, store
from tarnflow.llm.simhash import components, digests, edges, majority, only

BANDS, DEPTH = 20, 5
#: Bits in which fingerprints of linked classes may differ.
BITS = 3
#: Longs of a parity sketch, and remainders of hashes that are counted.
SKETCH, COUNTED = 16, 1 << 20
#: Parts of the remainders that are added up apart.
PARTS = 16
_rng = np.random.default_rng(42)
TIMES = _rng.integers(0, 1 << 63, BANDS * DEPTH, np.uint64) | np.uint64(1)
PLUS = _rng.integers(0, 1 << 63, BANDS * DEPTH, np.uint64)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def distinct(hashes: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(hashes, np.uint64))


def shingles(w: list[bytes], size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text's words."""
    return distinct(digests(w, size, 0))


def bands(h: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band; none for a text without words."""
    if not len(h):
        return []
    low = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 512):  # bounded memory for long texts
        low = np.minimum(low, (h[at : at + 512, None] * TIMES + PLUS).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), seed=i) for i, x in enumerate(low.reshape(BANDS, DEPTH))], np.uint64).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def classes(df: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(c, first, fp, bands): hash of the words, its first row (last, id, t), fingerprint, and keys of bands, a row for each class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c, fp, keys = [], [], []
            for x in b["text"]:  # the words of one text at a time, as those of a batch take ten times its texts
                w = tokens(x)
                c.append(xxhash.xxh64_intdigest(b" ".join(w)))
                hashes = digests(w, size, 0)
                fp.append(majority(hashes))
                keys.append(bands(distinct(hashes)))
            signed = lambda v: np.array(v, np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "t": b["t"], "c": signed(c), "fp": signed(fp), "bands": keys})

    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).cast("string").alias("text"))
    rows = rows.mapInPandas(run, "id long, t long, c long, fp long, bands array<long>")
    return rows.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "t")).alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))


def close(found: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) of classes by SimHash: a forest of fingerprints within `bits`, and the classes of each fingerprint."""
    named = store(found.groupBy("fp").agg(F.min("c").alias("c")))
    same = found.select("fp", F.col("c").alias("b")).join(named.hint("merge"), "fp").where("b <> c").select(F.col("c").alias("a"), "b")
    end = lambda k: named.select(F.col("fp").alias(k), F.col("c").alias(f"c{k}")).hint("merge")
    near = edges(named.select("fp"), bits).join(end("a"), "a").join(end("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    return same.union(near).distinct()


def candidates(found: DataFrame, most: int = 32) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes that share a band, a leader in the place of a where more than `most` share one; and the
    classes (c) of such groups."""
    rows = store(found.select("c", F.explode("bands").alias("key")))
    shared = store(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    rows = store(rows.join(shared.hint("merge"), "key"))
    few = rows.where(F.col("n") <= most).groupBy("key").agg(F.collect_list("c").alias("cs"))
    few = few.select(F.explode("cs").alias("a"), "cs").select("a", F.explode("cs").alias("b")).where("a < b")
    large = rows.where(F.col("n") > most)
    large = store(large.join(large.groupBy("c").agg(F.sum("n").alias("central")).hint("merge"), "c"))
    leader = lambda by: F.max(F.struct(by.alias("by"), "c")).getField("c")
    leaders = large.groupBy("key").agg(leader(F.col("central")).alias("l1"), leader(F.xxhash64("c", F.lit(1))).alias("l2"), leader(F.xxhash64("c", F.lit(2))).alias("l3"))
    led = large.select("key", "c").join(store(leaders).hint("merge"), "key")
    many = led.select(F.explode(F.array("l1", "l2", "l3")).alias("a"), F.col("c").alias("b")).where("a <> b")
    return few.union(many).distinct(), store(large.select("c").distinct())


def verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts (c, text) have a similarity of `least` or more."""
    side = lambda k: texts.select(F.col("c").alias(k), F.col("text").alias(f"t{k}"))
    both = store(pairs.join(side("a").hint("merge"), "a")).join(side("b").hint("merge"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            held: dict[int, np.ndarray] = {}
            keep = []
            for a, b, ta, tb in x.itertuples(index=False):
                for k, text in ((a, ta), (b, tb)):
                    if k not in held:
                        held[k] = shingles(tokens(text), size)
                keep.append(similarity(held[a], held[b]) >= least)
            yield x.loc[np.array(keep, bool), ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def parity(h: np.ndarray) -> list[int]:
    """For each of 64 * `SKETCH` remainders whether an odd number of the hashes has it, as signed longs. Each hash that only
    one of two sets has changes one bit, so the sketches of two sets differ in no more bits than the sets in hashes."""
    odd = np.bincount((h % np.uint64(64 * SKETCH)).astype(np.intp), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def allowed(texts: DataFrame, label: DataFrame, size: int, least: float) -> DataFrame:
    """Pairs (a, b) of classes (c, text) with different labels (id, p) that may have a similarity of `least` or more: all that do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = [shingles(tokens(x), size) for x in b["text"]]
            yield pd.DataFrame({"c": b["c"], "n": [len(x) for x in h], "h": [x.view(np.int64) for x in h], "odd": [parity(x) for x in h]})

    sets = store(texts.mapInPandas(run, "c long, n int, h array<long>, odd array<long>"))
    # How many classes have a shingle, by remainders of its hash: any order that goes by the shingle alone is right, and counts
    # of remainders (at most `COUNTED` on the driver) put rare ones first nearly as well as counts of shingles.
    # A task adds its own up, so that no shingle is a row; then the tasks' counts are added by parts of the remainders.
    span = COUNTED // PARTS
    packed = "part int, k array<int>, times array<long>"

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times = np.zeros(COUNTED, np.int64)
        for b in batches:
            for h in b["h"]:
                np.add.at(times, np.asarray(h, np.int64) % COUNTED, 1)
        some = [(i, np.flatnonzero(x), x) for i, x in enumerate(times.reshape(PARTS, span)) if x.any()]
        yield pd.DataFrame({"part": [i for i, _, _ in some], "k": [k.astype(np.int32) for _, k, _ in some], "times": [x[k] for _, k, x in some]})

    def added(x: pd.DataFrame) -> pd.DataFrame:
        times = np.zeros(span, np.int64)
        for k, n in zip(x["k"], x["times"]):
            times[k] += n
        k = np.flatnonzero(times)
        return pd.DataFrame({"part": [int(x["part"].iloc[0])], "k": [k.astype(np.int32)], "times": [times[k]]})

    times = np.zeros(COUNTED, np.int32)
    for r in sets.select("h").mapInPandas(tally, packed).groupBy("part").applyInPandas(added, packed).toPandas().itertuples():
        times[r.part * span + np.asarray(r.k, np.int64)] = np.minimum(r.times, np.iinfo(np.int32).max)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first shingles of each class that another class may have, and how many shingles a class may have that shares them."""
        for b in batches:
            out = []
            for n, h in zip(b["n"].tolist(), b["h"]):
                h = np.asarray(h, np.int64)
                often = times[h % COUNTED]
                order = np.lexsort((h, often))[: n - math.ceil(n * least - 1e-9) + 1]
                # From its place on a class has n - place shingles: as many can be shared at most, and least / (1 + least) of both sizes must be.
                most = np.floor((n - np.arange(len(order))) * ((1 + least) / least) - n + 1e-6).astype(np.int64)
                some = (often[order] > 1) & (most >= n * least - 1e-6)
                out.append([{"h": x, "most": y} for x, y in zip(h[order][some].tolist(), most[some].tolist())])
            yield pd.DataFrame({"c": b["c"], "n": b["n"], "x": out})

    rows = sets.select("c", "n", "h").mapInPandas(first, "c long, n int, x array<struct<h:long,most:long>>")
    rows = store(rows.select("c", "n", F.inline("x")))
    rows = rows.join(label.withColumnRenamed("id", "c").hint("merge"), "c", "left").withColumn("p", F.coalesce("p", "c"))
    rows = store(rows)
    mixed = rows.groupBy("h").agg(F.min("p").alias("low"), F.max("p").alias("high")).where("low < high").select("h")
    rows = rows.join(store(mixed).hint("merge"), "h")
    odd = [f"odd{i}_" for i in range(SKETCH)]
    rows = store(rows.join(sets.select("c", *[F.col("odd")[i].alias(name) for i, name in enumerate(odd)]).hint("merge"), "c"))
    a, b = (rows.select("h", *[F.col(c).alias(f"{c}{k}") for c in ("c", "n", "most", "p", *odd)]) for k in "ab")
    meet = (F.col("ca") < F.col("cb")) & (F.col("pa") != F.col("pb")) & (F.col("nb") <= F.col("mosta")) & (F.col("na") <= F.col("mostb"))
    near = (F.col("na") >= F.col("nb") * least - 1e-6) & (F.col("nb") >= F.col("na") * least - 1e-6)
    # Two sets of a similarity of `least` differ in (1 - least) / (1 + least) of both sizes at most.
    differ = sum((F.bit_count(F.col(f"{x}a").bitwiseXOR(F.col(f"{x}b"))) for x in odd), F.lit(0))
    near = near & (differ <= (F.col("na") + F.col("nb")) * ((1 - least) / (1 + least)) + 1e-6)
    return a.join(b.hint("merge"), "h").where(meet & near).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def with_components(links: DataFrame, label: DataFrame) -> DataFrame:
    """Links (a, b) with the components pa and pb of their ends by label (id, p)."""
    end = lambda k: label.select(F.col("id").alias(k), F.col("p").alias(f"p{k}")).hint("merge")
    both = links.join(end("a"), "a", "left").join(end("b"), "b", "left")
    return both.select("a", "b", F.coalesce("pa", "a").alias("pa"), F.coalesce("pb", "b").alias("pb"))


def joined(label: DataFrame, more: DataFrame, nodes: DataFrame) -> DataFrame:
    """label (id, p) of nodes (id) with links (a, b) that were found late: they join components, and nodes without one."""
    if more.isEmpty():
        return label
    all_of = store(nodes.join(label.hint("merge"), "id", "left").select("id", F.coalesce("p", "id").alias("p")))
    over = components(with_components(more, label).select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    return store(all_of.join(over.select(F.col("id").alias("p"), F.col("p").alias("low")).hint("merge"), "p", "left").select("id", F.coalesce("low", "p").alias("p")))


def labels(df: DataFrame, found: DataFrame, doc_id: str, text: str, size: int, least: float, most: int = 32) -> DataFrame:
    """(id, p): of the classes with a link the smallest one that each is connected to."""
    near = store(close(found))
    pairs, large = candidates(found, most)
    pairs = store(pairs)
    ends = lambda x: x.select("a").union(x.select("b"))
    asked = store(ends(near).union(ends(pairs)).distinct().withColumnRenamed("a", "c"))
    firsts = store(found.join(asked.hint("merge"), "c").select("c", F.col("first.id").alias("_id"), F.col("first.t").alias("_t")))
    texts = df.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).cast("string").alias("text"))
    texts = texts.join(firsts.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))).select("c", "text")
    texts = store(texts.dropDuplicates(["c"]))
    nodes = texts.select(F.col("c").alias("id"))
    label = components(verified(near, texts, size, least))
    apart = with_components(pairs, label).where("pa <> pb").select("a", "b")
    label = joined(label, store(verified(apart, texts, size, least)), nodes)
    if large.isEmpty():
        return label
    more = verified(store(allowed(texts.join(large.hint("merge"), "c"), label, size, least)), texts, size, least)
    return joined(label, store(more), nodes)


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8, most: int = 32) -> DataFrame:
    """The rows of df that stay: of each component the one with the smallest id, nulls last; of repeated rows one."""
    found = cut(classes(df, doc_id, text, size))
    label = labels(df, found, doc_id, text, size, least, most)
    rooted = found.select("c", "first").join(label.withColumnRenamed("id", "c"), "c", "left").select("first", F.coalesce("p", "c").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return only(df, first.select(F.col("first.id").alias("id"), F.col("first.t").alias("t")), doc_id, text)
