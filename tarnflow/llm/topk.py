"""Exact top-k by inner product: ball trees per shard, searched by branch and bound.

1. Vectors are made integer (floor(scale * x)) and go to the nearest of at most `pivots` pivots, which are a bounded
   sample by hash; what is near one pivot is dealt to shards of about `per_shard` vectors. Each shard builds a ball tree.
2. Queries go in blocks. A block is first searched in its home shard, where its own vectors are; the kth scores that this
   gives are shared with all other searches.
3. Of each shard the balls of the first levels are known (a few kB). A query goes on to those shards only where its
   upper bound (q . centre + |q| * radius) reaches its kth score. A part has `per_tree` blocks of shards near each other, and
   gets a shard's tree once, if one of its queries goes there.
4. Within a search the node with the highest upper bound comes first, and a node is left out for every query whose kth
   score exceeds its bound. The lists of a query from all shards are merged at the end.

The sample decides how much is left out, never what is found.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part; a shorter vector counts
as filled with zeros; an empty vector is all zeros; rows with the query's own id are no candidates, repeated rows of
another id each are (of one id and vector the first k are enough); a repeated query is asked once; equal scores go to the
smaller id; null ids take no part; other columns are ignored; fewer candidates than k give them all; an empty table gives
an empty one.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.llm.common import first_by_hash, store

LEAF, FRONTIER, BALLS_AT_ONCE = 256, 8, 256
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def _dump(**arrays: np.ndarray) -> bytes:
    np.savez(held := io.BytesIO(), **arrays)
    return held.getvalue()


def _load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as x:
        return dict(x)


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """In the narrowest integers that hold it."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _wide(*parts: np.ndarray) -> list[np.ndarray]:
    """Matrices filled with zeros to one width."""
    width = max(p.shape[1] for p in parts)
    return [np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts]


def build(ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Ball tree: points in leaf order, and per node its range, children (0: leaf), centre and radius."""
    order = np.arange(len(x))
    points = x.astype(np.float64)
    nodes: list[tuple[int, int, int, int]] = [(0, len(x), 0, 0)]
    centres, radii, at = [], [], 0
    while at < len(nodes):
        a, b, _, _ = nodes[at]
        part = points[order[a:b]]
        centre = part.mean(axis=0) if b > a else np.zeros(x.shape[1])
        away = np.sqrt(((part - centre) ** 2).sum(axis=1)) if b > a else np.zeros(1)
        centres.append(centre)
        radii.append(float(away.max()))
        if b - a > LEAF and away.max() > 0:
            pole = part[away.argmax()]
            other = part[((part - pole) ** 2).sum(axis=1).argmax()]
            order[a:b] = order[a:b][np.argsort(part @ (other - pole), kind="stable")]
            middle = (a + b) // 2
            nodes[at] = (a, b, len(nodes), len(nodes) + 1)
            nodes += [(a, middle, 0, 0), (middle, b, 0, 0)]
        at += 1
    return {"ids": ids[order], "x": _narrow(x[order]), "nodes": np.array(nodes, np.int64), "centres": np.array(centres), "radii": np.array(radii)}


def frontier(tree: dict[str, np.ndarray]) -> np.ndarray:
    """Numbers of at most `FRONTIER` nodes whose balls hold all points."""
    found = [0]
    while len(found) < FRONTIER:
        inner = [n for n in found if tree["nodes"][n][2]]
        if not inner:
            break
        n = max(inner, key=lambda n: tree["radii"][n])
        found.remove(n)
        found += tree["nodes"][n][2:].tolist()
    return np.array(found)


def upper(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries with the points of balls, a little more for rounding."""
    q, centres = _wide(q.astype(np.float64), centres)
    bound = q @ centres.T + np.sqrt((q**2).sum(axis=1))[:, None] * radii[None, :]
    return bound + 1e-6 * (1 + np.abs(bound))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by way of doubles where these hold them exactly."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if most < 2**53 else q.astype(np.int64) @ x.astype(np.int64).T


def search(tree: dict[str, np.ndarray], qid: np.ndarray, q: np.ndarray, k: int, kth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best of a tree for each query, in order; candidates below a given kth score may be left out."""
    q, x = _wide(q, tree["x"])
    bound = upper(q, tree["centres"], tree["radii"])
    scores, ids = np.full((len(q), k), NONE), np.full((len(q), k), LAST)
    least = np.full(len(q), NONE) if kth is None else kth.copy()
    heap = [(-bound[:, 0].max(initial=-np.inf), 0)]
    while heap:
        _, node = heapq.heappop(heap)
        active = np.flatnonzero(bound[:, node] >= least)
        if not len(active):
            continue
        a, b, left, right = tree["nodes"][node].tolist()
        if left:
            for child in (left, right):
                heapq.heappush(heap, (-bound[active, child].max(), child))
            continue
        s = _products(q[active], x[a:b])
        i = np.broadcast_to(tree["ids"][a:b], s.shape)
        s = np.where(i == qid[active, None], NONE, s)
        some = (s >= np.maximum(least[active], NONE + 1)[:, None]).any(axis=1)
        active, s, i = active[some], s[some], i[some]
        s, i = np.concatenate([scores[active], s], axis=1), np.concatenate([ids[active], i], axis=1)
        top = np.lexsort((i, -np.maximum(s, NONE + 1)), axis=1)[:, :k]
        scores[active], ids[active] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        least[active] = np.maximum(least[active], scores[active, k - 1])
    return scores, ids


def quantised(df: DataFrame, is_query: Column, vec_id: str, vector: str, scale: int) -> DataFrame:
    v = F.col(vector)
    sound = v.isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    asked = F.coalesce(is_query, F.lit(False)).alias("asked")
    return df.where(sound).select(F.col(vec_id).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"), asked)


def top_k(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64, per_shard: int = 8192, per_block: int = 512, per_tree: int = 64, pivots: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows for each row that is a query."""
    rows = quantised(df, is_query, vec_id, vector, scale)
    # Of one id and vector no more than k rows can be among the best, so a frequent one is no large group.
    rows = rows.groupBy("id", "v").agg(F.max("asked").alias("asked"), F.least(F.count("*"), F.lit(k)).alias("n"))
    rows = store(rows.withColumn("h", F.xxhash64("id", "v")))
    total, asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    chosen = first_by_hash(rows.select("h", "id", "v"), "h", min(pivots, max(1, -(-total // per_shard))), total, "id").toPandas()
    marks = _matrix(chosen["v"]).astype(np.float64)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, c = _wide(_matrix(b["v"]).astype(np.float64), marks)
            yield b.assign(pivot=((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1) if len(c) > 1 else 0)

    rows = store(rows.mapInPandas(near, "id long, v array<long>, asked boolean, n long, h long, pivot long"))
    # At most `pivots` numbers; a pivot near which a large part of all vectors is gets as many shards as they need.
    sizes = dict(rows.groupBy("pivot").count().collect())
    shards_of = [-(-sizes.get(p, 0) // per_shard) for p in range(max(1, len(marks)))]
    firsts = np.cumsum([0, *shards_of]).tolist()
    place = lambda values: F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("pivot").cast("int"))
    rows = rows.withColumn("shard", place(firsts[:-1]) + F.pmod("h", F.greatest(place(shards_of), F.lit(1))))
    blocks_in_shard = max(1, -(-asked * per_shard // (max(1, total) * per_block)))
    n_blocks = firsts[-1] * blocks_in_shard
    parts, chunks = max(1, -(-n_blocks // per_tree)), max(1, -(-firsts[-1] // BALLS_AT_ONCE))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def plant(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id", kind="stable")
        n = b["n"].to_numpy()
        tree = build(np.repeat(b["id"].to_numpy(np.int64), n), np.repeat(_matrix(b["v"]), n, axis=0))
        at = frontier(tree)
        return pd.DataFrame({"shard": b["shard"].iloc[:1], "tree": [_dump(**tree)], "ball": [_dump(centres=tree["centres"][at], radii=tree["radii"][at])]})

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id", kind="stable")
        return pd.DataFrame({"block": b["block"].iloc[:1], "shard": b["shard"].iloc[:1], "asked": [_dump(ids=b["id"].to_numpy(np.int64), q=_narrow(_matrix(b["v"])))]})

    def first(blocks: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, shard, blob in zip(blocks["block"], blocks["shard"], blocks["asked"]):
            a = _load(blob)
            s, i = search(_load(trees["tree"].iloc[0]), a["ids"], a["q"], k)
            out.append({"block": block, "shard": shard, "part": block * parts // n_blocks, "asked": _dump(ids=a["ids"], q=a["q"], kth=s[:, k - 1]), "scores": s.reshape(-1), "found": i.reshape(-1)})
        return pd.DataFrame(out, columns=["block", "shard", "part", "asked", "scores", "found"])

    def bundle(b: pd.DataFrame) -> pd.DataFrame:
        balls = [_load(x) for x in b["ball"]]
        c = np.concatenate(_wide(*(x["centres"] for x in balls)))
        return pd.DataFrame({"chunk": b["chunk"].iloc[:1], "balls": [_dump(shards=np.repeat(b["shard"].to_numpy(), [len(x["radii"]) for x in balls]), centres=c, radii=np.concatenate([x["radii"] for x in balls]))]})

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for home, part, blob, balls in zip(b["shard"], b["part"], b["asked"], b["balls"]):
                a, x = _load(blob), _load(balls)
                near = upper(a["q"], x["centres"], x["radii"]) >= a["kth"][:, None]
                for shard in np.unique(x["shards"][near.any(axis=0)]).tolist():
                    if shard != home:
                        go = near[:, x["shards"] == shard].any(axis=1)
                        yield pd.DataFrame({"to": [shard], "part": [part], "asked": [_dump(ids=a["ids"][go], q=a["q"][go], kth=a["kth"][go])]})

    def lists(ids: np.ndarray, s: np.ndarray, i: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": np.repeat(ids, k), "vec_id": i.reshape(-1), "score": s.reshape(-1)})
        return out[out["score"] != NONE]

    def rest(blocks: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        tree, out = _load(trees["tree"].iloc[0]), []
        for blob in blocks["asked"]:
            a = _load(blob)
            out.append(lists(a["ids"], *search(tree, a["ids"], a["q"], k, a["kth"])))
        return pd.concat(out)

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob, s, i in zip(b["asked"], b["scores"], b["found"]):
                yield lists(_load(blob)["ids"], np.asarray(s), np.asarray(i))

    trees = store(rows.groupBy("shard").applyInPandas(plant, "shard long, tree binary, ball binary"))
    block = F.col("shard") * blocks_in_shard + F.pmod(F.xxhash64("h"), F.lit(blocks_in_shard))
    groups = store(rows.where("asked").withColumn("block", block).groupBy("block").applyInPandas(gather, "block long, shard long, asked binary"))
    known = groups.groupBy("shard").cogroup(trees.select("shard", "tree").groupBy("shard")).applyInPandas(first, "block long, shard long, part long, asked binary, scores array<long>, found array<long>")
    known = store(known)
    balls = trees.withColumn("chunk", F.pmod("shard", F.lit(chunks))).groupBy("chunk").applyInPandas(bundle, "chunk long, balls binary")
    balls = store(balls.withColumn("part", every(parts)))
    asking = known.select("shard", "part", "asked").withColumn("chunk", every(chunks)).join(balls.hint("merge"), ["chunk", "part"])
    # By the shard alone a hot shard's queries were one group; by parts each group has `per_tree` blocks and one tree.
    going = store(asking.select("shard", "part", "asked", "balls").mapInPandas(reach, "to long, part long, asked binary"))
    # A tree goes to the parts with a query that may find something in it.
    wanted = going.select(F.col("to").alias("shard"), F.col("part").alias("for_part")).distinct()
    sent = trees.select("shard", "tree").join(wanted.hint("merge"), "shard")
    found = going.groupBy("to", "part").cogroup(sent.groupBy("shard", "for_part")).applyInPandas(rest, "query_id long, vec_id long, score long")
    found = found.unionByName(known.select("asked", "scores", "found").mapInPandas(at_home, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql(k: int = 20) -> str:
    """The same rows from DuckDB."""
    return f"""
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, rank, vec_id, score FROM (
        SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
    WHERE rank <= {k}"""
