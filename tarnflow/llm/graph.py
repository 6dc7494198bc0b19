"""Approximate nearest neighbours by largest inner product: a robust-pruned directed graph per shard, searched by beams.

1. Vectors get one coordinate more, so that all have the length of the longest: then the largest inner product with a query
   is the smallest distance. Equal vectors are one node with the smallest ids that a result can hold.
2. Nodes are dealt to shards by hash. A shard grows its graph in batches: a greedy search from the entry points proposes
   what it passed as neighbours of a new node; of these, nearest first, one goes where a kept one is nearer to it by the
   factor `alpha` than the node is (relaxed pruning, which leaves long edges). Edges back are added and pruned alike.
3. Graphs are stored: an index. Blocks of queries go to every shard, each is searched by a beam of `beam` nodes, and scores
   are computed in double precision from the original vectors. The best of all shards are merged.

Every row is in the index; what a beam misses is the error, which tests measure as recall. A shard has `least` vectors up to
`shards` of them, then grows to `most`, so that up to shards * most vectors a query has a bounded number of searches.

Defined cases: vectors that are null, all zeros, empty, or hold a null or non-finite component take no part, neither as
queries nor as candidates; a shorter vector counts as filled with zeros; rows with the query's own id are no candidates,
repeated rows of another id each are; a repeated query is asked once; equal scores go to the smaller id; null ids take no
part; fewer candidates than k give them all; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.llm.common import store

FOUND = "query_id long, vec_id long, score double"


def _dump(**arrays: np.ndarray) -> bytes:
    np.savez(held := io.BytesIO(), **arrays)
    return held.getvalue()


def _load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as x:
        return dict(x)


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of one width or less, filled with zeros."""
    held = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(held.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = held.flatten().to_numpy(zero_copy_only=False)
    return out


def search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(found, passed): for each query the nodes of the final beam, best first, and those that were expanded; -1 where none.

    All queries take a step at once: the best node that isn't expanded gives its neighbours, and the best stay.
    """
    n = len(q)
    at = np.arange(n)
    width = max(beam, len(entries))
    ids, scores = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32)
    ids[:, : len(entries)], scores[:, : len(entries)] = entries, q @ x[entries].T
    seen = np.zeros((n, len(x)), bool)
    seen[:, entries] = True
    done, passed = np.zeros((n, width), bool), []
    order = np.argsort(-scores, axis=1, kind="stable")
    ids, scores = np.take_along_axis(ids, order, 1)[:, :beam], np.take_along_axis(scores, order, 1)[:, :beam]
    done = done[:, :beam]
    while True:
        open_ = ~done & (ids >= 0)
        some = open_.any(axis=1)
        if not some.any():
            break
        rows = at[some]
        place = open_[rows].argmax(axis=1)
        node = ids[rows, place]
        done[rows, place] = True
        step = np.full(n, -1, np.int32)
        step[rows] = node
        passed.append(step)
        near = edges[node]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        seen[rows[:, None], near] |= fresh
        s = np.einsum("ard,ad->ar", x[near], q[rows])
        s[~fresh] = -np.inf
        s, near = np.concatenate([scores[rows], s], axis=1), np.concatenate([ids[rows], np.where(fresh, near, -1)], axis=1)
        d = np.concatenate([done[rows], np.zeros(fresh.shape, bool)], axis=1)
        best = np.argsort(-s, axis=1, kind="stable")[:, :beam]
        scores[rows], ids[rows], done[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(near, best, 1), np.take_along_axis(d, best, 1)
    return ids, np.stack(passed, axis=1) if passed else np.full((n, 0), -1, np.int32)


def pruned(x: np.ndarray, length: float, nodes: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to `degree` of the proposed neighbours (-1: none) of each node: nearest first, without those that a kept one covers."""
    s = np.einsum("bcd,bd->bc", x[proposed], x[nodes])
    s[(proposed < 0) | (proposed == nodes[:, None])] = -np.inf
    order = np.argsort(-s, axis=1, kind="stable")
    s, proposed = np.take_along_axis(s, order, 1), np.take_along_axis(proposed, order, 1)
    held = x[proposed]
    # Squared distances of vectors of one length; the relaxation is for distances.
    between, away = alpha**2 * 2 * (length - np.matmul(held, held.transpose(0, 2, 1))), 2 * (length - s)
    alive, at = np.isfinite(s), np.arange(len(nodes))
    alive[:, 1:] &= (proposed[:, 1:] != proposed[:, :-1])  # one that was proposed twice stands beside itself
    out = np.full((len(nodes), degree), -1, np.int32)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        j = alive.argmax(axis=1)
        out[some, k] = proposed[some, j[some]]
        alive &= ~(some[:, None] & (between[at, j] <= away))
        alive[at, j] = False
    return out


def grow(x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, entries: int = 8, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entry points) of a graph over vectors of one length, in the order in which they stand."""
    n = len(x)
    length = float((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
    edges = np.full((n, degree), -1, np.int32)
    doors = np.arange(min(n, entries), dtype=np.int32)
    ready = 0
    while ready < n:
        nodes = np.arange(ready, min(n, ready + batch if ready >= batch else max(64, 2 * ready)), dtype=np.int32)
        if ready:
            proposed = search(x, edges, doors, x[nodes], beam)[1]
        else:  # the first ones propose each other
            proposed = np.broadcast_to(nodes, (len(nodes), len(nodes))).copy()
        out = np.concatenate([pruned(x, length, nodes[i : i + 128], proposed[i : i + 128], degree, alpha) for i in range(0, len(nodes), 128)])
        edges[nodes] = out
        ready = int(nodes[-1]) + 1
        to, back = out.reshape(-1), np.repeat(nodes, degree)
        to, back = to[to >= 0], back[to >= 0]
        _join(x, length, edges, to, back, degree, alpha)
    return edges, doors


def _join(x: np.ndarray, length: float, edges: np.ndarray, to: np.ndarray, back: np.ndarray, degree: int, alpha: float) -> None:
    """Add the edges to -> back; a node with too many is pruned."""
    known = (edges[to] == back[:, None]).any(axis=1)
    to, back = to[~known], back[~known]
    # Nearest first; of more than `degree` new ones to a node the nearest are proposed.
    order = np.lexsort((-np.einsum("ad,ad->a", x[to], x[back]), to))
    to, back = to[order], back[order]
    rank = np.arange(len(to)) - np.searchsorted(to, to)
    to, back, rank = to[rank < degree], back[rank < degree], rank[rank < degree]
    nodes, which = np.unique(to, return_inverse=True)
    new = np.full((len(nodes), degree), -1, np.int32)
    new[which, rank] = back
    both = np.concatenate([edges[nodes], new], axis=1)
    full = (both >= 0).sum(axis=1) > degree
    packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
    edges[nodes[~full]] = packed[~full, :degree]
    for i in range(0, int(full.sum()), 128):
        some = nodes[full][i : i + 128]
        edges[some] = pruned(x, length, some, both[full][i : i + 128], degree, alpha)


def _sound(df: DataFrame, is_query: Column, vec_id: str, vector: str) -> DataFrame:
    v = F.col(vector)
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    sound = v.isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda c: c != 0)
    return df.where(sound).select(F.col(vec_id).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))


def index(rows: DataFrame, k: int, least: int = 8192, most: int = 65536, shards: int = 64, degree: int = 32, beam: int = 64, alpha: float = 1.2) -> DataFrame:
    """(shard, graph) over rows (id, v): stored graphs that `nearest` searches for up to k ids."""
    # One id more than wanted, as the query's own is left out. Spark keeps as many of each vector before it shuffles.
    rank = F.row_number().over(W.partitionBy("v").orderBy("id"))
    few = rows.select("id", "v").withColumn("rank", rank).where(F.col("rank") <= k + 1)
    nodes = store(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    n, longest, width = nodes.agg(F.count("*"), F.max(squares), F.max(F.size("v"))).first()
    n_shards = max(1, -(-n // most), min(-(-n // least), shards))

    def plant(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending")])
        v = _matrix(t.column("v"), width)
        rest = np.sqrt(np.maximum(0.0, longest - (v**2).sum(axis=1)))
        edges, doors = grow(np.column_stack([v, rest]).astype(np.float32), degree, beam, alpha)
        ids = t.column("ids").combine_chunks()
        as_float = v.astype(np.float32)
        v = as_float if (as_float == v).all() else v
        blob = _dump(v=v, edges=edges, doors=doors, ids=ids.flatten().to_numpy(), starts=ids.offsets.to_numpy() - ids.offsets[0].as_py())
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "graph": pa.array([blob], pa.binary())})

    dealt = nodes.withColumn("h", F.xxhash64("v")).withColumn("shard", F.pmod("h", F.lit(n_shards)).cast("long"))
    return store(dealt.groupBy("shard").applyInArrow(plant, "shard long, graph binary"))


def nearest(graphs: DataFrame, queries: DataFrame, k: int, beam: int = 128, per_block: int = 512, per_part: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best found for queries (id, v)."""
    queries = queries.select("id", "v").distinct()
    queries = store(queries.withColumn("h", F.xxhash64("id", "v")))
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_blocks = max(1, -(-n // per_block))
    parts = -(-n_blocks // per_part)
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c - 1).cast("long")))

    def gather(t: pa.Table) -> pa.Table:
        blob = _dump(ids=t.column("id").to_numpy(), q=_matrix(t.column("v"), width))
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int64()), "asked": pa.array([blob], pa.binary())})

    def beams(blocks: pa.Table, held: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        g = _load(held.column("graph")[0].as_py()) if held.num_rows else None
        x = g["v"].astype(np.float32) if g else None
        for blob in blocks.column("asked") if g else ():
            a = _load(blob.as_py())
            q = np.zeros((len(a["ids"]), x.shape[1]))
            w = min(width, x.shape[1])
            q[:, :w] = a["q"][:, :w]
            doors = g["doors"] if len(x) > beam else np.arange(len(x), dtype=np.int32)
            found, _ = search(x, g["edges"], doors, q.astype(np.float32), max(beam, k + 1))
            row, place = np.nonzero(found >= 0)
            node = found[row, place]
            s = np.einsum("ad,ad->a", q[row], g["v"][node].astype(np.float64))
            counts = g["starts"][node + 1] - g["starts"][node]
            row, s, first = np.repeat(row, counts), np.repeat(s, counts), np.repeat(g["starts"][node] - (np.cumsum(counts) - counts), counts)
            ids = g["ids"][first + np.arange(len(first))]
            other = ids != a["ids"][row]
            row, s, ids = row[other], s[other], ids[other]
            order = np.lexsort((ids, -s, row))
            row, s, ids = row[order], s[order], ids[order]
            few = np.arange(len(row)) - np.searchsorted(row, row) < k
            for c, values in (("query_id", a["ids"][row]), ("vec_id", ids), ("score", s)):
                out[c].append(values[few])
        return pa.table({c: pa.array(np.concatenate([np.zeros(0, np.float64 if c == "score" else np.int64), *v])) for c, v in out.items()})

    blocks = store(queries.withColumn("block", F.pmod("h", F.lit(n_blocks)).cast("long")).groupBy("block").applyInArrow(gather, "block long, asked binary"))
    shards = (graphs.agg(F.max("shard")).first()[0] or 0) + 1
    asking = blocks.withColumn("part", F.col("block") % parts).withColumn("shard", every(shards))
    held = graphs.withColumn("part", every(parts))
    found = asking.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInArrow(beams, FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_all(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", beam: int = 128, **settings) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest other rows found for each row that is a query."""
    rows = store(_sound(df, is_query, vec_id, vector))
    return nearest(index(rows, k, **settings), rows.where("asked"), k, beam)
