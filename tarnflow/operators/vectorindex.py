"""Approximate cosine search over a stored index: a layered proximity graph for each cell.

Vectors of length one are dealt to cells by the nearest of some pivots (a bounded sample, by hash); a cell beyond `most`
vectors is cut into parts. A cell's graph has layers: all its vectors at the bottom, one in m of a layer in the next. A node's
links are chosen among its `ef` nearest of the layer (exact within a cell): one that is nearer to a chosen link than to the node
is passed over, and the links back are added, up to 2 m. A search goes down greedily to the bottom layer and there keeps a
beam; scores are computed anew from the stored vectors in double precision, as exact search has them.

Build once with `write`, then `search` with tables of queries; only graphs and queries are read. Queries are sent to the cells
whose pivots are nearest, `probe` of them; by default to all, as vectors without clusters have their neighbours anywhere.

Defined cases: vectors that are null, of zeros, or hold a null or non-finite entry are not in the index, and as queries find
nothing; null ids neither; a shorter vector counts as filled with zeros; of equal vectors the `copies` smallest ids are kept;
equal scores go by id; repeated queries are asked once; an empty table gives an empty index.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _dump(**arrays: np.ndarray) -> bytes:
    np.savez(held := io.BytesIO(), **arrays)
    return held.getvalue()


def _load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as x:
        return dict(x)


def _rows(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(width, len(v))] = v[:width]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked(x: np.ndarray, m: int, ef: int) -> np.ndarray:
    """Links (-1: none) of a layer: up to m chosen of the ef nearest of each node, and links back up to 2 m."""
    n = len(x)
    links = np.full((n, 2 * m), -1, np.int32)
    used = np.zeros(n, np.int32)
    forward = np.full((n, m), -1, np.int32)
    ef = min(ef, n - 1)
    for a in range(0, n, 256) if ef > 0 else ():
        s = x[a : a + 256] @ x.T
        at = np.arange(len(s))
        s[at, a + at] = -np.inf
        near = np.argpartition(-s, ef - 1, axis=1)[:, :ef]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        score = np.take_along_axis(s, near, 1)
        between = np.matmul(x[near], x[near].transpose(0, 2, 1))
        free, chosen = np.ones(near.shape, bool), np.zeros(near.shape, bool)
        for k in range(m):
            # What a chosen one covers comes in only where nothing else is left.
            pick = np.where(free.any(axis=1), free.argmax(axis=1), (~chosen).argmax(axis=1))
            some = ~chosen[at, pick]
            forward[a + at[some], k] = near[at, pick][some]
            chosen[at, pick] = True
            free &= ~chosen & (between[at, pick] <= score)
    for k in range(m):  # nearest first, so that these have their place before links back take it
        some = forward[:, k] >= 0
        links[some, used[some]] = forward[some, k]
        used[some] += 1
    for k in range(m):
        for node in np.flatnonzero(forward[:, k] >= 0):
            to = forward[node, k]
            if used[to] < 2 * m and node not in links[to, : used[to]]:
                links[to, used[to]] = node
                used[to] += 1
    return links


def layers(x: np.ndarray, draw: np.ndarray, m: int, ef: int) -> dict[str, np.ndarray]:
    """The layers of a cell: nodes{l} are the members of layer l, links{l} by their place in it. draw: uniform in (0, 1)."""
    level = np.floor(-np.log(draw) / np.log(m)).astype(int)
    out, depth = {}, 0
    while True:
        nodes = np.flatnonzero(level >= depth)
        if depth and len(nodes) < 2:
            break
        out[f"nodes{depth}"], out[f"links{depth}"] = nodes.astype(np.int32), linked(x[nodes], m, ef)
        depth += 1
    return out | {"depth": np.array(depth)}


def beam(x: np.ndarray, links: np.ndarray, start: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
    """For each query the nodes that a beam of this width ends with, best first (-1: none). start: a node for each."""
    n = len(q)
    ids, scores = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf)
    ids[:, 0], scores[:, 0] = start, np.einsum("ad,ad->a", q, x[start])
    seen, done = np.zeros((n, len(x)), bool), np.zeros((n, width), bool)
    seen[np.arange(n), start] = True
    while (todo := (~done & (ids >= 0))).any():
        rows = np.flatnonzero(todo.any(axis=1))
        place = todo[rows].argmax(axis=1)
        done[rows, place] = True
        near = links[ids[rows, place]]
        new = (near >= 0) & ~seen[rows[:, None], near]
        seen[rows[:, None], near] |= new
        s = np.where(new, np.einsum("ard,ad->ar", x[near], q[rows]), -np.inf)
        s, near, was = np.hstack([scores[rows], s]), np.hstack([ids[rows], np.where(new, near, -1)]), np.hstack([done[rows], np.zeros(new.shape, bool)])
        order = np.argsort(-s, axis=1, kind="stable")[:, :width]
        scores[rows], ids[rows], done[rows] = (np.take_along_axis(v, order, 1) for v in (s, near, was))
    return ids


def walked(graph: dict[str, np.ndarray], q: np.ndarray, width: int) -> np.ndarray:
    """Nodes found by the queries from the top layer down."""
    x = graph["unit"]
    depth = int(graph["depth"])
    start = np.zeros(len(q), np.int64)  # a place in the top layer
    for layer in reversed(range(depth)):
        nodes = graph[f"nodes{layer}"]
        found = beam(x[nodes], graph[f"links{layer}"], start, q, width if layer == 0 else 1)
        if layer:
            start = np.searchsorted(graph[f"nodes{layer - 1}"], nodes[found[:, 0]])
    return found


def swept(graph: dict[str, np.ndarray], q: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of all nodes that score as high as the kth of those found by a query's row, or higher."""
    unit, rows, nodes = _unit(graph["v"]), [], []
    for a in range(0, len(q), 256):  # bounded memory
        s, near = q[a : a + 256] @ unit.T, found[a : a + 256]
        known = np.where(near >= 0, np.take_along_axis(s, np.maximum(near, 0), 1), -np.inf)
        least = np.sort(known, axis=1)[:, -k] - 1e-12 * np.sqrt((q[a : a + 256] ** 2).sum(axis=1))
        row, node = np.nonzero(s >= least[:, None])
        rows.append(a + row)
        nodes.append(node)
    return np.concatenate(rows), np.concatenate(nodes)


def _sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    sound = F.col(key).isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda c: c != 0)
    return df.where(sound).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def write(df: DataFrame, path: str, doc_id: str = "doc_id", embedding: str = "embedding", cell: int = 2048, most: int = 8192, pivots: int = 1024, m: int = 16, ef: int = 200, copies: int = 101) -> None:
    """Write the index of the vectors of df: a graph a cell, and the pivots. About `cell` vectors go to a cell."""
    spark = df.sparkSession
    rank = F.row_number().over(W.partitionBy("v").orderBy("id"))
    few = _sound(df, doc_id, embedding).withColumn("_rank", rank).where(F.col("_rank") <= copies)
    few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64("v")).write.mode("overwrite").parquet(f"{path}/vectors")
    rows = spark.read.parquet(f"{path}/vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    wanted = max(1, min(pivots, -(-n // cell)))
    # A threshold on the hash lets few more than are wanted reach the ordering, and far more than none.
    share = (2 * wanted + 64) / max(1, n)
    near_front = rows.where(F.col("h") < int(-(2**63) + share * 2**64)) if share < 0.5 else rows
    marks = _unit(_rows([r["v"] for r in near_front.orderBy("h", "v").limit(wanted).collect()], width)) if n else np.zeros((0, 0))
    spark.createDataFrame([(i, v.tolist(), width) for i, v in enumerate(marks)], "pivot int, v array<double>, width int").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(pivot=(_unit(_rows(b["v"], width)) @ marks.T).argmax(axis=1)) if len(b) else b.assign(pivot=0)

    placed = rows.mapInPandas(near, "v array<double>, ids array<long>, h long, pivot int") if n else rows.withColumn("pivot", F.lit(0))
    # A number for each pivot; what is near one is cut into parts of at most about `most` vectors.
    sizes = dict(placed.groupBy("pivot").count().collect())
    parts = F.array(*[F.lit(-(-sizes.get(p, 0) // most) or 1) for p in range(wanted)])
    placed = placed.withColumn("part", F.pmod("h", F.get(parts, F.col("pivot"))).cast("int"))

    def plant(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending")])
        v = _rows(t.column("v").to_pylist(), width)
        ids = t.column("ids").combine_chunks()
        draw = (t.column("h").to_numpy().astype(np.float64) % 999_983 + 0.5) / 999_983
        unit = _unit(v).astype(np.float32)
        blob = _dump(v=v, unit=unit, ids=ids.flatten().to_numpy(), starts=ids.offsets.to_numpy(), **layers(unit, draw, m, ef))
        return pa.table({"pivot": pa.array([t.column("pivot")[0].as_py()], pa.int32()), "part": pa.array([t.column("part")[0].as_py()], pa.int32()), "graph": pa.array([blob], pa.binary())})

    placed.groupBy("pivot", "part").applyInArrow(plant, "pivot int, part int, graph binary").write.mode("overwrite").parquet(f"{path}/cells")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, query_id: str = "query_id", embedding: str = "embedding", probe: int | None = None, width: int = 128, per_task: int = 2048, exact: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank from 1): the k most similar documents found for each query, among them one of the same id.

    With `exact`, what a graph finds is a bound: every vector of its cell that reaches it is looked for as well, so that with all
    cells asked nothing is missed. That is all queries against all vectors, in groups of a cell and `per_task` queries.
    """
    marks = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()  # at most `pivots`
    if not marks:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    size, pivots = marks[0]["width"], np.array([r["v"] for r in marks])
    asked = _sound(queries, query_id, embedding).distinct()
    schema = "id long, v array<double>, pivot int"

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q = _rows(b["v"], size)
            order = np.argsort(-(q @ pivots.T), axis=1, kind="stable")[:, : probe or len(pivots)]
            yield b.loc[b.index.repeat(order.shape[1])].assign(pivot=order.reshape(-1).astype(np.int32))

    cells = spark.read.parquet(f"{path}/cells")
    going = asked.mapInPandas(route, schema)
    total = asked.count()
    # A cell that all queries go to is several groups, each of which reads its graph.
    salts = max(1, -(-total // per_task))
    going = going.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    held = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def look(q: pa.Table, c: pa.Table) -> pa.Table:
        out = {"query_id": [], "doc_id": [], "score": []}
        for blob in c.column("graph").to_pylist() if q.num_rows else ():
            g = _load(blob)
            ids, v = q.column("id").to_numpy(), _rows(q.column("v").to_pylist(), g["v"].shape[1])
            length = np.sqrt(np.array([np.dot(x, x) for x in q.column("v").to_pylist()]))
            found = walked(g, v.astype(np.float32), max(width, k))
            row, place = np.nonzero(found >= 0)
            node = found[row, place]
            if exact:
                row, node = swept(g, v, found, k)
            s = np.einsum("ad,ad->a", v[row], g["v"][node]) / (length[row] * np.sqrt((g["v"][node] ** 2).sum(axis=1)))
            counts = g["starts"][node + 1] - g["starts"][node]
            at = np.repeat(g["starts"][node] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            row, s, doc = np.repeat(row, counts), np.repeat(s, counts), g["ids"][at - g["starts"][0]]
            order = np.lexsort((doc, -s, row))
            row, s, doc = row[order], s[order], doc[order]
            few = np.arange(len(row)) - np.searchsorted(row, row) < k
            for name, values in (("query_id", ids[row]), ("doc_id", doc), ("score", s)):
                out[name].append(values[few])
        empty = {"query_id": np.int64, "doc_id": np.int64, "score": np.float64}
        return pa.table({c: pa.array(np.concatenate([np.zeros(0, empty[c]), *v])) for c, v in out.items()})

    found = going.groupBy("pivot", "salt").cogroup(held.groupBy("pivot", "salt")).applyInArrow(look, "query_id long, doc_id long, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)
