"""Conflict-constrained best-fit packing of documents into bins of `capacity` words.

A document longer than a bin fills whole bins of its own with its first pieces; its last piece is an item like any
other. Two items conflict when they come from one source or from one cluster of duplicates. Items are dealt to shards
by a hash; each shard sorts its items by falling size and keeps its open bins ordered by residual. A bin carries two
bitmaps, of the sources and of the duplicate clusters it holds. The search starts at the smallest residual that fits
and goes on to the next until a bin without a conflict is found: the tightest compatible one. Else a bin is opened.

A shard holds about `per_shard` documents whatever the input's size: repeated rows are counted and numbered (`copy`), and
the number is part of the hash, so neither a hot source, a large cluster nor a frequent id makes a large group.

A cluster is a column of the caller's, such as the components of near-duplicates (`items_in_components`), or else the
texts with the same words in lower case.

Defined cases: a null or blank text has size 0 and one row without a bin; a null source or cluster conflicts with
nothing; a text of any length is cut into pieces; ties go by id (nulls first), then cluster, source and copy; repeated
rows are items of one cluster, so they never share a bin; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import cut, words


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin of each item, for items in falling order of size; sources and clusters are numbers, or -1 for none."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[tuple[int, int]] = []  # bitmaps of sources and of clusters by bin
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(order, (size, -1))
        while at < len(order) and (held[order[at][1]][0] & s or held[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
            held[b] = (held[b][0] | s, held[b][1] | c)
        else:
            residual, b = capacity, len(held)
            held.append((s, c))
        if residual > size:
            insort(order, (residual - size, b))
        out.append(b)
    return out


def items(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", cluster: str | None = None) -> DataFrame:
    """(id, t, source, cluster, size), a light row for each row of df; t is a hash of the text."""
    w = words(F.col(text))
    same = F.xxhash64(F.lower(F.array_join(w, " "))) if cluster is None else F.col(cluster)
    return df.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("t"), F.col(source).cast("string").alias("source"), same.alias("cluster"), F.size(w).cast("long").alias("size"))


def items_in_components(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Items whose cluster is the `root` of their near-duplicates, from (id, t, root) of each document."""
    known = found.groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.min("root").alias("root"))
    joined = rows.join(known, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    return joined.select("id", "t", "source", F.coalesce("root", "cluster").alias("cluster"), "size")


def pack(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", cluster: str | None = None, capacity: int = 2048, per_shard: int = 4096) -> DataFrame:
    """(doc_id, copy, piece, start, size, shard, bin, offset): where each piece of each document goes.

    copy numbers repeated rows from 0, start is the piece's first word in its document, offset its place in the bin.
    """
    return pack_items(items(df, doc_id, source, text, cluster), capacity, per_shard)


def pack_items(rows: DataFrame, capacity: int = 2048, per_shard: int = 4096) -> DataFrame:
    """`pack` for items (id, t, source, cluster, size)."""
    kind = rows.schema["id"].dataType.simpleString()
    rows = cut(rows.groupBy("id", "t", "source", "cluster", "size").agg(F.count("*").alias("n")))
    shards = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // per_shard))
    # In two steps, so that no array is long.
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"), F.lit(1024).cast("long"))))
    rows = rows.withColumn("copy", F.explode(F.sequence("block", F.least(F.col("block") + 1023, F.col("n") - 1)))).drop("block", "n")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "source", "cluster", "copy"), F.lit(shards)))
    none = [F.lit(0).cast("long").alias(c) for c in ("piece", "start", "size")] + [F.lit(None).cast("long").alias(c) for c in ("shard", "bin", "offset")]
    empty = rows.where("size = 0").select(F.col("id").alias("doc_id"), "copy", *none)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["id", "cluster", "source", "copy", "t"], na_position="first", kind="stable").reset_index(drop=True)
        full, last = np.divmod(b["size"].to_numpy(), capacity)
        number = lambda x: pd.factorize(x)[0].astype(np.int64)
        order = np.argsort(-last, kind="stable")
        order = order[last[order] > 0]
        src, dup = number(b["source"])[order], number(b["cluster"])[order]
        bins = np.array(best_fit(last[order].tolist(), src.tolist(), dup.tolist(), capacity), np.int64)
        # Full pieces have bins of their own, numbered after the shared ones.
        of = np.repeat(np.arange(len(b)), full)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full)
        own = np.arange(len(of)) + (bins.max() + 1 if len(bins) else 0)
        t = pd.DataFrame({"at": np.concatenate([order, of]), "piece": np.concatenate([full[order], piece]), "size": np.concatenate([last[order], np.full(len(of), capacity)]), "bin": np.concatenate([bins, own])})
        t["offset"] = t.groupby("bin")["size"].cumsum() - t["size"]
        of_row = b.iloc[t["at"].to_numpy()].reset_index(drop=True)
        return pd.DataFrame({"doc_id": of_row["id"], "copy": of_row["copy"], "piece": t["piece"], "start": t["piece"] * capacity, "size": t["size"], "shard": of_row["shard"], "bin": t["bin"], "offset": t["offset"]})

    packed = rows.where("size > 0").groupBy("shard").applyInPandas(run, f"doc_id {kind}, copy long, piece long, start long, size long, shard long, bin long, offset long")
    return packed.unionByName(empty)
