"""Conversation prefix trie by Patricia construction.

A conversation is the sequence of its turns; a turn counts as a 16-byte digest of role and text, so a sequence is one
binary value, and its order is that of the digests.

1. Sequences are gathered (one row a conversation, 24 bytes a turn), equal ones counted once, and sorted by ranges.
2. A range, with the common prefixes of its neighbours, creates only the points at which paths branch or a conversation
   ends, leaves among them, with the bytes along the edge above each. Of each range the driver knows the first and the last
   sequence and at which depths others part from them, so a range knows all points on its paths, also those that exist
   through other ranges only.
3. Aggregates of points are sums over the sequences below them, so those of several ranges add up: members, leaves, bytes of
   all members, and bytes of distinct nodes (what a sequence has beyond the prefix that it shares with the one before it).
4. Points are expanded to nodes: a node inside an edge has the point's members, and its tokens are the point's and a
   suffix sum over the edge.

Defined cases: a null role or text counts as empty; turns go by their number, null first, equal ones by their digest, so
repeated rows are turns each; rows with a null conversation take no part; conversations that `ids` names beside those of
`turns` are turnless members of the root; very long texts count whole, by digest and length; other columns are ignored;
an empty table gives an empty one, without a root. A conversation is one row while it is sorted, however many turns it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import store

WIDTH = 16
POINT = "depth long, key binary, above binary, n long, conv long, leaves long, told long, fresh long, before long, edge array<long>"
TURNS = "array<struct<turn:long,d:string,n:long>>"


def gathered(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): the turns of each conversation in order, as digests and numbers of UTF-8 bytes."""
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary"))
    rows = df.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.struct(F.col(turn).cast("long").alias("turn"), digest.alias("d"), F.octet_length(said).cast("long").alias("n")).alias("t"))
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).cast(TURNS).alias("turns"))


def with_heads(convs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversations of `gathered` rebuilt: the first h turns of the conversation that a group of ids begins with, then the
    own ones after the first h; h is the crc32 of the id modulo `most`."""
    convs = store(convs)
    heads = convs.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    rows = convs.withColumn("base", F.col("conv") - F.col("conv") % group).withColumn("h", h).join(heads, "base", "left")
    head = F.coalesce(F.expr("slice(head, 1, h)"), F.array().cast(TURNS))
    return rows.select("conv", F.concat(head, F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """Number of turns that two sequences begin with in common."""
    n = min(len(a), len(b)) // WIDTH * WIDTH
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax()) // WIDTH


def minima(values: list[int]) -> list[int]:
    """Distinct running minima."""
    out: list[int] = []
    for v in values:
        if not out or v < out[-1]:
            out.append(v)
    return out


def outlook(borders: list[tuple[bytes, bytes, list[int], list[int]]]) -> tuple[list[list[int]], list[list[int]]]:
    """For each range the depths at which sequences before it part from its first one, and those behind it from its last.

    borders: of each range the first and the last sequence, and the running minima of what neighbours share inside it,
    from the first on and from the last back.
    """
    left, right = [[] for _ in borders], [[] for _ in borders]
    between = [common(x[1], y[0]) for x, y in zip(borders, borders[1:])]
    for i in range(1, len(borders)):
        left[i] = minima([between[i - 1], *borders[i - 1][3], *left[i - 1]])
    for i in reversed(range(len(borders) - 1)):
        right[i] = minima([between[i], *borders[i + 1][2], *right[i + 1]])
    return left, right


def border(seqs: list[bytes]) -> tuple[bytes, bytes, list[int], list[int]]:
    shared = list(map(common, seqs, seqs[1:]))
    return seqs[0], seqs[-1], minima(shared), minima(shared[::-1])


class _Point:
    """A point on the path of the sequence being read, and the sums of what was read below it."""

    __slots__ = ("depth", "seq", "sums", "first", "key", "n", "conv", "leaves", "told", "fresh")

    def __init__(self, depth: int, seq: bytes, sums: np.ndarray, first: int | None) -> None:
        # first: prefix that the first sequence below shares with the one before it; None where that one is in a range before.
        self.depth, self.seq, self.sums, self.first = depth, seq, sums, first
        self.key = hashlib.md5(seq[: depth * WIDTH]).digest()
        self.n = self.leaves = self.told = self.fresh = 0
        self.conv: int | None = None

    def add(self, n: int, conv: int | None, leaves: int, told: int, fresh: int) -> None:
        self.n, self.leaves, self.told, self.fresh = self.n + n, self.leaves + leaves, self.told + told, self.fresh + fresh
        self.conv = conv if self.conv is None else self.conv if conv is None else min(self.conv, conv)

    def row(self, above: _Point | None) -> tuple:
        bytes_to = lambda depth: int(self.sums[depth]) if depth > 0 else 0
        before, edge, fresh = bytes_to(self.depth - 1), None, self.fresh
        if self.first is not None:  # the range in which the point begins tells of its edge and top
            fresh -= before - bytes_to(self.first)
            top = above.depth + 1 if above else 0
            edge = [before - bytes_to(d - 1) for d in range(top, self.depth + 1)]
        return self.depth, self.key, above.key if above else None, self.n, self.conv, self.leaves, self.told, fresh, before, edge


def points(seqs: list[bytes], sums: list[np.ndarray], n: list[int], conv: list[int], left: list[int], right: list[int]) -> list[tuple]:
    """Points of a range of sorted distinct sequences.

    sums: bytes of the first d turns, from d = 0. left, right: as `outlook` gives them, deepest first; empty where nothing
    is before or behind the range.
    """
    out: list[tuple] = []
    root = lambda depths: depths if depths and depths[-1] == 0 else [*depths, 0]
    stack = [_Point(d, seqs[0], sums[0], None) for d in reversed(root(left))] if left else []

    def down_to(depth: int) -> None:
        """Close what is deeper; then a point of this depth is on top."""
        last = None
        while stack and stack[-1].depth > depth:
            last = stack.pop()
            if not stack or stack[-1].depth < depth:
                stack.append(_Point(depth, last.seq, last.sums, last.first))
            out.append(last.row(stack[-1]))
            stack[-1].add(last.n, last.conv, last.leaves, last.told, last.fresh)

    shared = [left[0] if left else -1, *map(common, seqs, seqs[1:]), right[0] if right else -1]
    for i, s in enumerate(seqs):
        if i:
            down_to(shared[i])
        length, told = len(s) // WIDTH, int(sums[i][-1])
        stack.append(_Point(length, s, sums[i], shared[i]))
        stack[-1].add(n[i], conv[i], int(shared[i + 1] < length), n[i] * told, told - (int(sums[i][shared[i]]) if shared[i] > 0 else 0))
    for d in root(right):
        down_to(d)
    out.append(stack[0].row(None))
    return out


def ends(members: DataFrame) -> DataFrame:
    """(key, ends): hash of the comma-joined ids of each group of (key, conv), in ascending order.

    Ids go in blocks of a numeric range, which are joined by themselves; a task reads the blocks of a group one after
    another and holds one batch of them.
    """
    block = F.floor(F.col("conv") / F.lit(65536)).alias("block")
    blocks = members.groupBy("key", block).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            keys, found = [], []
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
                if k != key:
                    if state:
                        keys.append(key)
                        found.append(state.hexdigest())
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends": pa.array(found, pa.string())})
        if state:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": pa.array([state.hexdigest()], pa.string())})

    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(digest, "key binary, ends string")


def trie(convs: DataFrame, per_range: int = 32768) -> DataFrame:
    """Nodes of the trie of conversations (conv, turns) as `gathered` gives them.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = convs.sparkSession
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t["d"]), "")).alias("seq")
    convs = store(convs.select("conv", seq, F.transform("turns", lambda t: t["n"]).alias("lens")))
    distinct = convs.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv").alias("c"), F.first("lens").alias("lens"))
    ranges = max(spark.sparkContext.defaultParallelism, -(-convs.count() // per_range))
    rows = store(distinct.repartitionByRange(ranges, "seq").withColumn("part", F.spark_partition_id()))

    def outer(b: pd.DataFrame) -> pd.DataFrame:
        first, last, ahead, back = border([bytes(x) for x in b["seq"].sort_values()])
        return pd.DataFrame({"part": b["part"].iloc[:1], "first": [first], "last": [last], "ahead": [ahead], "back": [back]})

    # For each range two sequences and the depths at which paths part from them.
    borders = rows.select("part", "seq").groupBy("part").applyInPandas(outer, "part int, first binary, last binary, ahead array<int>, back array<int>").orderBy("part").collect()
    left, right = outlook([(bytes(r["first"]), bytes(r["last"]), r["ahead"], r["back"]) for r in borders])
    around = {r["part"]: (x, y) for r, x, y in zip(borders, left, right)}

    def plant(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("seq", kind="stable")
        sums = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in b["lens"]]
        found = points([bytes(x) for x in b["seq"]], sums, b["n"].tolist(), b["c"].tolist(), *around[b["part"].iloc[0]])
        return pd.DataFrame(found, columns=[c.split()[0] for c in POINT.split(", ")]).astype({"conv": "Int64"})

    local = rows.groupBy("part").applyInPandas(plant, POINT)
    of_all = local.groupBy("depth", "key").agg(
        F.max("above").alias("above"), F.max("edge").alias("edge"), F.min("conv").alias("conv"), F.max("before").alias("before"),
        *[F.sum(c).cast("long").alias(c) for c in ("n", "leaves", "told", "fresh")],
    )
    tree = store(of_all.withColumn("saved", F.col("told") - F.col("n") * F.col("before") - F.col("fresh")))
    children = tree.where("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("children"))
    last = ends(convs.select(F.unhex(F.md5("seq")).alias("key"), "conv"))
    tops = store(tree.select("key", "conv").join(children, "key", "left").join(last, "key", "left"))
    own = tops.select("key", F.coalesce("children", F.lit(0)).alias("children"), "ends")
    full = tree.join(own, "key").join(tops.select(F.col("key").alias("above"), F.col("conv").alias("above_conv")).hint("merge"), "above", "left")
    nodes = full.select("*", F.posexplode("edge").alias("at", "after"))
    at_point = F.col("at") == F.size("edge") - 1
    here = lambda point, inside: F.when(at_point, point).otherwise(inside)
    out: dict[str, Column] = {
        "conv_id": F.col("conv"),
        "depth": F.col("depth") - F.size("edge") + 1 + F.col("at"),
        "parent_conv_id": F.when(F.col("at") == 0, F.col("above_conv")).otherwise(F.col("conv")),
        "n_convs": F.col("n"),
        "n_children": here(F.col("children"), F.lit(1)),
        "n_leaves": F.col("leaves"),
        "saved_tokens": F.col("saved") + (F.col("n") - 1) * F.col("after"),
    }
    none = hashlib.sha256(b"").hexdigest()
    return nodes.select(*[v.cast("long").alias(k) for k, v in out.items()], here(F.coalesce("ends", F.lit(none)), F.lit(none)).alias("ends_sha256"))


def sql() -> str:
    """The same rows from DuckDB, without compression: every prefix of every conversation, and all its ancestors."""
    crc = """(4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i::INT + 1, 1))::BIGINT)),
        lambda a, x: list_reduce(list_concat([xor(a, x)], range(0, 8)), lambda r, j: xor(r // 2, 3988292384 * (r % 2)))))"""
    return f"""
    WITH t AS (
        SELECT conv_id, d, nb, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos FROM (
            SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS nb FROM conversations)
        WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, {crc} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (
        SELECT c.conv_id, 0 AS part, pos, d, nb FROM c JOIN t ON t.conv_id = c.base AND pos <= h
        UNION ALL SELECT c.conv_id, 1, pos, d, nb FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
    s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, d, nb FROM r),
    p AS (
        SELECT conv_id, depth, nb, md5(string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM s
        UNION ALL SELECT conv_id, 0, 0, md5('') FROM c),
    n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n, any_value(nb) AS nb FROM p GROUP BY depth, key),
    up AS (SELECT n.depth, n.key, m.key AS above, m.conv_id AS above_conv FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN n m ON m.key = p.key AND m.depth = p.depth),
    kids AS (SELECT above AS key, count(*) AS n_children FROM up GROUP BY above),
    sums AS (
        SELECT a.depth, a.key, sum((n.n - 1) * n.nb) AS saved, count(*) FILTER (WHERE kids.key IS NULL) AS leaves
        FROM n JOIN p a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN kids ON kids.key = n.key GROUP BY a.depth, a.key),
    last AS (SELECT arg_max(key, depth) AS key, conv_id FROM p GROUP BY conv_id),
    ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM last GROUP BY key)
    SELECT n.conv_id, n.depth::BIGINT AS depth, up.above_conv AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
        saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM n JOIN sums USING (depth, key) LEFT JOIN up USING (depth, key) LEFT JOIN kids ON kids.key = n.key LEFT JOIN ends ON ends.key = n.key"""
