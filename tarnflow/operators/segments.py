"""An inverted index that grows by batches: immutable segments, tombstones, merges by size.

An insert writes one segment from its own rows alone: a forward table (the terms of each document and their counts), postings
sorted by term, and its part of the statistics (documents, total length, document frequency of each term). Neither texts nor
postings are shuffled: texts are counted where they are read, but for those of an id that comes more than once, and postings
are read off the forward table and sorted in blocks of documents, so that a document's postings stand in one file. A delete
writes a segment too: the ids that leave, and negative statistics, which it takes from the forward rows of those documents.
Statistics of the whole are sums over segments, so scores are those of an index built anew. Rows keep the number of the insert
they came with; a tombstone holds for rows of inserts before it.

Segments of like size are merged once there are `fan` of them, and at once with those that the result would be merged with
next, so that no row is written for a merge between: deleted rows go for good, and a tombstone leaves when no segment older
than it is left outside. A version of the index is a manifest, written last and never changed: what fails before
it is not part of the index, readers of an older version go on, and a second writer of one version gets an error.

Defined cases: ids are the caller's, and null ones are left out; an id that is inserted twice, in one batch or in two, names one
document of both texts for scores, and two for statistics if they came in two batches; null and blank texts are documents
without a token; deletes of unknown ids change nothing; a deleted id may be inserted again; an empty insert or delete makes no
version; merges don't change scores.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import tokens
from tarnflow.functions.text import query_terms
from tarnflow.operators.retrieve import _part

MANIFEST = "name string, kind string, first long, n long, total long, width long"
POSTINGS = "term string, doc_id long, tf long, at long"
FORWARD = "doc_id long, doc_len long, terms array<string>, tf array<long>, at long"
COUNTS = "term string, df long"
GONE = "doc_id long, before long"
#: How tables are written: ids that rise and terms in order take few bits as differences.
COMPACT = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#term": "false"}
#: Ids that are broadcast; a join with more is sorted and merged.
IDS = 1 << 20


def _ids(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= IDS else df.hint("merge")


@dataclass(frozen=True)
class Segment:
    """A part of the index: rows of inserts from `first` on, or (kind gone) the tombstones of one delete."""

    name: str
    kind: str
    first: int
    n: int
    total: int
    width: int


class SegmentedIndex:
    """The index at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, fan: int = 4) -> None:
        self.spark, self.path, self.fan = spark, path, fan

    @classmethod
    def create(cls, spark: SparkSession, path: str, fan: int = 4) -> SegmentedIndex:
        made = cls(spark, path, fan)
        made._commit(0, [])
        return made

    def _versions(self) -> DataFrame:
        return self.spark.read.schema(f"{MANIFEST}, version long").parquet(f"{self.path}/manifest")

    def state(self) -> tuple[int, list[Segment]]:
        """The latest version and its segments: a row for each segment."""
        rows = self._versions()
        version = rows.agg(F.max("version")).first()[0]
        parts = rows.where((F.col("version") == version) & (F.col("kind") != "start")).drop("version").orderBy("first", "name").collect()
        return version, [Segment(**r.asDict()) for r in parts]

    def _commit(self, version: int, parts: list[Segment]) -> None:
        # A row of its own makes an index without segments a version, too.
        rows = [("", "start", 0, 0, 0, 0), *[(s.name, s.kind, s.first, s.n, s.total, s.width) for s in parts]]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version}")

    def _read(self, parts: list[Segment], table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{s.name}/{table}" for s in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _alive(self, rows: DataFrame, parts: list[Segment]) -> DataFrame:
        """rows without those of documents that were deleted after they came."""
        gone = [s for s in parts if s.kind == "gone"]
        if not gone:
            return rows
        last = self._read(gone, "gone", GONE).groupBy("doc_id").agg(F.max("before").alias("before"))
        return rows.join(_ids(last, -sum(s.n for s in gone)), "doc_id", "left").where("before IS NULL OR at > before").drop("before")

    def _write(self, name: str, forward: DataFrame, postings: DataFrame | None = None) -> DataFrame:
        """Write the forward table and its postings, read off it where they aren't given; the postings."""
        to = f"{self.path}/{name}"
        forward.write.options(**COMPACT).parquet(f"{to}/forward")
        if postings is None:
            postings = tokens.by_term(self.spark.read.schema(FORWARD).parquet(f"{to}/forward"))
        postings.write.options(**COMPACT).parquet(f"{to}/postings")
        return self.spark.read.schema(POSTINGS).parquet(f"{to}/postings")

    def _write_counts(self, name: str, counts: DataFrame) -> None:
        counts.sortWithinPartitions("term").write.options(**COMPACT).parquet(f"{self.path}/{name}/counts")

    @staticmethod
    def _texts(docs: DataFrame) -> DataFrame:
        """(key, texts): the lower-case texts of each id. Only texts of ids that come more than once are shuffled."""
        rows = docs.select(F.col("doc_id").alias("key"), tokens.low(F.col("content")).alias("text"))
        again = docs.groupBy(F.col("doc_id").alias("key")).count().where("count > 1").select("key")
        n = again.count()
        if n > IDS:
            return rows.groupBy("key").agg(F.collect_list("text").alias("texts"))
        alone = (rows.join(F.broadcast(again), "key", "left_anti") if n else rows).select("key", F.array("text").alias("texts"))
        if not n:
            return alone
        return alone.union(rows.join(F.broadcast(again), "key", "left_semi").groupBy("key").agg(F.collect_list("text").alias("texts")))

    def insert(self, docs: DataFrame) -> int:
        """Add documents (doc_id, content); the number of documents added."""
        version, parts = self.state()
        docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "content")
        name, at = f"segment-{uuid.uuid4().hex}", version + 1
        came = F.lit(at).cast("long").alias("at")
        found = tokens.counted(self._texts(docs).sortWithinPartitions("key"), ordered=True)
        written = self._write(name, found.select(F.col("key").alias("doc_id"), "doc_len", F.col("postings.term").alias("terms"), F.col("postings.tf").alias("tf"), came))
        self._write_counts(name, written.groupBy("term").agg(F.count("*").alias("df")))
        n, total = self._read([Segment(name, "rows", at, 0, 0, 0)], "forward", FORWARD).agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
        if n:
            self._commit(at, [*parts, Segment(name, "rows", at, n, total, written.count())])
        return n

    def delete(self, ids: DataFrame) -> int:
        """Take out the documents of ids (doc_id); the number of documents that were there."""
        version, parts = self.state()
        name, before = f"segment-{uuid.uuid4().hex}", version + 1
        to = f"{self.path}/{name}"
        wanted = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        there = self._alive(self._read(self._rows(parts), "forward", FORWARD).join(_ids(wanted, wanted.count()), "doc_id", "left_semi"), parts)
        n, total = there.agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
        if n:
            there.select("doc_id", F.lit(before).cast("long").alias("before")).distinct().write.options(**COMPACT).parquet(f"{to}/gone")
            self._write_counts(name, there.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df")))
            self._commit(before, [*parts, Segment(name, "gone", before, -n, -total, 0)])
        return n

    @staticmethod
    def _rows(parts: list[Segment]) -> list[Segment]:
        return [s for s in parts if s.kind == "rows"]

    def merge(self, every: bool = False) -> int:
        """Merge `fan` segments of like size (within the factor `fan`) while there are, or all into one; the number of merges."""
        done = 0
        while True:
            version, parts = self.state()
            rows = self._rows(parts)
            full = self._full(rows)
            if every:
                full = rows if len(rows) > 1 else None
            if full is None and every and not done and any(s.kind == "gone" for s in parts) and rows:
                full = rows
            if full is None:
                return done
            self._merge(version + 1, parts, full)
            done += 1

    def _full(self, rows: list[Segment]) -> list[Segment] | None:
        """Segments to merge into one: `fan` of like size, and those that would be merged with the result (its width taken as the sum)."""
        groups, merged = [(s.width, s.name, [s]) for s in rows], None
        while True:
            groups.sort(key=lambda g: g[:2])
            runs = [groups[i : i + self.fan] for i in range(len(groups) - self.fan + 1)]
            full = next((r for r in runs if r[-1][0] <= self.fan * max(1, r[0][0]) and (merged is None or merged in r)), None)
            if full is None:
                return merged and merged[2]
            merged = (sum(g[0] for g in full), "", [s for g in full for s in g[2]])
            groups = [*[g for g in groups if g not in full], merged]

    def _merge(self, version: int, parts: list[Segment], chosen: list[Segment]) -> None:
        others = [s for s in self._rows(parts) if s not in chosen]
        settled = [s for s in parts if s.kind == "gone" and all(x.first > s.first for x in others)]
        summed = [*chosen, *settled]
        name = f"segment-{uuid.uuid4().hex}"
        forward, postings = self._read(chosen, "forward", FORWARD), self._read(chosen, "postings", POSTINGS)
        # Large blocks are sorted enough as they are; small ones are sorted into larger ones.
        sorted_enough = sum(s.width for s in chosen) >= tokens.BLOCK // 2 * len(postings.inputFiles())
        written = self._write(name, self._alive(forward, parts), self._alive(postings, parts) if sorted_enough else None)
        self._write_counts(name, self._read(summed, "counts", COUNTS).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"))
        merged = Segment(name, "rows", min(s.first for s in chosen), sum(s.n for s in summed), sum(s.total for s in summed), written.count())
        self._commit(version, [merged, *[s for s in parts if s not in summed]])

    def documents(self) -> DataFrame:
        """(doc_id, doc_len) of the documents that are there."""
        _, parts = self.state()
        return self._alive(self._read(self._rows(parts), "forward", FORWARD), parts).select("doc_id", "doc_len")

    def scores(self, query: str) -> DataFrame:
        """(doc_id, score) of the documents above 0: only postings and counts of the query's terms are read, and the documents' lengths."""
        _, parts = self.state()
        terms = query_terms(query)
        n, total = sum(s.n for s in parts), sum(s.total for s in parts)
        if not terms or n == 0:
            return self.spark.createDataFrame([], "doc_id long, score double")
        wanted = self._alive(self._read(self._rows(parts), "postings", POSTINGS).where(F.col("term").isin(*terms)), parts)
        df = self._read(parts, "counts", COUNTS).where(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("df").alias("df"))  # a row a term
        weight = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])
        # A document's postings stand in one file, so that they are brought together before any row is shuffled.
        rows = wanted.join(F.broadcast(df), "term").groupBy("doc_id", "at").agg(F.collect_list(F.struct(weight[F.col("term")].alias("times"), "df", "tf")).alias("found"))
        lengths = self._read(self._rows(parts), "forward", FORWARD).select("doc_id", "at", "doc_len")
        part = lambda x: x["times"] * _part(x["tf"], x["df"], F.lit(n), F.col("doc_len"), F.lit(total / n))
        scored = rows.join(lengths, ["doc_id", "at"]).select("doc_id", F.aggregate("found", F.lit(0.0), lambda a, x: a + part(x)).alias("score"))
        return scored.groupBy("doc_id").agg(F.sum("score").alias("score"))
