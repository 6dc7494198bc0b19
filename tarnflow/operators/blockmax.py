"""Ranked search for a table of queries over a stored index with block bounds.

Documents are dealt to blocks of a fixed number; each term has, for every block, its postings with their impact (the part of
the score that doesn't depend on the query) and the highest impact. For a query the sum of weight * highest impact over its
terms bounds the scores of a block. The most promising blocks of each query are scored first; that gives a kth score, and of
the others only those whose bound reaches it. What is found is exact, and no pass over the documents is made.

Layout at `path`: `terms` (term, df), `stats` (n, mean), `bounds` (term, block, top, width), `postings` (term, block, docs), the last
two sorted by term in each file, so that a query's terms prune row groups; a file of them has all terms of its blocks.

Defined cases: documents without a token are counted, and never found; null texts have no token; repeated ids are
documents of one id, which is found once with the sum of their scores; a query without a known term finds nothing; equal
queries are separate; scores are equal to six digits, and equal ones go by id; an empty table gives an empty index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.functions import tokens
from tarnflow.functions.text import grams, parts
from tarnflow.operators.numbering import numbered
from tarnflow.operators.retrieve import B, K1

DIGITS = 6


def write(docs: DataFrame, path: str, by: tuple[str, ...] = (), per_block: int = 16, files: int | None = None) -> None:
    """Write the index of documents (doc_id, content).

    Documents stand in blocks by the columns `by` (a category, a language) and then by length: the more alike the documents of a
    block are, the closer are its bounds. `files` is the number of files of postings, else the session's number of shuffle
    partitions.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lengths = docs.select("doc_id", tokens.length(F.col("content")).alias("doc_len"), *[F.col(c).alias(f"by_{c}") for c in by])
    lengths = lengths.groupBy("doc_id").agg(F.sum("doc_len").alias("doc_len"), *[F.min(f"by_{c}").alias(f"by_{c}") for c in by])
    numbered(lengths, *[f"by_{c}" for c in by], "doc_len", "doc_id").select("doc_id", "doc_len", F.floor(F.col("n") / per_block).alias("block")).write.mode("overwrite").parquet(f"{path}/lengths")
    lengths = spark.read.parquet(f"{path}/lengths")
    lengths.agg(F.count("*").alias("n"), F.avg("doc_len").alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    mean = spark.read.parquet(f"{path}/stats").first()["mean"] or 1.0
    # A block's texts are brought together and counted where they are, so no token is shuffled. A file has all terms of its blocks.
    texts = docs.select("doc_id", tokens.low(F.col("content")).alias("text")).join(lengths, "doc_id").repartitionByRange(files, "block")
    texts = texts.groupBy("block").agg(F.collect_list(F.struct("doc_id", "doc_len", "text")).alias("texts"))
    tokens.impacts(texts, K1, B, mean).sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")
    blocks = spark.read.parquet(f"{path}/postings")
    bounds = blocks.select("term", "block", F.array_max(F.transform("docs", lambda d: d["impact"])).alias("top"), F.size("docs").alias("width"))
    bounds.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/bounds")
    spark.read.parquet(f"{path}/bounds").groupBy("term").agg(F.sum("width").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")


def weighted(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(query_id, term, weight) of the known terms of queries (query_id, text): times in the query * idf."""
    asked = queries.select("query_id", F.explode(parts(F.col("text"))).alias("part")).groupBy("query_id", "part").agg(F.count("*").alias("times"))
    asked = asked.select("query_id", "times", F.explode(grams(F.col("part"))).alias("term")).groupBy("query_id", "term").agg(F.sum("times").alias("times"))
    known = asked.join(spark.read.parquet(f"{path}/terms"), "term").crossJoin(F.broadcast(spark.read.parquet(f"{path}/stats")))
    return known.select("query_id", "term", (F.col("times") * F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("weight"))


def bounded(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """(query_id, block, bound, width): what a query's documents in a block score at most, and how many postings it has there."""
    rows = asked.join(spark.read.parquet(f"{path}/bounds"), "term")
    return rows.groupBy("query_id", "block").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"), F.sum("width").alias("width"))


def scored(spark: SparkSession, path: str, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of the documents in the blocks (query_id, block) of each query."""
    # A row for each block with its queries, so that postings and not pairs with queries meet them; then a query's documents of a
    # block are in one task, which adds them up before anything is shuffled.
    visited = blocks.groupBy("block").agg(F.collect_set("query_id").alias("_visited"))
    rows = spark.read.parquet(f"{path}/postings").join(visited, "block").join(asked, "term").where(F.array_contains("_visited", F.col("query_id")))
    rows = rows.select("query_id", "weight", F.explode("docs").alias("d"))
    return rows.groupBy("query_id", F.col("d.doc_id").alias("doc_id")).agg(F.sum(F.col("weight") * F.col("d.impact")).alias("score"))


def best(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "doc_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, first: int = 8, scratch: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank from 1) of the k best of each query (query_id, text).

    `first` blocks of each query are scored to get its kth score. With `scratch`, a folder that driver and executors share, what
    both passes need is kept there, else it is computed twice.
    """
    hits, _, _ = passes(spark, path, queries, k, first, scratch)
    return hits


def passes(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, first: int = 8, scratch: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `search` gives, the blocks that it scores, and all blocks with a term of a query."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        if scratch is None:
            return df
        df.write.mode("overwrite").parquet(f"{scratch}/{name}")
        return spark.read.schema(df.schema).parquet(f"{scratch}/{name}")

    asked = kept(weighted(spark, path, queries), "asked")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("bound").desc(), "block"))
    blocks = kept(bounded(spark, path, asked).withColumn("place", place), "blocks")
    ahead = kept(best(scored(spark, path, asked, blocks.where(F.col("place") <= first)), k), "ahead")
    kth = ahead.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    # A little below the kth score: sums in another order differ in the last digits, and equal scores go by id.
    least = F.coalesce(F.col("kth") - 10.0**-DIGITS * (1 + F.col("kth")), F.lit(0.0))
    rest = blocks.where(F.col("place") > first).join(kth, "query_id", "left").where(F.col("bound") >= least)
    found = best(ahead.drop("rank").unionByName(scored(spark, path, asked, rest)), k)
    return found, blocks.where(F.col("place") <= first).select("query_id", "block", "width").unionByName(rest.select("query_id", "block", "width")), blocks
