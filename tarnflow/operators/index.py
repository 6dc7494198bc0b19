"""Inverted index: postings, document and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import tokens
from tarnflow.functions.text import doc_len


def counted(docs: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, doc_len, postings), postings being (term, tf). The texts of an id are brought together and counted where they
    are, so no token is shuffled."""
    texts = docs.select(F.col(doc_id).alias("key"), tokens.low(F.col(content)).alias("text")).groupBy("key").agg(F.collect_list("text").alias("texts"))
    return tokens.counted(texts).withColumnRenamed("key", "doc_id")


def postings(docs: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, term, tf)."""
    return counted(docs, doc_id, content).select("doc_id", F.inline("postings"))


def doc_freq(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def doc_stats(docs: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), tokens.length(F.col(content)).alias("doc_len"))


def corpus_stats(docs: DataFrame, content: str = "content") -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.avg(doc_len(F.col(content))).alias("avg_doc_len"))


def write(docs: DataFrame, path: str, buckets: int | None = None) -> None:
    """Postings sorted by term within files, so that a query's terms prune row groups; beside them the documents' lengths."""
    rows = postings(docs)
    # By document too, as a character that all documents have would be one partition.
    order = ("term", "doc_id")
    dealt = rows.repartitionByRange(buckets, *order) if buckets else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    doc_stats(docs).write.mode("overwrite").parquet(f"{path}/lengths")


def save(docs: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Save the index as two tables, `{name}_postings` and `{name}_stats`, with their files under `path`.

    Postings (term, doc_id, tf, doc_len) are bucketed by term and sorted, so a query's terms read only their buckets, and
    what is counted or joined by term needs no exchange. A character that all documents have fills a bucket: it is written as
    several files of the bucket, as rows are dealt by document too.
    """
    rows = counted(docs).where("doc_id IS NOT NULL").select("doc_id", "doc_len", F.inline("postings"))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    dealt = rows.select("term", "doc_id", "tf", "doc_len").repartition(buckets, F.pmod(F.hash("term"), F.lit(buckets)), spread)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, "term").sortBy("term", "doc_id").option("path", f"{path}/postings").saveAsTable(f"{name}_postings")
    stats = docs.groupBy("doc_id").agg(F.sum(doc_len(F.col("content"))).alias("doc_len")).agg(F.count("*").alias("n"), F.avg("doc_len").alias("mean"))
    stats.coalesce(1).write.mode("overwrite").format("parquet").option("path", f"{path}/stats").saveAsTable(f"{name}_stats")


def saved(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """(postings, stats) of a saved index."""
    return spark.table(f"{name}_postings"), spark.table(f"{name}_stats")


def save_by_category(docs: DataFrame, name: str, path: str, *categories: str) -> None:
    """Save documents as a table in a folder for each value of the categories, so that a filter on these lists their files only."""
    docs.write.mode("overwrite").format("parquet").partitionBy(*categories).option("path", path).saveAsTable(name)
