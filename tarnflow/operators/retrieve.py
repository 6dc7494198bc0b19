"""Retrieval: BM25, exact vector search, and their weighted union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.functions import tokens
from tarnflow.functions.text import count_hits, query_terms
from tarnflow.operators.index import saved

K1, B = 1.5, 0.75
WILDCARD = "通用"


def _part(tf: Column, df: Column, n: Column, length: Column, mean: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25_scores(docs: DataFrame, query: str, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """docs with `score`, the documents above 0 only.

    The counts of the query's terms are read off each text, so no token is made and no posting shuffled: one pass
    sums document frequencies into one row, a second scores. A text is lowered and parted once in each, by Python workers.
    """
    terms = query_terms(query)
    if not terms:
        return docs.withColumn("score", F.lit(0.0)).where(F.lit(False))
    counted = docs.withColumn("_c", tokens.counts(F.col(content), list(terms))).withColumns({"_len": F.col("_c.len"), "_tf": F.col("_c.tf")}).drop("_c")
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"), F.array(*[F.sum((F.col("_tf")[i] > 0).cast("long")) for i in range(len(terms))]).alias("_df"))
    rows = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, times in enumerate(terms.values()):
        part = _part(F.col("_tf")[i], F.col("_df")[i], F.col("_n"), F.col("_len"), F.col("_mean"))
        score = score + F.when(F.col("_tf")[i] > 0, times * part).otherwise(0.0)
    # A generator of one row keeps the filter on the score from counting the terms a second time.
    scored = rows.withColumn("score", F.explode(F.array(score)))
    return scored.where("score > 0").drop("_len", "_tf", "_n", "_mean", "_df")


def bm25_indexed(index: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """(doc_id, score) from postings and document lengths; only the query's postings are read and shuffled."""
    terms = query_terms(query)
    wanted = index.where(F.col("term").isin(*terms)) if terms else index.where(F.lit(False))
    weight = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv]) if terms else F.create_map(F.lit(""), F.lit(0))
    frequency = wanted.groupBy("term").agg(F.count("*").alias("df"))  # a row per term of the query
    stats = lengths.agg(F.count("*").alias("n"), F.avg("doc_len").alias("mean"))
    rows = wanted.join(F.broadcast(frequency), "term").join(lengths, "doc_id").crossJoin(F.broadcast(stats))
    part = weight[F.col("term")] * _part(F.col("tf"), F.col("df"), F.col("n"), F.col("doc_len"), F.col("mean"))
    return rows.groupBy("doc_id").agg(F.sum(part).alias("score"))


def bm25_saved(spark: SparkSession, name: str, query: str) -> DataFrame:
    """(doc_id, score) from an index saved as tables: the buckets of the query's terms are read, and joined without an exchange."""
    postings, stats = saved(spark, name)
    terms = query_terms(query)
    if not terms:
        return postings.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
    wanted = postings.where(F.col("term").isin(*terms))
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))  # counted in each bucket
    weight = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])
    rows = wanted.join(df.hint("merge"), "term").crossJoin(F.broadcast(stats))  # one row
    part = weight[F.col("term")] * _part(F.col("tf"), F.col("df"), F.col("n"), F.col("doc_len"), F.col("mean"))
    return rows.groupBy("doc_id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int, doc_id: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best with rank from 0; equal scores go by id.

    Scores are equal to nine digits: what is beyond depends on the order in which terms are added.
    """
    order = [F.round(score, 9).desc(), F.col(doc_id)]
    best = scored.orderBy(*order).limit(k)
    return best.withColumn("rank", (F.row_number().over(W.orderBy(*order)) - 1).cast("int"))


def bm25(docs: DataFrame, query: str, k: int = 5) -> DataFrame:
    return top(bm25_scores(docs, query), k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null where a vector is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector(docs: DataFrame, query: Sequence[float], k: int = 5, embedding: str = "embedding") -> DataFrame:
    """The k nearest by cosine distance; documents without a vector never surface, an undefined distance sorts last."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = docs.where(F.col(embedding).isNotNull()).withColumn("score", cosine(F.col(embedding), q))
    best = scored.orderBy((1 - F.col("score")).asc_nulls_last(), "doc_id").limit(k)
    return best.withColumn("rank", (F.row_number().over(W.orderBy((1 - F.col("score")).asc_nulls_last(), "doc_id")) - 1).cast("int"))


def merge(bm25_hits: DataFrame, vector_hits: DataFrame, k: int, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Weighted union of two rankings (doc_id, content, score, rank), keyed by the first 100 characters.

    Of rows with one key on a side, the last ranked one counts. Hits of both sides keep the document of the first.
    """

    def side(hits: DataFrame, name: str) -> DataFrame:
        last = F.row_number().over(W.partitionBy("key").orderBy(F.col("rank").desc()))
        rows = hits.select(F.substring("content", 1, 100).alias("key"), *[F.col(c).alias(f"{name}_{c}") for c in ("doc_id", "content", "score")], F.col("rank"))
        return rows.withColumn("_last", last).where("_last = 1").drop("_last").withColumnRenamed("rank", f"{name}_rank")

    rows = side(bm25_hits, "b").join(side(vector_hits, "v"), "key", "full_outer")
    score = weights[0] * F.coalesce("b_score", F.lit(0.0)) + weights[1] * F.coalesce("v_score", F.lit(0.0))
    order = [F.col("score").desc(), F.col("b_rank").asc_nulls_last(), F.col("v_rank").asc_nulls_last()]
    rows = rows.select(F.coalesce("b_doc_id", "v_doc_id").alias("doc_id"), F.coalesce("b_content", "v_content").alias("content"), score.alias("score"), "b_rank", "v_rank")
    best = rows.orderBy(*order).limit(k)
    return best.withColumn("rank", (F.row_number().over(W.orderBy(*order)) - 1).cast("int")).withColumn("method", F.lit("Hybrid")).drop("b_rank", "v_rank")


def search(docs: DataFrame, query: str, embedding: Sequence[float] | None, k: int = 5, mode: str = "hybrid", weights: tuple[float, float] = (0.5, 0.5), vectors: DataFrame | None = None) -> DataFrame:
    """Mode bm25, vector, or anything else for hybrid. Without a query vector the vector branch falls back to BM25.

    Vectors are a column `embedding` of docs, or a table (doc_id, embedding) of their own: then they are ranked beside the ids
    alone, and contents are fetched for what was found.
    """
    columns = ("doc_id", "content", "score", "rank", "method")
    named = lambda df, name: df.withColumn("method", F.lit(name)).select(*columns)

    def near(n: int) -> DataFrame:
        if embedding is None:
            return named(bm25(docs, query, n), "BM25")
        if vectors is None:
            return named(vector(docs, embedding, n), "Vector")
        best = vector(vectors.join(docs.select("doc_id"), "doc_id", "left_semi"), embedding, n).select("doc_id", "score", "rank")
        return named(docs.select("doc_id", "content").join(F.broadcast(best), "doc_id"), "Vector")  # n rows

    if mode.lower() == "bm25":
        return named(bm25(docs, query, k), "BM25")
    if mode.lower() == "vector":
        return near(k)
    return merge(bm25(docs, query, 2 * k), near(2 * k), k, weights).select(*columns)


def keyword_top(docs: DataFrame, question: str, known: tuple[str, ...], default: tuple[str, ...], k: int = 3) -> DataFrame:
    """The k documents with most of the question's keywords; where none has any, the first k."""
    wanted = tuple(x for x in known if x.lower() in question.lower()) or default
    hits = docs.withColumn("hits", count_hits(F.col("content"), wanted))
    best = hits.where("hits > 0").orderBy(F.col("hits").desc(), "doc_id").limit(k)
    first = hits.orderBy("doc_id").limit(k)
    some = best.agg((F.count("*") > 0).alias("some"))
    return best.unionByName(first.crossJoin(F.broadcast(some)).where("not some").drop("some"))
