"""The knowledge base as an object: documents in, ranked chunks out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow import schema
from tarnflow.functions.text import preview
from tarnflow.operators import rerank, retrieve
from tarnflow.operators.numbering import numbered
from tarnflow.sources import corpus


class KnowledgeBase:
    """Documents as a lazy DataFrame; every insert gives a new plan, and statistics are those of the current corpus."""

    def __init__(self, spark: SparkSession, docs: DataFrame | None = None) -> None:
        self.spark = spark
        self.docs = docs if docs is not None else spark.createDataFrame([], schema.DOCUMENT)

    def add(self, rows: DataFrame, order: str = "content") -> KnowledgeBase:
        """Insert a batch with any of the documents' columns; ids go on from the count, in the given order."""
        for c in self.docs.columns:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(self.docs.schema[c].dataType))
        start = self.docs.agg(F.count("*").alias("_n"))
        rows = numbered(rows, order, column="_k").crossJoin(F.broadcast(start)).withColumn("doc_id", F.col("_n") + F.col("_k"))
        self.docs = self.docs.unionByName(rows.select(*self.docs.columns))
        return self

    def add_texts(self, texts: Sequence[str]) -> KnowledgeBase:
        return self.add(self.spark.createDataFrame(list(enumerate(texts)), "seq long, content string"), "seq")

    def add_regulation(self, content: str, regulation_type: str, priority: str, chemical_type: str | None = None) -> KnowledgeBase:
        return self.add(self.spark.createDataFrame([(content, regulation_type, priority, chemical_type or "通用")], "content string, regulation_type string, priority string, chemical_type string"))

    def add_regulations(self, rows: DataFrame, order: str = "content") -> KnowledgeBase:
        """Insert a table of regulations (content, regulation_type, priority, chemical_type); a missing chemical type is the wildcard."""
        return self.add(rows.withColumn("chemical_type", F.coalesce("chemical_type", F.lit("通用"))), order)

    def load(self, root: str, limit: int | None = 500) -> KnowledgeBase:
        """Files of the category folders, in chunks, or whole where limit is None."""
        rows = corpus.whole_files(self.spark, root) if limit is None else corpus.chunked(corpus.files(self.spark, root), limit=limit)
        key = F.concat_ws("/", "regulation_type", "source_file") if limit is None else F.concat_ws("/", "regulation_type", "source_file", F.lpad(F.col("chunk").cast("string"), 9, "0"))
        return self.add(rows.withColumn("_at", key), "_at")

    def count(self) -> int:
        return self.docs.count()

    def clear(self) -> KnowledgeBase:
        self.docs = self.docs.limit(0)
        return self

    def retrieve(self, query: str, k: int = 5) -> DataFrame:
        return self._chunks(retrieve.bm25(self.docs, query, k), "BM25")

    def regulations(self, query: str, chemical: str | None = None, regulation: str | None = None, k: int = 5, by_level: bool = True) -> DataFrame:
        scored = retrieve.bm25_scores(self.docs, query)
        return rerank.regulations(scored, k, chemical, regulation, rerank.PRIORITY_BY_LEVEL if by_level else rerank.PRIORITY_BY_TYPE)

    def _chunks(self, hits: DataFrame, method: str) -> DataFrame:
        """Results as chunks; the id is a hash of the document, so reruns agree."""
        shown = F.concat(F.lit("["), F.format_string("%.4f", "score"), F.lit("] "), preview(F.col("content")))
        return hits.select(F.sha1(F.concat_ws(":", "doc_id", "content")).alias("id"), "content", "score", "rank", corpus.metadata(hits).alias("metadata"), F.lit(method).alias("retrieval_method"), shown.alias("shown"))
