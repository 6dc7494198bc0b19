"""A log of searches: what was asked, how many results it had, how long it took."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarnflow import schema


class SearchLog:
    """A table at a path that driver and executors share, a row for each search.

    Results are counted where they are made (`observe`), not by a second run of the search.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def run(self, query: str, search: Callable[[str], DataFrame], to: str, source_priority: str | None = None, now: Column | None = None) -> DataFrame:
        """Run a search, keep its results as a table at `to`, and log it; the results. One that fails is not logged."""
        seen = Observation()
        hits = search(query).observe(seen, F.count("*").alias("n"))
        start = time.monotonic()
        hits.write.mode("overwrite").parquet(to)
        took = int((time.monotonic() - start) * 1000)
        row = self.spark.createDataFrame([(query, seen.get["n"], took, source_priority)], "query string, results_count int, execution_time_ms int, source_priority string")
        row.withColumn("created_at", F.current_timestamp() if now is None else now.cast("timestamp")).coalesce(1).write.mode("append").parquet(self.path)
        return self.spark.read.schema(hits.schema).parquet(to)

    def read(self) -> DataFrame:
        return self.spark.read.schema(schema.SEARCH_LOG).parquet(self.path)

    def slowest(self, n: int = 10) -> DataFrame:
        """Queries by their longest run, with how often they ran and found nothing."""
        by = self.read().groupBy("query").agg(F.count("*").alias("runs"), F.max("execution_time_ms").alias("longest_ms"), F.count_if(F.col("results_count") == 0).alias("empty"))
        return by.orderBy(F.col("longest_ms").desc(), "query").limit(n)
