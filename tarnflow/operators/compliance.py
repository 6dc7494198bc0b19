"""Compliance checks: regulations by BM25, a prompt, a model's conclusion and an audit record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions import prompts, tools
from tarnflow.operators import audit, retrieve


def check(docs: DataFrame, text: str, k: int = 5, model: tools.Generator = tools.stub) -> DataFrame:
    """(text, n_references, prompt, conclusion), one row. The k regulations are all that is gathered."""
    hits = retrieve.bm25(docs, text, k)
    found = F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"])
    asked = hits.agg(found.alias("found")).select(F.lit(text).alias("text"), F.size("found").alias("n_references"), prompts.compliance(F.lit(text), F.col("found")).alias("prompt"))
    return asked.withColumn("conclusion", tools.generate(F.col("prompt"), model))


def recorded(log: DataFrame, checked: DataFrame, now: Column, user: str = "default-user") -> DataFrame:
    """log with a sensitive record of each check."""
    details = F.concat(F.lit("巡检内容: "), F.substring("text", 1, 50), F.lit("..."))
    rows = checked.select(F.col("text").alias("seq"), F.lit(user).alias("user_id"), F.lit("合规自查").alias("operation"), details.alias("details"), F.lit(True).alias("is_sensitive"))
    return audit.append(log, rows, now)
