"""Metadata filters and rerankers, which stand above the first top-k."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.functions.text import count_hits
from tarnflow.operators.retrieve import WILDCARD, top

#: The dictionary of terms, and priorities by level and by type.
TERMS = (
    "甲苯", "甲醇", "乙醇", "丙酮", "过氧化氢", "硫酸", "盐酸", "硝酸", "危化品", "危险化学品", "储罐", "防火堤", "消防通道",
    "安全距离", "甲类", "乙类", "丙类", "贮存", "存储", "国标", "GB15603", "GB30000", "禁忌物料", "氧化剂", "易燃液体",
    "易燃固体", "泄漏", "应急",
)
PRIORITY_BY_LEVEL = {"高": 3, "中": 2, "低": 1}
PRIORITY_BY_TYPE = {"国标": 3, "园区规则": 2, "历史案例": 1}


def passes(chemical: str | None = None, regulation: str | None = None) -> Column:
    """Which hits pass: a missing value passes, and so does the chemical wildcard."""
    out = F.lit(True)
    if chemical:
        c = F.col("chemical_type")
        out = out & (c.isNull() | (c == WILDCARD) | (F.lower(c) == chemical.lower()))
    if regulation:
        r = F.col("regulation_type")
        out = out & (r.isNull() | (F.lower(r) == regulation.lower()))
    return out


def bonus(priorities: Mapping[str, int], terms: tuple[str, ...] = TERMS) -> Column:
    levels = F.lit(0)
    for name, value in priorities.items():
        levels = F.when(F.lower("priority") == name.lower(), value * 1000).otherwise(levels)
    return levels + 50 * count_hits(F.col("content"), terms)


def rerank(hits: DataFrame, k: int, priorities: Mapping[str, int] = PRIORITY_BY_LEVEL, terms: tuple[str, ...] = TERMS) -> DataFrame:
    """hits by score and bonus (equal to nine digits: by rank), with `position`; score and rank stay what they were."""
    scored = hits.withColumn("_bonus", F.round(F.col("score") + bonus(priorities, terms), 9))
    order = [F.col("_bonus").desc(), F.col("rank")]
    best = scored.orderBy(*order).limit(k)
    return best.withColumn("position", (F.row_number().over(W.orderBy(*order)) - 1).cast("int")).drop("_bonus")


def regulations(scored: DataFrame, k: int, chemical: str | None = None, regulation: str | None = None, priorities: Mapping[str, int] = PRIORITY_BY_LEVEL, terms: tuple[str, ...] = TERMS) -> DataFrame:
    """Top 2k, then the filter, then the reranker's k."""
    return rerank(top(scored, 2 * k).where(passes(chemical, regulation)), k, priorities, terms)


def simple(scored: DataFrame, k: int, priorities: Mapping[str, int] = PRIORITY_BY_TYPE) -> DataFrame:
    """Top 3k by score, then k by score and priority alone."""
    return rerank(top(scored, 3 * k), k, priorities, ())
