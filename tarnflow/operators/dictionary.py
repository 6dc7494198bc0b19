"""Which terms of a table occur in which texts: an Aho-Corasick automaton reads each text once, however many terms there are.

The terms are counted first. Up to `most` characters they go to every task, which builds one automaton. Beyond that they are
dealt by hash to parts of at most about that size, texts to chunks, and each chunk meets each part.

Defined cases: case is ignored; null and empty terms are left out; terms that differ in case only are one; a term inside
another one, or overlapping it, counts too; null texts have no term, texts without one are there with an empty list; repeated
ids are rows each; very long texts are read whole; other columns are ignored; an empty table of terms finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.operators.rerank import PRIORITY_BY_LEVEL, bonus


def reader(terms: list[str]) -> Callable[[str | None], list[str]]:
    """A function from a lower-case text to its terms, each once, in order."""
    held = ahocorasick.Automaton()
    for t in terms:
        held.add_word(t, t)
    if not terms:
        return lambda text: []
    held.make_automaton()
    return lambda text: sorted({t for _, t in held.iter(text)}) if text else []


def _lowered(terms: DataFrame, term: str) -> DataFrame:
    return terms.select(F.lower(F.col(term).cast("string")).alias("term")).where("term <> ''").distinct()


def found(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", content: str = "content", term: str = "term", most: int = 1 << 24, chunk: int = 1 << 26) -> DataFrame:
    """(doc_id, terms, hits): for each row of docs the terms of the table that it contains, in order, and how many."""
    wanted = _lowered(terms, term)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(content)).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    size = wanted.agg(F.coalesce(F.sum(F.length("term") + 8), F.lit(0))).first()[0]
    if size <= most:
        held = [r["term"] for r in wanted.collect()]  # at most `most` characters

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of = reader(held)
            for b in batches:
                yield pd.DataFrame({"doc_id": b["doc_id"], "terms": pd.Series([of(x) for x in b["text"]], dtype=object)})

        return texts.mapInPandas(read, f"doc_id {kind}, terms array<string>").withColumn("hits", F.size("terms"))
    parts = -(-size // most)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-total // chunk))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    # A row goes by its text, so that what is read again after a loss goes to the same chunk.
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).withColumn("part", every(parts))
    dealt = wanted.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).withColumn("chunk", every(chunks))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of = reader(right["term"].tolist())
        return pd.DataFrame({"row": left["row"], "doc_id": left["doc_id"], "terms": pd.Series([of(x) for x in left["text"]], dtype=object)})

    halves = rows.groupBy("part", "chunk").cogroup(dealt.groupBy("part", "chunk")).applyInPandas(meet, f"row long, doc_id {kind}, terms array<string>")
    whole = halves.groupBy("row", "doc_id").agg(F.array_sort(F.flatten(F.collect_list("terms"))).alias("terms"))
    return whole.select("doc_id", "terms", F.size("terms").alias("hits"))


def rerank(hits: DataFrame, k: int, terms: DataFrame, priorities: Mapping[str, int] = PRIORITY_BY_LEVEL, per_term: int = 50, **settings) -> DataFrame:
    """hits (doc_id, content, score, rank, priority) by score, priority and a bonus for each term of the table that a text
    contains, with `position`; score and rank stay what they were. doc_id must be unique."""
    counted = found(hits, terms, **settings).select("doc_id", "hits")
    total = F.round(F.col("score") + bonus(priorities, ()) + per_term * F.col("hits"), 9)
    order = [F.col("_bonus").desc(), F.col("rank")]
    best = hits.join(counted, "doc_id").withColumn("_bonus", total).orderBy(*order).limit(k)
    return best.withColumn("position", (F.row_number().over(W.orderBy(*order)) - 1).cast("int")).drop("_bonus", "hits")
