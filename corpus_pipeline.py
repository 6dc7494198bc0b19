"""Corpus pipeline: language ID, line dedup, near-dedup, mixing to target weights, best-fit packing.

Defined cases: documents with a null or letterless text leave in the first stage, which keeps all others where nothing is
labelled; a null doc_id, lang or source is kept (the mix takes null sources for one source); a language that is missing is
filled in; of repeated rows one stays in the third stage, and what the mix repeats is told apart by `copy` at the end;
very long texts are processed whole; ties go as the operators state; columns of any name besides those of documents pass
through all stages but the last, unchanged; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import language, linedup, mixing, nearcopies, packing
from tarnflow.llm.common import GIVEN, aside, back, given, read, store


#: A score from which the network's language replaces a stated one that differs.
SURE = 0.98


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    rest = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return df.select(*rest)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network gives a language go on: those with a letter and a score that is not far below the
    lowest one of all held-out documents with a right prediction (`language.least_right`). Each document is scored once.

    A predicted language replaces a missing one, and with a score of `SURE` a stated one that differs. Where no row has a
    label to learn from, all documents with a letter go on as they are.
    """
    model = language.train(docs, learn=language.learnable())
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = store(language.identify(aside(docs), model, GIVEN + "doc_id", GIVEN + "text", keep=True))
    least = language.least_right(found, ~language.learnable(GIVEN + "doc_id"), GIVEN + "lang")
    found = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least))
    lang = F.when(given("lang").isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(given("lang"))
    return back(found.withColumn(GIVEN + "lang", lang).select(*map(given, docs.columns)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of two lines, or lines of 50 words, leave the texts; a document that consisted of them alone leaves as a whole."""
    cleaned = linedup.dedup(aside(docs), GIVEN + "doc_id", GIVEN + "text", long_words=50)
    stay = (F.col("n_removed") == 0) | given("text").rlike(r"[^\x20\x09-\x0D]")
    return _as_documents(back(cleaned.where(stay).select(*map(given, docs.columns))), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one with the smallest doc_id.

    Linked are texts whose sets of five-word shingles have a similarity of 0.8 or more, verified on the whole texts. Links come
    from SimHash fingerprints in vantage-point shards and trees; bands of MinHashes add what differs in more bits.
    """
    return nearcopies.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a part of half its words or more counts as one more copy."""
    mixed = mixing.mix(aside(docs), GIVEN + "doc_id", GIVEN + "source", GIVEN + "text")
    times = F.col("copies") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    rows = mixed.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(times, F.lit(1))))).where(times > 0)
    return back(rows.select(*map(given, docs.columns)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document, and of each `copy` that the mix made of it, in bins of 2,048 words."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents; each result is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
