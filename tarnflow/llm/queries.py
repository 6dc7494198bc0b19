"""Queries of the training-text operators, under the names that the driver runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import graph, language, linedup, mixing, packing, prefixes, quality, secrets, simhash, tokens, topk, toxicity, whitening
from tarnflow.llm.common import bucket_of, read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages on one line of 50 words or more go too."""
    return linedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), long_words=50)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs, learn=language.learnable()))
    return found.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates by SimHash are one cluster, so they never share a bin."""
    docs = read(spark, sf_dir, "documents")
    return packing.pack_items(packing.items_in_components(packing.items(docs), simhash.components_of(docs)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels"), learn=toxicity.learnable()))
    return found.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.documents(tokens.write(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(prefixes.with_heads(prefixes.gathered(read(spark, sf_dir, "conversations"))))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(read(spark, sf_dir, "embeddings")))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.search_all(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op5_tokens": op5_tokens,
    "op2_packing": op2_packing,
    "op6_toxicity": op6_toxicity,
    "op10_topk": op10_topk,
    "op8_secrets": op8_secrets,
    "op7_language": op7_language,
    "op9_mixing": op9_mixing,
    "op1_quality_rules": op1_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_line_dedup": op4_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_neighbours": op12_neighbours,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.sql(),
    "op4_line_dedup": linedup.sql(),
    "op8_secrets": secrets.sql(),
    "op9_mixing": mixing.sql(),
    "op10_topk": topk.sql(),
    "op13_prefix_trie": prefixes.sql(),
}
