import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnflow.llm import language


def test_network_rejects_what_is_no_language(spark, documents):
    rng = random.Random(6)
    say = lambda letters, n=60: " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    rows = [(i, say("abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz", "s", None) for i in range(1, 161)]
    mixed = [(i, say("abcde", 30) + " " + say("vwxyz", 30), None, "s", None) for i in range(201, 206)]
    clean = [(i, say("vwxyz"), None, "s", None) for i in range(301, 306)]
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, documents(rows + mixed + clean), "").collect()}
    assert got == {**{r[0]: r[2] for r in rows}, **{r[0]: "zz" for r in clean}}


def test_without_labels_documents_with_letters_stay(spark, documents):
    rows = [(1, "some words", None, "s", None), (2, "12 34 !!", None, "s", None), (3, None, None, "s", None), (4, "\u6f22", None, "s", None)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, documents(rows), "").collect()) == [1, 4]


def test_all_held_out_documents_set_the_least_score(spark, documents, monkeypatch):
    """Of more than 2,000 held-out ones, too: before, those with the smallest hashes alone did."""
    ids = spark.range(1, 12000).withColumnRenamed("id", "doc_id").where(~language.learnable())
    ids = [r["doc_id"] for r in ids.orderBy(F.xxhash64(F.lit("least"), "doc_id")).limit(2600).collect()]
    assert len(ids) == 2600
    rows = [(i, "a" * 90, "aa", "s", None) for i in ids[:-1]] + [(ids[-1], "a" * 50, "aa", "s", None)]
    other = [(20001, "a" * 45, None, "s", None), (20002, "a" * 35, None, "s", None)]

    def identify(df, model, doc_id, text, keep):
        return df.withColumn("lang_pred", F.lit("aa")).withColumn("score", F.length(text) / 100)

    monkeypatch.setattr(language, "identify", identify)
    monkeypatch.setattr(language, "train", lambda df, learn: (["aa"], {}))
    docs = documents(rows + other)
    assert language.least_score(docs, (["aa"], {}), ~language.learnable()) == pytest.approx(0.8 * 0.5)
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").select("doc_id").collect()}
    assert got == {*ids, 20001}
