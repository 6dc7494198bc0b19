import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnflow.functions import text, tokens
from tarnflow.operators import index, retrieve


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    line = lambda: "".join(rng.choices("aAbcÄİßÀ漢😀  .,-_()[]:;!?\"\t\n\x0b\x1c\x1f\x85\xa0 　，。：；、！？", k=rng.randint(0, 200)))
    rows = [(i, line()) for i in range(200)] + [(3, "aaa aa a"), (3, None), (900, None), (901, ""), (902, " ,. "), (None, "ab b"), (None, "ab")]
    return spark.createDataFrame(rows, "doc_id long, content string").repartition(3)


def test_postings_equal_tokens_and_only_texts_are_shuffled(docs):
    want = Counter()
    for r in docs.select("doc_id", text.tokenize(F.col("content")).alias("t")).collect():
        want.update((r["doc_id"], t) for t in r["t"])
    found = index.postings(docs)
    assert {(r["doc_id"], r["term"]): r["tf"] for r in found.collect()} == want
    assert found.count() == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(term" not in plan and "hashpartitioning(part" not in plan


def test_joined_and_length(docs):
    c = F.col("content")
    both = docs.select(tokens.joined(c), F.array_join(text.tokenize(c), " "), tokens.length(c), text.doc_len(c))
    assert all(r[0] == r[1] and r[2] == r[3] for r in both.collect())


def test_counts(docs):
    terms = ["a", "aa", "ab", "漢", "äß", "aaa", "😀", "not there"]
    for r in docs.select(tokens.counts(F.col("content"), terms).alias("c"), text.tokenize(F.col("content")).alias("t")).collect():
        assert r["c"]["len"] == len(r["t"]) and r["c"]["tf"] == [r["t"].count(t) for t in terms]


def test_scores_part_each_text_in_one_function(docs):
    """Before, each term of a query took a pass of expressions over the text."""
    plan = retrieve.bm25_scores(docs, "the station of there")._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "octet_length(" not in plan
    assert plan.count("ArrowEvalPython") == 2  # one for statistics, one for scores
