import random

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import blockmax, retrieve


@pytest.fixture(scope="module")
def docs(spark):
    """Two kinds of vocabulary; blank and null texts, copies, a repeated id, a long text, columns of clashing names."""
    rng = random.Random(3)
    words = {k: ["".join(rng.choices(k, k=rng.randint(2, 6))) for _ in range(40)] for k in ("abcde", "vwxyz")}
    rows = [(i, " ".join(rng.choices(words["abcde" if i % 3 else "vwxyz"], k=rng.randint(1, 30))), "a" if i % 3 else "v", "x", 1) for i in range(300)]
    rows += [(300, None, None, None, None), (301, "", "a", None, None), (302, " ,. ", "a", None, None), (303, rows[7][1], "a", None, None), (304, " ".join(rng.choices(words["abcde"], k=4000)), None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, content string, kind string, term string, block int").repartition(4)


@pytest.fixture(scope="module")
def queries(docs):
    texts = [r["content"] for r in docs.where("doc_id IN (3, 7, 100)").orderBy("doc_id").collect()]
    return list(enumerate([*texts, "ab cd", "zz", "", None, "unknown 漢", texts[0]]))


def brute(docs, queries, k):
    out = {}
    for q, text in queries:
        rows = retrieve.bm25_scores(docs.select("doc_id", "content"), text or "").select("doc_id", "score").collect()
        out[q] = [(d, s) for s, d in sorted(((-round(r["score"], 6), r["doc_id"]) for r in rows))[:k]]
    return out


@pytest.mark.parametrize("by, per_block, first", [(("kind",), 8, 2), ((), 16, 8), (("kind",), 1000, 1)])
def test_same_as_scoring_all_documents(spark, docs, queries, tmp_path, by, per_block, first):
    blockmax.write(docs, str(tmp_path / "index"), by, per_block, files=3)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    hits, used, every = blockmax.passes(spark, str(tmp_path / "index"), asked, 10, first, str(tmp_path / "scratch"))
    got = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["doc_id"], -round(r["score"], 6)))
    want = {q: v for q, v in brute(docs, queries, 10).items() if v}
    assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items()}
    assert all(x == pytest.approx(y, abs=2e-6) for q in got for (_, x), (_, y) in zip(got[q], want[q]))
    if per_block == 8:
        assert used.count() < every.count()


def test_bounds_hold(spark, docs, queries, tmp_path):
    blockmax.write(docs, str(tmp_path / "index"), ("kind",), 8)
    path = str(tmp_path / "index")
    asked = blockmax.weighted(spark, path, spark.createDataFrame(queries, "query_id long, text string"))
    bounds = blockmax.bounded(spark, path, asked)
    scores = blockmax.scored(spark, path, asked, bounds).join(spark.read.parquet(f"{path}/lengths"), "doc_id").groupBy("query_id", "block").agg(F.max("score").alias("most"))
    assert bounds.join(scores, ["query_id", "block"], "full_outer").where("most IS NULL OR bound IS NULL OR most > bound + 1e-9").count() == 0


def test_empty_index(spark, docs, tmp_path):
    blockmax.write(docs.limit(0), str(tmp_path / "index"))
    assert blockmax.search(spark, str(tmp_path / "index"), spark.createDataFrame([(1, "ab")], "query_id long, text string")).count() == 0
