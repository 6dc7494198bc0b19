import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tarnflow.functions import variants
from tarnflow.operators import dictionary, index, rerank, retrieve
from tarnflow.operators.searchlog import SearchLog

SCHEMA = "doc_id long, content string, terms string, part int, term string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abÄc漢", k=rng.randint(1, 4)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 25)))) for i in range(120)]
    rows += [(7, rows[3][1]), (500, None), (501, ""), (None, "ab"), (502, "ab " * 40_000 + "zz")]
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(3)


TERMS = ["ab", "AB", "a", "ba", "aba", "", None, "ä漢", "zz", "not there", " ", "b a", "(?", "漢漢漢"]


@pytest.mark.parametrize("most, chunk", [(1 << 24, 1 << 26), (20, 2000)])
def test_dictionary(spark, docs, most, chunk):
    """With the terms in each task, and with parts of them meeting chunks of the texts."""
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    want = sorted(((r["doc_id"], sorted({t.lower() for t in TERMS if t and t.lower() in (r["content"] or "").lower()})) for r in docs.collect()), key=repr)
    rows = dictionary.found(docs, terms, most=most, chunk=chunk).collect()
    assert sorted(((r["doc_id"], r["terms"]) for r in rows), key=repr) == want
    assert all(r["hits"] == len(r["terms"]) for r in rows)
    assert all(r["hits"] == 0 for r in dictionary.found(docs, terms.limit(0)).collect())
    assert dictionary.found(docs.limit(0), terms, most=most).count() == 0


def test_dictionary_equals_the_fixed_one(spark):
    """The reranker gives the same with a table of terms as with the list in its plan."""
    rows = [(i, t, p, 5.0 - i, i) for i, (t, p) in enumerate((("储罐 防火堤 gb15603", "低"), ("消防通道", "高"), ("无关", "中"), ("甲苯 GB15603 应急", None)))]
    hits = spark.createDataFrame(rows, "doc_id long, content string, priority string, score double, rank int")
    terms = spark.createDataFrame([(t,) for t in rerank.TERMS], "term string")
    shown = lambda df: [(r["doc_id"], r["score"], r["rank"], r["position"]) for r in df.orderBy("position").collect()]
    assert shown(dictionary.rerank(hits, 3, terms)) == shown(rerank.rerank(hits, 3))


def test_saved_index(spark, docs, tmp_path):
    sound = docs.where("doc_id <> 7 AND doc_id <> 502")
    index.save(sound, "saved_index", str(tmp_path / "i"), buckets=8)
    for query in ("ab 漢a", "ÄC", "", "zz"):
        got = {r["doc_id"]: r["score"] for r in retrieve.bm25_saved(spark, "saved_index", query).collect()}
        assert got == pytest.approx({r["doc_id"]: r["score"] for r in retrieve.bm25_scores(sound, query).collect()})
    plan = retrieve.bm25_saved(spark, "saved_index", "ab")._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") :]
    assert "Exchange hashpartitioning(term" not in join and "SelectedBucketsCount: " in join  # buckets are read, and joined as they are
    read = [int(x.split(" ")[0]) for x in join.split("SelectedBucketsCount: ")[1:]]
    assert max(read) <= 3
    for name in ("saved_index_postings", "saved_index_stats"):
        spark.sql(f"DROP TABLE {name}")


def test_categories_are_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, "x", "国标" if i % 2 else "园区规则", None) for i in range(20)], "doc_id long, content string, regulation_type string, chemical_type string")
    index.save_by_category(df, "by_category", str(tmp_path / "d"), "regulation_type")
    some = spark.table("by_category").where("regulation_type = '国标'")
    assert some.count() == 10 and len(some.inputFiles()) < len(spark.table("by_category").inputFiles())
    assert "PartitionFilters: [isnotnull(regulation_type" in some._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE by_category")


def test_search_log(spark, docs, tmp_path):
    log = SearchLog(spark, str(tmp_path / "log"))
    run = lambda q, search=None: log.run(q, search or (lambda x: retrieve.bm25(docs, x, 5)), str(tmp_path / "hits"), "bm25")
    assert run("ab").count() == 5
    assert run("q").count() == 0
    run("ab")
    with pytest.raises(PySparkException):
        run("ab", lambda x: docs.select(F.raise_error(F.lit("lost"))))
    rows = log.read().collect()
    assert sorted((r["query"], r["results_count"]) for r in rows) == [("ab", 5), ("ab", 5), ("q", 0)]
    assert all(r["execution_time_ms"] >= 0 and r["created_at"] is not None and r["source_priority"] == "bm25" for r in rows)
    assert {(r["query"], r["runs"], r["empty"]) for r in log.slowest().collect()} == {("ab", 2, 0), ("q", 1, 1)}


def test_variants(spark):
    rows = ['{"k": 3, "who": {"id": "u"}}', '{"k": "x", "who": 7}', "{}", "none", None, "[1, 2]", '{"k": null}', '{"k": 99999999999999999999}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").withColumn("v", variants.data(F.col("x")))
    v = F.col("v")
    got = df.select("i", v.isNotNull(), variants.field(v, "$.k", "long"), variants.field(v, "$.who.id", "string"), variants.kind(v, "$.k")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(True, 3, "u", "BIGINT"), (True, None, None, "STRING"), (True, None, None, None), (False, None, None, None), (False, None, None, None), (True, None, None, None), (True, None, None, "VOID"), (True, None, None, "DECIMAL(20,0)")]
    assert df.where("i < 2").agg(variants.shape(v)).first()[0] == "OBJECT<k: VARIANT, who: VARIANT>"
