import pytest
from pyspark.sql import functions as F

from tarnflow import schema
from tarnflow.operators import index, rerank, retrieve
from tarnflow.operators.knowledge import KnowledgeBase

#: Goldens of the corpus: (content, regulation_type, priority, chemical_type).
CORPUS = [
    (0, "危化品储罐之间的安全距离不小于10米。", "国标", "高", "甲苯", "a.txt"),
    (1, "消防通道应保持畅通，宽度不小于4米。", "园区规则", "中", "通用", "b.txt"),
    (2, "员工食堂菜单", "历史案例", "低", None, "c.txt"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, schema.DOCUMENT)


def hits(df):
    return [(r["doc_id"], round(r["score"], 6)) for r in df.orderBy("rank").collect()]


def test_bm25_goldens(docs):
    assert hits(retrieve.bm25(docs, "危化品储罐之间的安全距离是多少？")) == [(0, 19.489480)]
    assert hits(retrieve.bm25(docs, "消防通道有什么要求？")) == [(1, 6.715609)]
    assert hits(retrieve.bm25(docs, "  ")) == []
    stats = index.corpus_stats(docs).first()
    assert stats["n_docs"] == 3 and stats["avg_doc_len"] == pytest.approx(26.666667)


@pytest.mark.parametrize("query", ["消防通道有什么要求？", "距离 10米", "不 不 不小于", "a_b", "食堂，菜单"])
def test_scores_read_off_the_text_equal_those_of_postings(docs, query):
    direct = {r["doc_id"]: r["score"] for r in retrieve.bm25_scores(docs, query).collect()}
    posted = {r["doc_id"]: r["score"] for r in retrieve.bm25_indexed(index.postings(docs), index.doc_stats(docs), query).collect()}
    assert direct == pytest.approx(posted)


def test_written_index(docs, spark, tmp_path):
    index.write(docs, str(tmp_path / "index"), buckets=3)
    rows = retrieve.bm25_indexed(spark.read.parquet(f"{tmp_path}/index/postings"), spark.read.parquet(f"{tmp_path}/index/lengths"), "消防通道有什么要求？").collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in rows] == [(1, 6.715609)]


@pytest.mark.parametrize("chemical, regulation, want", [("甲苯", None, [0, 1, 2]), ("甲醇", None, [1, 2]), (None, "国标", [0]), ("甲醇", "国标", []), (None, None, [0, 1, 2])])
def test_metadata_filter(docs, chemical, regulation, want):
    assert sorted(r["doc_id"] for r in docs.where(rerank.passes(chemical, regulation)).collect()) == want


def test_bonus(docs):
    level = {r["doc_id"]: r["b"] for r in docs.select("doc_id", rerank.bonus(rerank.PRIORITY_BY_LEVEL).alias("b")).collect()}
    by_type = {r["doc_id"]: r["b"] for r in docs.select("doc_id", rerank.bonus(rerank.PRIORITY_BY_TYPE).alias("b")).collect()}
    assert level == {0: 3150, 1: 2050, 2: 1000} and by_type == {0: 150, 1: 50, 2: 0}


def test_rerank_keeps_score_and_rank(docs):
    scored = docs.withColumn("score", F.lit(10.0) - F.col("doc_id"))
    got = rerank.regulations(scored, 2, regulation="园区规则").collect()
    assert [(r["doc_id"], r["score"], r["rank"], r["position"]) for r in got] == [(1, 9.0, 1, 0)]
    assert [r["doc_id"] for r in rerank.simple(scored, 3, rerank.PRIORITY_BY_LEVEL).orderBy("position").collect()] == [0, 1, 2]


def test_filter_stands_above_the_limit(spark):
    rows = [(i, f"x{i}", "国标" if i >= 4 else "园区规则", "高", None, None) for i in range(8)]
    scored = spark.createDataFrame(rows, schema.DOCUMENT).withColumn("score", F.lit(10.0) - F.col("doc_id"))
    assert rerank.regulations(scored, 2, regulation="国标").count() == 0


def ranked(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, content string, score double, rank int")


def test_hybrid_merge(spark):
    b, v = ranked(spark, [(1, "k1", 4.0, 0), (2, "k2", 2.0, 1)]), ranked(spark, [(2, "k2", 0.9, 0), (3, "k3", 0.8, 1)])
    got = retrieve.merge(b, v, 5).orderBy("rank").collect()
    assert [(r["content"], round(r["score"], 6), r["rank"], r["method"]) for r in got] == [("k1", 2.0, 0, "Hybrid"), ("k2", 1.45, 1, "Hybrid"), ("k3", 0.4, 2, "Hybrid")]
    twice = ranked(spark, [(1, "k", 5.0, 0), (2, "k", 3.0, 1)])
    assert [(r["doc_id"], r["score"]) for r in retrieve.merge(twice, ranked(spark, []), 5, (1.0, 1.0)).collect()] == [(2, 3.0)]
    long = "y" * 100
    assert retrieve.merge(ranked(spark, [(1, long + "a", 1.0, 0)]), ranked(spark, [(2, long + "b", 1.0, 0)]), 5).count() == 1


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [2.0, 0.0])], "doc_id long, embedding array<float>")
    got = retrieve.vector(df, [1.0, 0.0], 5).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [0, 4, 1, 3] and got[0]["score"] == pytest.approx(1.0)


def test_search_modes(docs):
    df = docs.withColumn("embedding", F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float")))
    query = "消防通道有什么要求？"
    assert {r["method"] for r in retrieve.search(df, query, None, 3, "bm25").collect()} == {"BM25"}
    assert {r["method"] for r in retrieve.search(df, query, [0.0, 1.0], 3, "VECTOR").collect()} == {"Vector"}
    both = retrieve.search(df, query, None, 3, "anything").collect()
    assert [(r["doc_id"], round(r["score"], 6), r["method"]) for r in both] == [(1, 6.715609, "Hybrid")]


def test_keywords(docs):
    found = retrieve.keyword_top(docs, "安全距离", ("安全距离", "菜单"), ("菜单",)).collect()
    assert [(r["doc_id"], r["hits"]) for r in found] == [(0, 1)]
    assert [r["doc_id"] for r in retrieve.keyword_top(docs, "?", ("x",), ("y",)).orderBy("doc_id").collect()] == [0, 1, 2]


def test_knowledge_base(spark, tmp_path):
    kb = KnowledgeBase(spark).add_texts([r[1] for r in CORPUS])
    kb.add_regulation("甲醇应单独存放。", "国标", "高")
    assert kb.count() == 4
    top = kb.retrieve("消防通道有什么要求？").first()
    assert top["content"] == CORPUS[1][1] and top["retrieval_method"] == "BM25" and top["metadata"] == {} and top["shown"].startswith("[")
    assert kb.retrieve("甲醇").first()["metadata"] == {"regulation_type": "国标", "priority": "高", "chemical_type": "通用"}
    assert sorted(r["doc_id"] for r in kb.docs.collect()) == [0, 1, 2, 3]
    folder = tmp_path / "国标"
    folder.mkdir()
    (folder / "甲苯储存规范.txt").write_text("甲苯储罐。\n" + "长" * 600, encoding="utf-8")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.txt").write_text("nothing", encoding="utf-8")
    kb.clear().load(str(tmp_path))
    assert [r["content"][:3] for r in kb.docs.orderBy("doc_id").collect()] == ["甲苯储", "长长长"]
    kb.clear().load(str(tmp_path), limit=None)
    assert [(r["chemical_type"], r["priority"]) for r in kb.docs.collect()] == [("甲苯", "高")]
    assert kb.regulations("甲苯储罐", chemical="甲苯").count() == 1
