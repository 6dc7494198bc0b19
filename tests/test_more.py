"""Small additions: numbers of equal rows, dialog prompts, united sources, vectors of their own table, tools from SQL."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarnflow.functions import prompts, tools
from tarnflow.operators import retrieve
from tarnflow.operators.knowledge import KnowledgeBase
from tarnflow.operators.numbering import numbered
from tarnflow.sources import corpus


def test_rows_of_one_key_are_several_ranges(spark):
    """A third of all rows with one key, equal rows, and a column without a hash of its own."""
    df = spark.range(0, 3000, numPartitions=6).select((F.col("id") % 3 * F.col("id")).alias("key"), (F.col("id") % 500).alias("x"), F.create_map(F.lit("k"), F.col("id") % 7).alias("m"))
    got = numbered(df, "key")
    assert sorted(r["n"] for r in got.collect()) == list(range(3000))
    rows = got.where("key = 0").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(len(rows))) and len(rows) >= 1000
    dealt = df.repartitionByRange(4, "key", F.xxhash64("x")).where("key = 0")
    assert dealt.select(F.spark_partition_id()).distinct().count() > 1


def test_dialog_prompt(spark):
    row = spark.createDataFrame([("q", "h", "李工", None), ("q", None, " ", "王工")], "q string, h string, u string, a string")
    got = [r[0] for r in row.select(prompts.dialog(*map(F.col, "qhua"))).collect()]
    assert got[0] == "你是友好的AI助手，名字叫助手。\n\n对话历史：\nh\n\n用户说：q\n\n用户的名字可能是李工。\n\n请直接回答用户，不要思考标记。"
    assert got[1].startswith("你是友好的AI助手，名字叫王工。\n\n对话历史：\n\n\n") and "可能是用户。" in got[1]


def test_sources_and_catalog(spark):
    a = spark.createDataFrame([("x", None), (None, "高")], "content string, priority string")
    b = spark.createDataFrame([("y", "甲苯", 1)], "content string, chemical_type string, other int")
    rows = {(r["origin"], r["content"], r["priority"], r["chemical_type"]) for r in corpus.united(a=a, b=b).collect()}
    assert rows == {("a", "x", "中", "通用"), ("b", "y", "中", "甲苯")}
    assert corpus.reachable(spark) and not corpus.reachable(spark, "not_there")
    kb = KnowledgeBase(spark).add_regulations(spark.createDataFrame([("b", "国标", "高", None), ("a", "国标", "高", "甲苯")], "content string, regulation_type string, priority string, chemical_type string"))
    assert [(r["doc_id"], r["chemical_type"]) for r in kb.docs.orderBy("doc_id").collect()] == [(0, "甲苯"), (1, "通用")]


@pytest.mark.parametrize("mode", ["vector", "hybrid", "bm25"])
def test_vectors_of_their_own_table(spark, mode):
    """The same as with vectors beside the texts; those without a document never surface."""
    docs = spark.createDataFrame([(i, f"消防 {i} 通道" if i % 2 else f"储罐 {i}") for i in range(30)], "doc_id long, content string")
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(0, 60, 2)], "doc_id long, embedding array<float>")
    beside = retrieve.search(docs.join(vectors, "doc_id", "left"), "消防通道", [1.0, 0.5, 2.0], 6, mode)
    apart = retrieve.search(docs, "消防通道", [1.0, 0.5, 2.0], 6, mode, vectors=vectors)
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, beside.collect()))


def test_tools_from_sql_are_those_of_the_library(spark):
    tools.register(spark)
    body = '{"webPages": {"value": [{"name": "a", "url": "u"}, {"snippet": "s"}, {}, {"name": "fourth"}]}}'
    rows = spark.createDataFrame([(body, 205, datetime(2024, 1, 2, 3, 4, 5), "1 + 2 * 3"), (None, None, None, None)], "body string, value int, at timestamp, x string")
    sql = rows.selectExpr("WebSearch(body)", "GetSpindleTemperature(value)", "GetCurrentTime(at)", "Calculate(x)").collect()
    own = rows.select(tools.web_results(F.col("body")), tools.reading(F.col("value")), tools.current_time(F.col("at")), tools.calculate("x")).collect()
    assert list(map(tuple, sql)) == list(map(tuple, own))
