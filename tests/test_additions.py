"""Numbering, sinks, connectors, prompts and counts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarnflow import schema
from tarnflow.functions import prompts, text, tools
from tarnflow.operators import audit, compliance, dialog
from tarnflow.operators.numbering import numbered
from tarnflow.sources import corpus

T0 = datetime(2024, 1, 1, 12)


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(0, 500, numPartitions=7).select(((F.col("id") * 7919) % 503).alias("x"))
    got = numbered(df, F.col("x").desc()).collect()
    assert [r["n"] for r in sorted(got, key=lambda r: -r["x"])] == list(range(500))
    assert numbered(df.limit(0), "x").count() == 0


def test_report_rows_are_bounded(spark):
    rows = [(i, "u", "op", f"d{i}", False, T0) for i in range(25)]
    got = audit.report(spark.createDataFrame(rows, schema.AUDIT), T0, T0, per_row=10).orderBy("block").collect()
    assert [r["n"] for r in got] == [10, 10, 5]
    assert [x for r in got for x in r["report"].split("\n")[1::2]] == [f"  详情: d{i}" for i in range(25)]


def test_pass_rate(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "passed boolean")
    assert tuple(audit.pass_rate(df).first()) == (3, 1, 33.3)
    assert tuple(audit.pass_rate(df.limit(0)).first()) == (0, 0, None)


def test_clear_history_marks_the_session(spark):
    sessions = spark.createDataFrame([("a", "General", T0, T0), ("b", "General", T0, T0)], schema.SESSION)
    turns = spark.createDataFrame([("a", 0, "user", "x", T0), ("b", 0, "user", "y", T0)], schema.TURN)
    later = datetime(2024, 2, 1)
    left, marked = dialog.clear_history(turns, sessions, sessions.where("session_id = 'a'"), F.lit(later))
    assert [r["session_id"] for r in left.collect()] == ["b"]
    assert {r["session_id"]: r["last_updated"] for r in marked.collect()} == {"a": later, "b": T0}


def test_sink_fills_in_defaults(spark, tmp_path):
    df = spark.createDataFrame([("one", None), ("two", "国标")], "content string, regulation_type string")
    for _ in range(2):
        corpus.write_documents(df, str(tmp_path / "t"), F.lit(T0), embed=lambda c: F.array(F.length(c).cast("float")))
    got = spark.read.parquet(str(tmp_path / "t")).orderBy("content").collect()
    assert len(got) == 4 and got[0][1:5] == ("通用", "中", "通用", None) and got[3]["regulation_type"] == "国标" and got[0]["embedding"] == [3.0]


def test_connectors_filter_where_asked(spark):
    w = spark.createDataFrame([("甲苯",), ("乙醇",), (None,)], "chemical_name string")
    assert corpus.warehouse(w).count() == 3 and corpus.warehouse(w, "甲苯").count() == 1
    t = spark.createDataFrame([(True,), (False,), (None,)], "is_completed boolean")
    assert corpus.tickets(t).count() == 3 and corpus.tickets(t, False).count() == 1


def test_knowledge_and_threshold_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("m,a,b\nX1,180,200,9\nbad,1\nX2,,3\n", encoding="utf-8")
    assert [r["content"] for r in corpus.thresholds(spark, str(tmp_path / "t.csv")).collect()] == ["型号X1：安全阈值180，异常阈值200", "型号X2：安全阈值，异常阈值3"]
    got = corpus.knowledge(spark.createDataFrame([("案例1 a\n案例2 b",)], "text string"), spark.createDataFrame([("X,1,2",), ("no",)], "line string"))
    assert sorted(r["content"] for r in got.collect()) == ["型号X：安全阈值1，异常阈值2", "案例1 a", "案例2 b"]


def test_unreadable_files_are_left_out(spark, tmp_path):
    for name in ("国标", "园区规则"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.txt").write_text("text", encoding="utf-8")
    docs = corpus.files(spark, str(tmp_path))
    (tmp_path / "国标" / "a.txt").unlink()  # gone after it was listed
    assert [r["regulation_type"] for r in docs.collect()] == ["园区规则"]


def test_prompts(spark):
    row = spark.createDataFrame([("q", ["r1", "r2"], [])], "q string, r array<string>, none array<string>").select(prompts.outline(F.col("q"), F.col("none")), prompts.outline(F.col("q"), F.col("r")), prompts.compliance(F.col("q"), F.col("r"))).first()
    assert "二、" not in row[0] and "  2.1 r1\n  2.2 r2\n三、" in row[1] and row[1].endswith("整改建议\n")
    assert "参考法规:\n1. r1\n2. r2\n\n用户巡检内容:\nq\n\n" in row[2]


def test_compliance_check(spark):
    docs = spark.createDataFrame([(0, "储罐 间距"), (1, "消防 通道"), (2, "无关")], "doc_id long, content string")
    checked = compliance.check(docs, "消防通道", k=1, model=lambda p: "合规" if "消防 通道" in p else "?")
    log = compliance.recorded(spark.createDataFrame([], schema.AUDIT), checked, F.lit(T0)).collect()
    assert checked.first()["conclusion"] == "合规" and log[0]["details"] == "巡检内容: 消防通道..." and log[0]["is_sensitive"]


def test_tools_in_sql(spark):
    tools.register(spark)
    got = spark.sql("""SELECT GetSpindleTemperature(200) a, GetTemperatureThreshold() b, GetCurrentTime(TIMESTAMP '2024-01-02 03:04:05') c, Calculate('1+2') d,
        WebSearch('{"webPages": {"value": [{"name": "n", "snippet": "s"}]}}') e""").first()
    assert tuple(got) == ("主轴实时温度：200℃", tools.THRESHOLD, "2024年01月02日 03:04:05", 3.0, "【1】n\n摘要：s\n来源：\n\n")
    assert spark.range(1).select(tools.search_url(F.lit("a b*~+/"))).first()[0].split("q=")[1].startswith("a%20b%2A~%2B%2F&")


@pytest.mark.parametrize("x", ["aaa aa a", "aAa　aa", "a.aa-aaa", ""])
def test_pairs_of_one_character_overlap(spark, x):
    df = spark.createDataFrame([(x,)], "x string")
    n, length, tokens = df.select(text.spaced_count(text.spaced(F.col("x")), "aa"), text.spaced_len(text.spaced(F.col("x"))), text.tokenize(F.col("x"))).first()
    assert n == tokens.count("aa") and length == len(tokens)
