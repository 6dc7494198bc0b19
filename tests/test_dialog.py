from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnflow import schema
from tarnflow.operators import audit, dialog
from tarnflow.sources import corpus
from tarnflow.streaming import logs


T0 = datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def turns(spark):
    rows = [("a", i, "user" if i % 2 == 0 else "assistant", f"1. t{i}", T0 + timedelta(minutes=i)) for i in range(12)] + [("b", 0, "user", "我叫李工，你叫王工", T0), ("b", 1, "assistant", "温度 205.5 ℃，阈值≤ 180℃", T0), ("b", 2, "user", "我是谁？", T0)]
    return spark.createDataFrame(rows, schema.TURN)


def test_turns_of_unknown_sessions_are_dropped(spark, turns):
    sessions = spark.createDataFrame([("a", "General", T0, T0)], schema.SESSION)
    new = spark.createDataFrame([("a", 12, "user", "1. x", T0), ("z", 0, "user", "y", T0)], schema.TURN)
    got = dialog.append(turns, new, sessions)
    assert got.count() == turns.count() + 1 and got.where("turn = 12").first()["content"] == "x"


def test_history(turns):
    got = {r["session_id"]: r["summary"] for r in dialog.context(turns, 3).collect()}
    assert got["a"] == "【对话上下文】\nassistant: t9\nuser: t10\nassistant: t11"
    shown = {r["session_id"]: r["history"] for r in dialog.history(turns, 2).collect()}["a"]
    assert shown.startswith("【对话历史记录】\n👤 用户 [12:10:00]\nt10\n") and "🤖 助手 [12:11:00]" in shown
    assert {r["session_id"]: r["n_turns"] for r in dialog.count(turns).collect()} == {"a": 12, "b": 3}


def test_expiry_is_strict(spark):
    rows = [("x", "General", T0, T0), ("y", "General", T0, T0 - timedelta(seconds=1))]
    got = dialog.expired(spark.createDataFrame(rows, schema.SESSION), F.lit(T0 + timedelta(seconds=60)), 60).collect()
    assert [r["session_id"] for r in got] == ["y"]


def test_upsert_and_clear(spark, turns):
    old = spark.createDataFrame([("x", "A", T0, T0), ("y", "A", T0, T0)], schema.SESSION)
    new = spark.createDataFrame([("x", "B", T0, T0), ("z", "B", T0, T0), ("y", "B", T0, T0 - timedelta(1))], schema.SESSION)
    assert {r["session_id"]: r["session_type"] for r in dialog.upsert(old, new).collect()} == {"x": "B", "y": "A", "z": "B"}
    assert {r["session_id"] for r in dialog.clear(turns, spark.createDataFrame([("a",)], "session_id string")).collect()} == {"b"}


def test_facts_and_answers(spark, turns):
    b = turns.where("session_id = 'b'")
    before = dialog.facts(b.where("turn < 2"))
    questions = spark.createDataFrame([("b", "我是谁？"), ("b", "刚才温度多少"), ("b", "阈值"), ("c", "我是谁？")], "session_id string, content string")
    got = {(r["session_id"], r["content"]): r["answer"] for r in dialog.answers(questions, before).collect()}
    assert got["b", "我是谁？"] == "你叫 李工，我叫 王工！"
    assert got["b", "刚才温度多少"].startswith("你好！之前检查的温度是 205.5 ℃") and got["b", "阈值"] == "安全阈值是  205.5 ℃。"  # the first value of the response, as it stands
    assert got["c", "我是谁？"] is None
    # The question itself is read for facts after it was answered, and takes the name's place.
    assert {r["key"]: r["value"] for r in dialog.latest(dialog.facts(b)).collect()}["user_name"] == "谁？"


def said(spark, *contents):
    """A session of these turns, users first, by turns."""
    return spark.createDataFrame([("s", i, "assistant" if i % 2 else "user", c, T0) for i, c in enumerate(contents)], schema.TURN)


def test_asking_for_the_name_replaces_it(spark):
    """A question is answered from what stood before it, and only then read for facts."""
    turns = said(spark, "我是谁？", "不知道", "你好，我叫李工，你叫王工", "你好", "我是谁？", "你叫 李工，我叫 王工！", "我是谁？", "-", "我叫李工程师", "-", "我叫什么名字")
    got = {r["turn"]: r["answer"] for r in dialog.dialogue(turns).collect()}
    # What names itself also asks: 我叫 and 你叫 are in the words that do.
    assert got == {0: None, 2: "你叫 谁？！", 4: "你叫 李工，我叫 王工！", 6: "你叫 谁？，我叫 王工！", 8: "你叫 谁？，我叫 王工！", 10: "你叫 李工程师，我叫 王工！"}


@pytest.mark.parametrize("span", [4096, 3])
def test_facts_as_of_a_turn(spark, span):
    """Spans of a long session carry on; ties, null turns, repeated questions, sessions without a fact."""
    found = spark.createDataFrame([("a", "user_name", "one", 1), ("a", "user_name", "two", 5), ("a", "主轴温度", "9 ℃", 20), ("a", "user_name", "x", None), ("b", "安全阈值", "1℃", 2), ("b", "安全阈值", "2℃", 2)], "session_id string, key string, value string, turn long")
    asked = [("a", t, "q") for t in (0, 1, 2, 5, 9, 20, 21, 100)] + [("a", 9, "q"), ("a", None, "q"), ("b", 2, "q"), ("b", 3, "q"), ("c", 1, "q")]
    rows = dialog.known(spark.createDataFrame(asked, "session_id string, turn long, content string"), found, span).collect()
    got = sorted(((r["session_id"], -1 if r["turn"] is None else r["turn"], r["user_name"], r["主轴温度"], r["安全阈值"]) for r in rows), key=repr)
    name = {0: None, 1: None, 2: "one", 5: "one", 9: "two", 20: "two", 21: "two", 100: "two", None: None}
    want = [("a", -1 if t is None else t, name[t], "9 ℃" if t in (21, 100) else None, None) for s, t, _ in asked if s == "a"]
    assert got == sorted([*want, ("b", 2, None, None, None), ("b", 3, None, None, "2℃"), ("c", 1, None, None, None)], key=repr)


def log(spark):
    rows = [(1, "u", "op", "d1", False, T0), (2, "u", "op", "d2", True, T0 + timedelta(hours=1)), (3, "v", "op", "d3", True, T0 + timedelta(hours=1)), (4, "u", "op", "d4", True, T0 + timedelta(days=2))]
    return spark.createDataFrame(rows, schema.AUDIT)


def test_audit_bounds_are_included(spark):
    found = audit.find(log(spark), T0, T0 + timedelta(hours=1)).collect()
    assert [r["id"] for r in found] == [2, 3, 1]
    assert [r["id"] for r in audit.find(log(spark), user="u").collect()] == [4, 2, 1]
    assert [r["id"] for r in audit.find(log(spark), start=T0 + timedelta(days=1)).collect()] == [4]


def test_audit_append_and_report(spark):
    new = spark.createDataFrame([(1, "w", "op", "x", True), (2, "w", "op", "y", True)], "seq long, user_id string, operation string, details string, is_sensitive boolean")
    grown = audit.append(log(spark), new, F.lit(T0 + timedelta(days=3)))
    assert sorted(r["id"] for r in grown.collect()) == [1, 2, 3, 4, 5, 6]
    got = {r["day"]: r for r in audit.report(grown, T0, T0 + timedelta(days=9)).collect()}
    assert got["2024-01-01"]["n"] == 3 and got["2024-01-01"]["report"].split("\n")[:2] == ["[2024-01-01 13:00:00] 用户:u 操作:op", "  详情: d2"]
    assert audit.header(grown, T0, T0).first()["line"].endswith("记录总数: 1")
    assert audit.retained(grown, F.lit(T0 + timedelta(days=182)), 180).count() == 3


def test_connectors_and_tables(spark):
    for kind in ("warehouse", "ehs"):
        assert corpus.connector(spark, kind).count() == 0
    spark.sql("CREATE DATABASE IF NOT EXISTS kb")
    corpus.create_tables(spark, "kb")
    assert {r["tableName"] for r in spark.sql("SHOW TABLES IN kb").collect()} >= {"chemical_documents", "sessions", "audit_logs", "search_logs"}
    assert corpus.catalog_info(spark).first()["database"] == "default"
    spark.sql("DROP DATABASE kb CASCADE")


def test_thresholds_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("m,a,b\nX1,180,200\nbad,1\n", encoding="utf-8")
    assert [r["content"] for r in corpus.thresholds(spark, str(tmp_path / "t.csv")).collect()] == ["型号X1：安全阈值180，异常阈值200"]


def test_streams(spark, tmp_path):
    facts = "session_id string, key string, value string, turn long"
    for k, rows in enumerate(([("s", "n", "a", 1), ("s", "n", "b", 3)], [("s", "n", "old", 2), ("t", "n", "c", 1)], [("s", "n", "d", 4)])):
        spark.createDataFrame(rows, facts).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    changes = logs.latest_facts(logs.read(spark, str(tmp_path / "in"), facts, per_trigger=1))
    logs.append(changes, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = dialog.latest(spark.read.schema(changes.schema).parquet(str(tmp_path / "out"))).collect()
    assert {(r["session_id"], r["value"]) for r in got} == {("s", "d"), ("t", "c")}
    # A second run with the same state adds nothing.
    before = spark.read.parquet(str(tmp_path / "out")).count()
    logs.append(logs.latest_facts(logs.read(spark, str(tmp_path / "in"), facts, per_trigger=1)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == before


def test_session_windows(spark, tmp_path):
    rows = [("u", T0), ("u", T0 + timedelta(minutes=10)), ("u", T0 + timedelta(hours=2)), ("v", T0 + timedelta(days=1))]
    spark.createDataFrame(rows, "user string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = logs.sessions(logs.read(spark, str(tmp_path / "in"), "user string, ts timestamp"), "user", "ts")
    logs.append(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [(r["user"], r["n"]) for r in got] == [("u", 2), ("u", 1)]
