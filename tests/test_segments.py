import random
import shutil

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tarnflow.functions import tokens
from tarnflow.operators import retrieve
from tarnflow.operators.segments import SegmentedIndex

SCHEMA = "doc_id long, content string, term string, at long"


def texts(seed, ids):
    rng = random.Random(seed)
    return {i: " ".join("".join(rng.choices("abcd漢", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 20))) for i in ids}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, None, None) for i, t in docs.items()], SCHEMA)


def scores(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


def check(spark, held, docs, query="abc da 漢 zz"):
    built_anew = scores(retrieve.bm25_scores(frame(spark, docs), query))
    assert scores(held.scores(query)) == pytest.approx(built_anew)
    assert sorted(r["doc_id"] for r in held.documents().collect()) == sorted(docs)


def test_same_as_an_index_built_anew(spark, tmp_path):
    held, docs = SegmentedIndex.create(spark, str(tmp_path / "i"), fan=3), {}
    assert scores(held.scores("abc")) == {}
    for k in range(3):
        new = texts(k, range(k * 40, k * 40 + 40))
        assert held.insert(frame(spark, new)) == 40
        docs |= new
    check(spark, held, docs)
    gone = [3, 5, 50, 119, 9999]
    assert held.delete(spark.createDataFrame([(i,) for i in [*gone, 3, None]], "doc_id long")) == 4
    docs = {i: t for i, t in docs.items() if i not in gone}
    check(spark, held, docs)
    assert held.delete(spark.createDataFrame([(3,), (9999,)], "doc_id long")) == 0  # they aren't there any more
    again = texts(9, [3, 200])  # a deleted id comes back
    held.insert(frame(spark, again))
    docs |= again
    check(spark, held, docs)
    assert held.merge() >= 1
    check(spark, held, docs)
    held.delete(spark.createDataFrame([(200,), (0,)], "doc_id long"))
    docs = {i: t for i, t in docs.items() if i not in (0, 200)}
    check(spark, held, docs)
    held.merge(every=True)
    assert [s.kind for s in held.state()[1]] == ["rows"]  # the tombstones are settled
    check(spark, held, docs)
    assert SegmentedIndex(spark, str(tmp_path / "i")).state() == held.state()


def test_an_insert_reads_its_own_rows_only(spark, tmp_path):
    held = SegmentedIndex.create(spark, str(tmp_path / "i"))
    held.insert(frame(spark, texts(1, range(30))))
    (old,) = held.state()[1]
    shutil.move(str(tmp_path / "i" / old.name), str(tmp_path / "away"))
    held.insert(frame(spark, texts(2, range(30, 60))))
    shutil.move(str(tmp_path / "away"), str(tmp_path / "i" / old.name))
    check(spark, held, texts(1, range(30)) | texts(2, range(30, 60)))


def test_a_search_reads_the_terms_of_the_query_only(spark, tmp_path):
    held = SegmentedIndex.create(spark, str(tmp_path / "i"))
    held.insert(frame(spark, texts(1, range(30))))
    plan = held.scores("abc")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan


def test_versions(spark, tmp_path):
    """A second writer of one version fails; what failed before its manifest isn't part of the index; readers go on."""
    held = SegmentedIndex.create(spark, str(tmp_path / "i"))
    docs = texts(1, range(20))
    held.insert(frame(spark, docs))
    version, parts = held.state()
    with pytest.raises(PySparkException):
        held._commit(version, parts)
    raising = frame(spark, texts(2, range(20, 40))).withColumn("content", F.when(F.col("doc_id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(PySparkException):
        held.insert(raising)
    check(spark, held, docs)
    reader = held.scores("abc da")
    before = scores(reader)
    held.delete(spark.createDataFrame([(i,) for i in range(10)], "doc_id long"))
    held.merge(every=True)
    assert scores(reader) == before


def test_defined_cases(spark, tmp_path):
    held = SegmentedIndex.create(spark, str(tmp_path / "i"))
    assert held.insert(frame(spark, {}).limit(0)) == 0 and held.state() == (0, [])
    assert held.insert(frame(spark, {1: None, 2: "", 3: "ab " * 5000, None: "ab"})) == 3
    check(spark, held, {1: None, 2: "", 3: "ab " * 5000}, "ab")
    assert held.merge(every=True) == 0
    assert held.delete(spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")) == 3
    assert scores(held.scores("ab")) == {}


def test_a_merge_takes_what_the_next_would(spark, tmp_path):
    """Before, the first two segments were merged and written, and then again with the third."""
    held, docs = SegmentedIndex.create(spark, str(tmp_path / "i"), fan=2), {}
    for k in range(3):
        new = texts(k, range(k * 50, k * 50 + 30 + 10 * k))
        held.insert(frame(spark, new))
        docs |= new
    assert held.merge() == 1 and len(held.state()[1]) == 1
    assert len(list((tmp_path / "i").glob("segment-*"))) == 4
    check(spark, held, docs)


def test_a_document_stands_in_one_file(spark, tmp_path):
    """So postings are sorted where they are; before, they were dealt by term, which shuffled every one of them."""
    held = SegmentedIndex.create(spark, str(tmp_path / "i"))
    docs = texts(3, range(60)) | {7: "aa b漢 c a A", 8: ""}
    assert held.insert(frame(spark, docs).repartition(3, "doc_id")) == 60
    (made,) = held.state()[1]
    at = spark.read.parquet(f"{tmp_path}/i/{made.name}/postings").withColumn("file", F.input_file_name())
    assert at.select("file").distinct().count() > 1
    assert at.groupBy("doc_id").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0
    rows = [(r["file"], r["term"].encode(), r["doc_id"]) for r in at.collect()]
    for f in {x[0] for x in rows}:
        assert [x[1:] for x in rows if x[0] == f] == sorted(x[1:] for x in rows if x[0] == f)


def test_texts_of_ids_that_come_once_are_not_shuffled(spark, tmp_path):
    docs = frame(spark, texts(4, range(20))).select("doc_id", "content")
    plan = SegmentedIndex._texts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    again = docs.union(spark.createDataFrame([(3, "zz abc"), (3, None), (77, "zz")], "doc_id long, content string"))
    found = {r["key"]: sorted(r["texts"]) for r in SegmentedIndex._texts(again).collect()}
    want = {r["doc_id"]: [r["content"]] for r in docs.collect()} | {77: ["zz"]}
    want[3] = sorted([*want[3], "zz abc", ""])
    assert found == want


def test_large_blocks_stay_as_they_are_on_a_merge(spark, tmp_path, monkeypatch):
    held, docs = SegmentedIndex.create(spark, str(tmp_path / "i"), fan=2), texts(1, range(60)) | {7: "abc " * 2000}
    held.insert(frame(spark, {i: t for i, t in docs.items() if i < 30}))
    held.insert(frame(spark, {i: t for i, t in docs.items() if i >= 30}))
    gone = [0, 7, 31]
    held.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    docs = {i: t for i, t in docs.items() if i not in gone}
    monkeypatch.setattr(tokens, "BLOCK", 2)
    assert held.merge() == 1
    check(spark, held, docs)
    (made,) = held.state()[1]
    forward = spark.read.parquet(f"{tmp_path}/i/{made.name}/forward").select(F.sum(F.size("terms"))).first()[0]
    assert made.width == forward == spark.read.parquet(f"{tmp_path}/i/{made.name}/postings").count()
