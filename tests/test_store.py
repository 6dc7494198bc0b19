from datetime import datetime, timedelta

import pytest

from tarnflow.streaming import journal, logs, store

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def op(session, kind, seq, minute, content=None, key=None):
    return session, kind, seq, None if minute is None else at(minute), "user", content, key


#: In the order of time; the index is where batches may be cut.
OPERATIONS = [
    op("a", "upsert", 1, 0, "General"), op("a", "turn", 2, 5, "1. x"), op("b", "turn", 3, 6, "lost"), op("a", "data", 4, 10, "v", "k"), op("a", "data", 5, 12, "w", "k"),
    op("a", "turn", 6, 42, "exactly the timeout"), op("a", "clear_dialog_history", 7, 60), op("c", "upsert", 8, 61, "G"), op("a", "turn", 9, 73, "too late"),
    op("c", "turn", 10, 70, "x"), op("c", "clear_history", 11, 90), op("c", "turn", 12, 110, "y"), op("a", "upsert", 13, 111, "Again"), op("c", "upsert", 14, 112, "Changed"),
    op(None, "upsert", 15, 112, "no session"), op("d", "upsert", 16, None, "no time"), op("e", "upsert", 17, 120, None), op("f", "unknown", 18, 120), op("e", "unknown", 19, 121),
]
WANT = {
    ("a", at(0), at(42), "General", 0, 1, "evicted"),  # 30 minutes idle is kept, more isn't; the clear leaves the time as it is
    ("a", at(111), at(111), "Again", 0, 0, "live"),
    ("c", at(61), at(112), "Changed", 1, 0, "live"),
    ("e", at(120), at(120), None, 0, 0, "live"),
}


@pytest.mark.parametrize("cuts", [[], [4], [2, 6, 9, 12]])
def test_sessions(spark, tmp_path, cuts):
    """The same sessions however the stream is cut into batches; each batch is a run of its own, from the checkpoint."""
    bounds = [0, *cuts, len(OPERATIONS)]
    for a, b in zip(bounds, bounds[1:]):
        spark.createDataFrame(OPERATIONS[a:b], store.OPERATION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = logs.read(spark, str(tmp_path / "in"), store.OPERATION)
        store.run(stream, str(tmp_path / "log"), str(tmp_path / "state"), 1800, late="1 hour").awaitTermination()
    got = {tuple(r)[:7] for r in store.sessions(spark, str(tmp_path / "log")).collect()}
    assert got == WANT
    before = spark.read.parquet(str(tmp_path / "log")).count()
    store.run(stream, str(tmp_path / "log"), str(tmp_path / "state"), 1800, late="1 hour").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == before  # nothing new


def test_timers_evict_without_another_operation(spark, tmp_path):
    rows = [op("x", "upsert", 1, 0, "G"), op("y", "upsert", 2, 200, "G")]
    spark.createDataFrame(rows, store.OPERATION).coalesce(1).write.parquet(str(tmp_path / "in"))
    store.run(logs.read(spark, str(tmp_path / "in"), store.OPERATION), str(tmp_path / "log"), str(tmp_path / "state"), 1800).awaitTermination()
    assert {(r["session_id"], r["status"]) for r in store.sessions(spark, str(tmp_path / "log")).collect()} == {("x", "evicted"), ("y", "live")}


RECORD = "user_id string, seq long"


def numbers(spark, path):
    return sorted((r["id"], r["user_id"]) for r in journal.Journal(spark, path).read(RECORD).collect())


def test_journal_under_retries(spark, tmp_path):
    """A run that dies after a batch was entered and before its checkpoint: the batch comes again and adds nothing."""
    paths = str(tmp_path / "log"), str(tmp_path / "state")
    source = str(tmp_path / "in")
    spark.createDataFrame([("u", 2), ("v", 1), ("u", 3)], RECORD).coalesce(1).write.parquet(source)

    def die(batch):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        journal.append(logs.read(spark, source, RECORD), *paths, "seq", after=die).awaitTermination()
    assert numbers(spark, paths[0]) == [(1, "v"), (2, "u"), (3, "u")]
    journal.append(logs.read(spark, source, RECORD), *paths, "seq").awaitTermination()
    assert numbers(spark, paths[0]) == [(1, "v"), (2, "u"), (3, "u")]
    spark.createDataFrame([("w", 9)] * 2, RECORD).coalesce(1).write.mode("append").parquet(source)
    journal.append(logs.read(spark, source, RECORD), *paths, "seq").awaitTermination()
    assert numbers(spark, paths[0]) == [(1, "v"), (2, "u"), (3, "u"), (4, "w"), (5, "w")]


def test_journal_passes_over_what_was_never_entered(spark, tmp_path):
    held = journal.Journal(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([("u", 1), ("v", 2)], RECORD)
    assert held.write(rows, 0, "seq") == 2
    rows.selectExpr("*", "100 + seq AS id").write.parquet(str(tmp_path / "log/rows/batch=1"))  # died before its entry
    assert numbers(spark, str(tmp_path / "log")) == [(1, "u"), (2, "v")]
    assert held.write(rows.limit(1), 1, "seq") == 1 and held.write(rows, 1, "seq") == 0
    assert held.write(rows.limit(0), 2, "seq") == 0 and held.write(rows, 3, "seq") == 2
    assert [i for i, _ in numbers(spark, str(tmp_path / "log"))] == [1, 2, 3, 4, 5]
