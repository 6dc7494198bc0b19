from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarnflow.llm import common, language


def test_tables_are_released(spark):
    one, two = common.store(spark.range(5)), common.store(spark.range(7))
    at = [Path(t.stored_at.removeprefix("file:")) for t in (one, two)]
    assert one.count() == 5 and all(p.is_dir() for p in at)
    common.release(one)
    assert [p.is_dir() for p in at] == [False, True]
    common.release_all(spark)
    assert not at[1].exists()
    assert common.store(spark.range(3)).count() == 3


def test_labels_are_bounded(spark):
    df = spark.range(50).select(F.xxhash64("id").alias("h"), F.col("id").cast("string").alias("label"))
    assert common.first_of_each(df, "h", "label", 10).count() == 50  # one of each label
    with pytest.raises(ValueError, match="more than 20"):
        common.first_of_each(df, "h", "label", 10, labels=20)


def test_least_score_by_brute_force(spark, monkeypatch):
    """`share` of the lowest score of a held-out row that is predicted right."""
    rows = [(i, text, label, score) for i, (text, label, score) in enumerate([("a", "x", 0.9), ("b", "x", 0.6), ("c", "y", 0.5), ("", "x", 0.1), (None, "x", 0.1), ("d", None, 0.2), ("e", "x", 0.55)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, s double")
    scores = {r[1]: r[3] for r in rows}

    def identify(df, model, doc_id, text, keep):
        score = F.create_map(*[F.lit(v) for k, s in scores.items() if k for v in (k, s)])[F.col(text)]
        return df.withColumn("lang_pred", F.lit("x")).withColumn("score", score)

    monkeypatch.setattr(language, "identify", identify)
    want = 0.8 * min(s for i, t, label, s in rows if t and label == "x" and i != 6)
    assert language.least_score(df, (["x"], {}), F.col("doc_id") != 6) == pytest.approx(want)
    assert language.least_score(df, (["x"], {}), F.lit(False)) == 0.0
