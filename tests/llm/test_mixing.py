import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnflow.llm import mixing


def water(sizes, weights, cap):
    """Targets by clamping and dealing anew, round after round."""
    total, left, out = float(sum(sizes)), set(range(len(sizes))), {}
    while left:
        level = total / sum(weights[i] for i in left)
        over = {i for i in left if level * weights[i] > cap * sizes[i]}
        if not over:
            return [out.get(i, level * weights[i]) for i in range(len(sizes))]
        for i in over:
            out[i] = float(cap * sizes[i])
            total -= out[i]
        left -= over
    return [out[i] for i in range(len(sizes))]


def corpus():
    rng = random.Random(2)
    counts = {"a": 40, "b": 300, "c": 5, "d": 100, None: 7}
    rows, i = [], 0
    for source, n in counts.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * rng.randint(0, 60)), None, source, None))
            i += 1
    return rows


def test_targets_and_words_taken(documents):
    rows = corpus()
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    sizes = [sum(len(r[1].split()) for r in rows if r[3] == s) for s in names]
    goal = dict(zip(names, water(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 3)))
    for s, n in zip(names, sizes):
        part = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in part} == {n}
        assert part[0]["target"] == pytest.approx(goal[s])
        assert sum(r["taken"] for r in part) == round(goal[s])
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_reruns_and_other_partitions_agree(documents):
    df = documents(corpus())
    columns = ["doc_id", "size", "target", "taken"]
    assert sorted(map(tuple, mixing.mix(df).select(columns).collect())) == sorted(map(tuple, mixing.mix(df.repartition(7, "source")).select(columns).collect()))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=7))
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long").coalesce(1)
    got = [r["target"] for r in mixing.targets(df).orderBy("source").collect()]
    assert got == pytest.approx(water(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))], 3))


def test_defined_cases(odd, empty):
    got = mixing.mix(odd)
    assert set(odd.columns) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == odd.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(empty).count() == 0
    blank = mixing.mix(odd.withColumn("text", F.lit(None).cast("string"))).collect()
    assert len(blank) == len(rows) and {r["taken"] for r in blank} == {0}
