import numpy as np
import pytest

from tarnflow.operators import retrieve, vectorindex

SCHEMA = "doc_id long, embedding array<float>, v string, pivot string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA).repartition(3)


def exact(x, q, k):
    s = (x @ q) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt(q @ q))
    return s, np.lexsort((np.arange(len(x)), -s))[:k]


@pytest.mark.parametrize("kind, probe", [("random", None), ("clusters", 4)])
def test_recall(spark, tmp_path, kind, probe):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 32)) * rng.uniform(0.5, 2, (3000, 1))
    if kind == "clusters":
        x = rng.standard_normal((30, 32))[rng.integers(0, 30, 3000)] + 0.2 * x
    x = x.astype(np.float32).astype(float)
    df = frame(spark, enumerate(x.tolist()))
    vectorindex.write(df, str(tmp_path / "i"), cell=256, most=400)
    assert spark.read.parquet(str(tmp_path / "i/cells")).count() > 8
    asked = df.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    rows = vectorindex.search(spark, str(tmp_path / "i"), asked, probe=probe, per_task=7).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r)
    share = []
    for q in range(0, 3000, 100):
        s, best = exact(x, x[q], 10)
        assert [r["rank"] for r in found[q]] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(s[r["doc_id"]], abs=1e-12) for r in found[q])
        share.append(len({r["doc_id"] for r in found[q]} & set(best.tolist())) / 10)
    assert np.mean(share) >= 0.9


def test_defined_cases(spark, tmp_path):
    """Unsound vectors, a null id, a third of all rows equal, shorter vectors, queries of another width, repeated queries."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(60)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(200, None), (201, [0.0] * 4), (202, [1.0, None]), (203, [float("nan")] * 4), (204, []), (None, [1.0] * 4), (205, [3.0])]
    df = frame(spark, rows)
    vectorindex.write(df, str(tmp_path / "i"), cell=30, copies=12)
    asked = spark.createDataFrame([(1, rows[3][1]), (1, rows[3][1]), (2, [0.0] * 4), (3, None), (4, [1.0]), (5, [1.0, 0.0, 0.0, 0.0, 9.0])], "query_id long, embedding array<float>")
    got = {}
    for r in vectorindex.search(spark, str(tmp_path / "i"), asked, k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got[1] == [3, 1000, 1001, 1002, 1003, 1004] and set(got) == {1, 4, 5} and got[4][0] == 205
    direct = retrieve.vector(df.where("doc_id IS NOT NULL AND doc_id NOT IN (200, 202, 203, 204, 205)"), [1.0, 0.0, 0.0, 0.0], 5).orderBy("rank").collect()
    assert got[4][1:] == [r["doc_id"] for r in direct]
    vectorindex.write(df.limit(0), str(tmp_path / "empty"))
    assert vectorindex.search(spark, str(tmp_path / "empty"), asked).count() == 0


def test_links_are_diverse_and_reach_all():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    links = vectorindex.linked(x, 8, 50)
    reached, todo = {0}, [0]
    while todo:
        for v in links[todo.pop()].tolist():
            if v >= 0 and v not in reached:
                reached.add(v)
                todo.append(v)
    assert len(reached) == 400
    for node, near in enumerate(links.tolist()):
        near = [v for v in near if v >= 0]
        assert node not in near and len(set(near)) == len(near) >= 8
