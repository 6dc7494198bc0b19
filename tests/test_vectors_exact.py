import numpy as np

from tarnflow.operators import vectorindex


def test_exact_search_finds_what_poor_graphs_miss(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(1200, 24))
    x[700:705] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    vectorindex.write(df, str(tmp_path), cell=400, m=2, ef=2)
    asked = df.where("doc_id % 40 = 20").withColumnRenamed("doc_id", "query_id")
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    want = set()
    for q in range(20, 1200, 40):
        s = np.round(unit @ unit[q], 9)
        want |= {(q, int(d)) for d in np.lexsort((np.arange(1200), -s))[:10]}
    found = lambda **k: {(r["query_id"], r["doc_id"]) for r in vectorindex.search(spark, str(tmp_path), asked, width=10, **k).collect()}
    assert found(exact=True) == want
    assert found() != want  # the graphs alone miss some
