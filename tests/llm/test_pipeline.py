"""The stages beside brute force, and their defined cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(n)) + "."


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_line_dedup_keeps_all_but_repeated_passages(spark, documents):
    rng = random.Random(4)
    passage = [prose(rng, 18) for _ in range(3)]
    own = [[prose(rng, 9), prose(rng, 9)] for _ in range(8)]
    rows = [(i, "\n".join([own[i][0], *passage, own[i][1]]), "en", "s", 7) for i in range(8)] + [(8, "\n".join(passage), "en", "s", 7), (9, None, None, None, None), (10, "", None, None, None)]
    got = {r["doc_id"]: r for r in corpus_pipeline.line_dedup(spark, documents(rows), "").collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 10]  # 8 held nothing else
    assert got[0]["text"] == rows[0][1]
    assert all(got[i]["text"] == "\n".join(own[i]) and got[i]["n_chars"] == len(got[i]["text"]) for i in range(1, 8))


def similarity(a, b, n=5):
    cut = lambda t: {tuple(t.lower().split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))}
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


def test_near_dedup_keeps_one_of_each_component(spark, documents):
    rng = random.Random(9)
    texts = []
    for _ in range(15):
        w = prose(rng, 120).split()
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 4)):
            w = list(w)
            w[rng.randrange(120)] = "changed" + str(rng.random())
            texts.append(" ".join(w))
    rng.shuffle(texts)
    of = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(texts):
            for j in range(i):
                if of[i] != of[j] and similarity(a, texts[j]) >= 0.8:
                    of[i] = of[j] = min(of[i], of[j])
    assert ids(corpus_pipeline.near_dedup(spark, documents(texts), "")) == sorted({x + 1 for x in of})


def test_mix_takes_whole_copies(spark, documents):
    rng = random.Random(2)
    rows = [(i, prose(rng, 20), "en", "a" if i < 10 else "b", None) for i in range(100)]
    got = Counter(ids(corpus_pipeline.mix_sources(spark, documents(rows), "")))
    assert all(got[i] == 3 for i in range(10))  # 5 of 7 parts are more than three times its size
    assert sum(got[i] for i in range(10, 100)) == 70 and set(got.values()) <= {1, 3}


def test_pack_numbers_copies(spark, documents):
    rng = random.Random(2)
    rows = [(i, prose(rng, 20), "en", "a", None) for i in range(5)] * 3
    got = corpus_pipeline.pack(spark, documents(rows), "").collect()
    assert sorted((r["doc_id"], r["copy"]) for r in got) == [(i, k) for i in range(5) for k in range(3)]
    assert len({(r["shard"], r["bin"]) for r in got}) == 15


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns whose names operators and stages use."""
    rng = random.Random(6)
    names = ("score", "lang_pred", "size", "source_size", "target", "copies", "part", "taken", "n_removed", "n_lines", "_time", "id", "t", "gone", "given_text")
    rows = [(i, prose(rng, 30, "abcde" if i % 2 else "vwxyz"), ("aa" if i % 2 else "zz") if i % 5 else None, f"s{i % 3}", i) for i in range(1, 61)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.concat(F.lit("mine "), F.col("doc_id")).alias(x) for x in names]).repartition(3), names


@pytest.mark.parametrize("stage", [k for k, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_of_the_caller_stay(spark, clashing, stage):
    docs, names = clashing
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[x] == f"mine {r['doc_id']}" for r in rows for x in names)


def test_stated_languages_go_by_the_network(spark, clashing):
    docs, _ = clashing
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") == 10, "aa").otherwise(F.col("lang")))
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, wrong, "").collect()}
    assert got[5] == "aa" and got[20] == "zz"


@pytest.mark.parametrize("stage", [k for k, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, empty, stage):
    assert dict(corpus_pipeline.STAGES)[stage](spark, empty, "").count() == 0


def test_run(spark, tmp_path, odd):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in odd.collect()}
    with_letters = odd.where(F.col("text").rlike(r"\p{L}")).select("text").distinct().count()
    assert 0 < len({r["doc_id"] for r in got}) <= with_letters
