import random

import pytest

from tarnflow.llm import linedup


def brute(rows, long_words=50):
    """{id: (text, lines removed)} for rows with distinct ids: a line goes when a pair, or long line, that covers it occurs earlier."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        if t is None:
            out[i] = (None, 0)
            continue
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if x.split()]
        spans = [(a, b) for a, b in zip(full, full[1:])] + [(k, k) for k in full if len(lines[k].split()) >= long_words]
        gone = set()
        for a, b in sorted(spans):
            body = "\n".join(lines[a : b + 1])
            if body in seen:
                gone |= set(range(a, b + 1))
            seen.add(body)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def prose(rng, words):
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(words))


def result(df):
    return {r["doc_id"]: (r["text"], r["n_removed"]) for r in df.collect()}


@pytest.mark.parametrize(("n", "words"), [(3, 18), (6, 10), (12, 10), (40, 3)])
def test_whole_passages_go(documents, n, words):
    rng = random.Random(n)
    texts, kept = [], []
    for _ in range(12):
        passage = [prose(rng, words) for _ in range(n)]
        for copy in range(2):
            before, after = ([prose(rng, 9) for _ in range(rng.randint(1, 4))] for _ in range(2))
            texts.append("\n".join([*before, *passage, *after]))
            kept.append("\n".join([*before, *([] if copy else passage), *after]))
    assert result(linedup.dedup(documents(texts))) == {i: (x, n * (i % 2 == 0)) for i, x in enumerate(kept, 1)}


@pytest.mark.parametrize("divisor", [1, 2, 4])
def test_matches_brute_force(documents, divisor):
    rng = random.Random(8)
    line = lambda: rng.choice(["", "a", "b c", "d e f", prose(rng, 5), "x " * 50])
    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 9)))) for i in range(1, 60)]
    block = [prose(rng, 7) for _ in range(30)]  # copies of many lines, which chunks find
    rows += [(60 + k, "\n".join([prose(rng, 4), *block[k:], "b c"])) for k in range(6)] + [(70, "\n".join(block + block)), (71, None), (72, "")]
    got = linedup.dedup(documents([(i, t, None, "s", None) for i, t in rows]), divisor=divisor, long_words=50)
    assert result(got) == brute(rows)


def test_chunks_alone_find_long_copies(documents, spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    block = [prose(rng, 6) for _ in range(60)]
    docs = documents(["\n".join(["own", *block]), "\n".join(["another", "two", *block, "end"])])
    docs = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), "text")
    (row,) = linedup.repeats(docs, lambda x: linedup.with_chunks(x, 4)).collect()
    assert row["id"] == 2 and sum(x["b"] - x["a"] + 1 for x in row["gone"]) > 30


def test_single_lines_and_blank_lines_stay(documents):
    texts = ["one\n\ncommon line\n\ntwo", "three\n\ncommon line\n\nfour", "x " * 60, "x " * 60]
    assert {r["text"] for r in linedup.dedup(documents(texts)).collect()} == set(texts)
    assert sorted(r["text"] for r in linedup.dedup(documents(texts), long_words=50).collect())[0] == ""


def test_defined_cases(odd, empty):
    got = linedup.dedup(odd, long_words=50)
    assert sorted(got.columns) == sorted(set(odd.columns) | {"n_lines", "n_removed"})
    rows = got.collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[0][0]["text"] is None and by[0][0]["n_lines"] == 0
    assert by[1][0]["text"] == "" and by[1][0]["n_lines"] == 1 and by[2][0]["n_removed"] == 0
    assert {r["text"] for r in by[20]} == {by[20][0]["text"]}  # repeated rows are treated alike
    assert by[21][0]["n_removed"] > 0  # a copy of document 5
    assert by[21][0]["_id"] is None and by[21][0]["_chunks"] is None
    assert linedup.dedup(empty).count() == 0


def test_large_removals_are_joined_by_sorting(documents, monkeypatch):
    monkeypatch.setattr(linedup, "sized", lambda df, column: df.hint("merge"))
    rows = [(i, f"own {i}\na b\nc d\ne f", None, None, None) for i in range(1, 20)]
    assert result(linedup.dedup(documents(rows))) == brute([r[:2] for r in rows])


def test_only_built_in_functions(documents):
    plan = linedup.dedup(documents(["a b\nc"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
