import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import language, toxicity
from tarnflow.llm.common import read

# --- language


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    p = language.init(3, 2, rng)
    x, filled, y = rng.integers(0, 256, (6, 4)), np.array([6, 3, 1, 5]), np.array([0, 1, 1, 0])
    _, g = language.gradients(p, x, filled, y)
    for name in ("fEz", "bUn", "fUr", "bW", "c"):
        flat = p[name].reshape(-1)
        for at in np.argsort(-np.abs(g[name].reshape(-1)))[:2]:
            old = flat[at]
            sides = []
            for step in (0.01, -0.01):
                flat[at] = old + step
                sides.append(language.gradients(p, x, filled, y)[0])
            flat[at] = old
            assert g[name].reshape(-1)[at] == pytest.approx((sides[0] - sides[1]) / 0.02, rel=0.05, abs=1e-4)


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * 127, b"b" * 128, b"c" * 1000]
    x, filled, of = language.windows(texts)
    assert filled.sum() == sum(map(len, texts)) and np.bincount(of, minlength=4).tolist() == [0, 1, 1, 8]
    p = language.init(4, 2, np.random.default_rng(0))
    q = language.probabilities(p, [*texts, b"a" * 127])
    assert q[0].sum() == 0 and q[1:].sum(axis=1) == pytest.approx(1, abs=1e-4) and q[1] == pytest.approx(q[4])


def test_a_plain_loop_gives_the_same_probabilities():
    """One byte after the other, with the equations of a gated recurrent unit as they stand."""
    rng = np.random.default_rng(4)
    p = language.init(5, 3, rng)
    text = bytes(rng.integers(97, 105, language.WINDOW + 37).astype(np.uint8))
    sig = lambda a: 1 / (1 + np.exp(-a))
    total = np.zeros(3)
    for at in range(0, len(text), language.WINDOW):
        part = text[at : at + language.WINDOW]
        padded = [*part, *[0] * (language.WINDOW - len(part))]
        logits = np.zeros((language.WINDOW, 3)) + p["c"]
        for way, order in (("f", range(language.WINDOW)), ("b", reversed(range(language.WINDOW)))):
            h = np.zeros(5)
            for t in order:
                e = {g: p[f"{way}E{g}"][padded[t]] for g in "zrn"}
                z, r = (sig(e[g] + h @ p[f"{way}U{g}"]) for g in "zr")
                n = np.tanh(e["n"] + r * (h @ p[f"{way}Un"]))
                h = z * h + (1 - z) * n
                logits[t] += h @ p[f"{way}W"]
        exp = np.exp(logits)
        total += (exp / exp.sum(axis=1, keepdims=True))[: len(part)].sum(axis=0)
    assert language.probabilities(p, [text])[0] == pytest.approx(total / len(text), abs=1e-4)


def test_training_takes_all_languages_and_whole_texts(spark):
    """A language of few rows is learned, and texts of many bytes a character are not cut."""
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcde", k=4)) for _ in range(30)), "many") for i in range(600)]
    rows += [(1000 + i, "".join(rng.choices("漢字語文本日", k=90)), "few") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for pieces in (120, 1 << 18):
        names, p = language.train(df, sample=60, pieces=pieces, steps=60)
        assert names == ["few", "many"]
        got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, (names, p)).collect()}
        assert np.mean([got[r[0]] == r[2] for r in rows]) > 0.99


@pytest.fixture(scope="module")
def speech(spark):
    rng = random.Random(7)
    sounds = {"xx": ["ka", "to", "mi", "ru"], "yy": ["sch", "ung", "der", "lich"], "zz": ["eau", "ent", "que", "oi"]}
    lang = lambda i: list(sounds)[i % 3]
    rows = [(i, " ".join("".join(rng.choices(sounds[lang(i)], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 90))), lang(i) if i % 7 else None) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_language_of_held_out_documents(speech):
    model = language.train(speech, learn=language.learnable(), steps=120)
    got = {r["doc_id"]: r for r in language.identify(speech, model).collect()}
    held = [r for r in speech.where(~language.learnable()).collect()]
    assert len(held) > 50 and np.mean([got[r["doc_id"]]["lang_pred"] == ["xx", "yy", "zz"][r["doc_id"] % 3] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    again = language.train(speech.repartition(5), learn=language.learnable(), steps=120)
    assert all(np.array_equal(again[1][k], model[1][k]) for k in model[1])


def test_language_defined_cases(odd, empty, speech):
    model = language.train(speech, steps=10)
    got = language.identify(odd, model).collect()
    assert len(got) == odd.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 8)} == {"und"} and {r["score"] for r in got if r["doc_id"] in (0, 1, 2, 8)} == {0.0}
    assert all(r["lang_pred"] in model[0] for r in got if r["doc_id"] not in (0, 1, 2, 8))
    kept = language.identify(odd, model, keep=True)
    assert set(odd.columns) <= set(kept.columns) and kept.count() == odd.count()
    assert language.identify(empty, model).count() == 0
    unlabelled = language.train(speech.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.identify(speech, unlabelled).collect()} == {"und"}


# --- toxicity


def test_sparse_weights_tell_the_classes():
    rng = np.random.default_rng(2)
    y = (rng.random(600) < 0.2).astype(float)
    rows = [np.unique(np.concatenate([rng.integers(1000, 50000, 40), [7] if label else []]).astype(np.int32)) for label in y]
    at, w, bias = toxicity.ftrl(rows, y)
    assert 7 in at and w[at.tolist().index(7)] > 1 and len(at) < 500
    score = lambda row: bias + w[np.isin(at, row)].sum()
    assert min(score(r) for r, label in zip(rows, y) if label) > max(score(r) for r, label in zip(rows, y) if not label)


def test_ftrl_is_the_plain_loop():
    """Coordinate by coordinate, as the update is written."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(80)]
    y = (rng.random(80) < 0.4).astype(float)
    alpha, beta, l1, l2, positive = 0.5, 1.0, 0.3, 0.1, 2.0
    z, n = {}, {}
    bias = 1 << toxicity.BITS

    def weight(i):
        cut = 0.0 if i == bias else l1
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= cut else -(v - np.sign(v) * cut) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    for _ in range(3):
        for row, label in zip(rows, y):
            at = [*row.tolist(), bias]
            w = {i: weight(i) for i in at}
            g = (1 / (1 + np.exp(-sum(w.values()))) - label) * (positive if label else 1.0)
            for i in at:
                step = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - step * w[i]
                n[i] = n.get(i, 0.0) + g * g
    at, w, b = toxicity.ftrl(rows, y, alpha, beta, l1, l2, 3, positive)
    assert b == pytest.approx(weight(bias)) and dict(zip(at.tolist(), w)) == pytest.approx({i: weight(i) for i in z if i != bias and abs(z[i]) > l1})


def test_training_rows_are_bounded(spark):
    """An id that many documents share is learned from once, and both labels get their part of the sample."""
    docs = spark.createDataFrame([(i % 40 if i < 200 else 7, f"word{i % 5} you") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 7)) for i in range(40)], "doc_id long, toxic int")
    seen = []
    given = lambda rows, y, **_: seen.append(y) or (np.zeros(0, np.int64), np.zeros(0), 0.0)
    old, toxicity.ftrl = toxicity.ftrl, given
    try:
        toxicity.train(docs, labels, sample=8)
        toxicity.train(docs, labels)
    finally:
        toxicity.ftrl = old
    assert len(seen[0]) <= 8 and seen[0].sum() in (3, 4) and len(seen[1]) == 40


def test_coordinates_are_words_pairs_and_skips():
    assert len(toxicity.coordinates("One two, three")) == 3 + 2 + 1
    assert toxicity.coordinates("a b c")[-1] == toxicity.coordinates("a X c")[-1]
    assert len(toxicity.coordinates(None)) == len(toxicity.coordinates("1 2")) == 0


@pytest.fixture(scope="module")
def remarks(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(800):
        bad = rng.random() < 0.25
        w = rng.choices(["stone", "river", "road", "tree", "house", "light", "old", "you"], k=rng.randint(10, 60))
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["you idiot", "worthless fool", "you scum"]))
        rows.append((i, " ".join(w), int(bad)))
        labels.append((i, None if i % 40 == 0 else int(bad)))
    labels += [(5000, 1), (None, 1), (3, labels[3][1])]
    return spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int").repartition(2)


def test_toxicity_of_held_out_documents(remarks):
    docs, labels = remarks
    model = toxicity.train(docs, labels, learn=toxicity.learnable())
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = docs.where(~toxicity.learnable()).collect()
    assert len(held) > 100 and np.mean([(got[r["doc_id"]] >= 0.5) == bool(r["y"]) for r in held]) > 0.97
    again = toxicity.train(docs.repartition(5), labels.repartition(3), learn=toxicity.learnable())
    assert np.array_equal(again[0], model[0]) and np.array_equal(again[1], model[1])


def test_toxicity_defined_cases(odd, empty, remarks):
    docs, labels = remarks
    model = toxicity.train(docs, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (0, 1, 2)}
    assert len(blank) == 1
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}


def test_test_tables(spark, sf):
    """On the small tables the labelled documents that were not learned from are told apart."""
    large = sf.replace("sf0.001", "sf0.1")  # smaller tables hold out six toxic documents
    docs, labels = read(spark, large, "documents"), read(spark, large, "labels")
    model = toxicity.train(docs, labels, learn=toxicity.learnable())
    held = toxicity.score(docs, model).join(labels, "doc_id").where(~toxicity.learnable()).collect()
    said, true = (np.array([x(r) for r in held], bool) for x in (lambda r: r["score"] >= 0.5, lambda r: r["toxic"]))
    assert (said & true).sum() >= 0.7 * true.sum() and (said & true).sum() >= 0.7 * said.sum()
    docs = read(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    lang = language.identify(docs, language.train(docs, learn=language.learnable())).join(docs.select("doc_id", "lang"), "doc_id")
    held = lang.where(~language.learnable() & F.col("lang").isNotNull()).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.9


def test_scoring_equals_the_states_that_are_trained():
    """The way that scores is the one that is trained, in another arithmetic; large weights saturate without harm."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (language.WINDOW, 40)).astype(np.uint8)
    for scale in (1.0, 2.0):
        p = {k: v * np.float32(scale) for k, v in language.init(16, 4, rng).items()}
        whole, f, b = language._positions(p, x)
        np.testing.assert_allclose(language._scored(p, x), np.moveaxis(whole, 2, 0), atol=2e-4)
        np.testing.assert_allclose(language._states(p, "b", x.astype(np.intp)), b.reshape(-1, 16), atol=2e-4)
    huge = {k: v * np.float32(1e4) for k, v in p.items()}
    assert np.isfinite(language._scored(huge, x)).all()
