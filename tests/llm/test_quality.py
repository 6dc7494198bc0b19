import random
import re
from collections import Counter

from tarnflow.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(8)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def texts():
    rng = random.Random(1)
    few = ["a", "bb", "ccc", "#x", "é|", "d&d", "<p>"]
    out = []
    for n in (0, 1, 7, 8, 9, 19, 20, 21, 60, 300):
        out.append(" ".join(rng.choices(few, k=n)))
        out.append("\n".join(" ".join(rng.choices(few[:3], k=rng.randint(0, 12))) for _ in range(n)))
    phrase = "one two three four five six seven eight nine ten"
    return out + [phrase + " " + phrase, f"{phrase} x {phrase}\n{phrase}", " ".join(["same"] * 500), "a\x0bb\x0cc\rd\te f g", "x\x00y " * 30]


def test_counts_match_brute_force(documents):
    given = texts()
    got = {r["doc_id"]: r for r in quality.measure(documents(given)).collect()}
    assert len(got) == len(given)
    for i, t in enumerate(given, 1):
        assert tuple(got[i][c] for c in NAMES) == brute(t), t


def test_defined_cases(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    got = quality.measure(odd).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"])
    assert sorted(map(key, got)) == sorted((r["doc_id"] is None, r["doc_id"] or 0, brute(r["text"])[0]) for r in rows)
    assert not any(r["kept"] for r in got if r["n_words"] < 20)
    assert quality.measure(empty).count() == 0
    cleaned = quality.clean(odd)
    assert set(odd.columns) <= set(cleaned.columns) and cleaned.count() == len(rows)
    assert all(r["_lines"] is None for r in cleaned.select("_lines").collect())


def test_lines_are_judged_one_by_one(documents):
    prose = "The river ran slowly past the old mill, and nobody came to look at it for years."
    bad = ["Home | About | Contact | Help", "*** ### *** ###", "Click here to read more"]
    good, mixed, poor = "\n".join([prose] * 1 + [prose[4:], "It was late."]), "\n".join([prose, *bad, prose[::-1] + "."]), "\n".join([prose, *bad * 4])
    got = {r["doc_id"]: r for r in quality.clean(documents([good, mixed, poor])).collect()}
    assert got[1]["clean_text"] == good and got[1]["lost"] == 0
    assert got[2]["clean_text"].split("\n") == [prose, prose[::-1] + "."] and got[2]["line_kept"]
    assert not got[3]["line_kept"] and got[3]["clean_text"] == prose


def test_only_built_in_functions(documents):
    plan = quality.measure(documents(["a b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
