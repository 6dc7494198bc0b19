import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnflow.llm import secrets

ASSIGN = re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    added = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"ghp_[A-Za-z0-9]{36,}", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    for k, (name, p) in enumerate(zip(("private", "github", "slack", "jwt"), added)):
        found += [(m.start(), 3 + k, m.end(), name) for m in re.finditer(p, text)]
    return sorted(found)


PIECES = [
    "password=abcdef", "PassWord\" : 'hunter22", "passwd:x", "token = ab/cd+ef==", "api_key=1234567", "apikey: zzzzzz", "ſecret=aaaaaaa", "toKen:\x20\x20short", "AKIA" + "B" * 16, "AKIA" + "B" * 15, "xAKIA" + "0" * 30,
    "0123456789abcdef01234567", "0123456789abcdef0123456", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "xoxb-1234567890-abc", "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9, "secret=password=token=abcdefg", "\U0001f600é", "plain words here", "\n", "\x00", "",
]


def test_matches_brute_force(documents):
    rng = random.Random(4)
    texts = [None, *PIECES, *("".join(rng.choice((" ", "", "\n", "é")).join(rng.choices(PIECES, k=rng.randint(0, 12)))) for _ in range(300))]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(documents(texts))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts, 1):
        want = brute(t)
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want if k in ("assign", "access", "hex"))
        assert got[i]["spans"] == ",".join(f"{k}:{s}:{e}" for s, _, e, k in want), t
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(w[3] == k for w in want) for k in ("assign", "access", "hex")]


def test_queries_of_trigrams():
    assert secrets.trigrams("AKIA[A-Z0-9]+") == ("or", ("and", "aki", "kia"))
    assert secrets.trigrams("[0-9a-f]+") is True
    assert secrets.trigrams("ab|cde") is True  # one alternative has none
    assert secrets.trigrams("abc|bcde") == ("or", ("and", "abc"), ("and", "bcd", "cde"))
    assert secrets.trigrams("xabc?d") == ("or", ("and", "abc", "bcd", "xab"), ("and", "abd", "xab"))
    assert secrets.trigrams("abcd{2,}e") == ("or", ("and", "abc", "bcd"))


@settings(max_examples=60, deadline=None)
@given(st.from_regex(secrets.BASE[0].pattern.replace("(?i:", "("), fullmatch=True), st.text(max_size=20))
def test_every_match_is_a_candidate(match, around):
    post = secrets.index([(around + match).encode("utf-8", "surrogatepass"), b"other"])
    for rule in (*secrets.BASE, *secrets.ADDED):
        if re.search(rule.pattern, match, re.ASCII):
            assert secrets.candidates(post, secrets.trigrams(rule.pattern))[0]


def test_postings_rule_texts_out():
    post = secrets.index([b"nothing of note", b"my PASSWORD here"])
    assert secrets.candidates(post, secrets.trigrams(secrets.BASE[0].pattern)).tolist() == [False, True]


def test_defined_cases(odd, empty):
    got = secrets.scan(odd).collect()
    assert len(got) == odd.count() and all(r["spans"] is not None for r in got)
    assert secrets.digest(secrets.scan(empty)).count() == 0
