import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnflow.llm import coder, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 49151)), max_size=600))
def test_round_trip(ids):
    ids = np.array(ids, np.uint32)
    np.testing.assert_array_equal(coder.decode(coder.encode(ids)), ids)


def test_long_and_skewed_round_trips():
    rng = np.random.default_rng(1)
    zipf = np.minimum(rng.zipf(1.3, 300_000), 49151).astype(np.uint32)
    for ids in (zipf, np.zeros(100_000, np.uint32), np.tile(np.arange(50, dtype=np.uint32), 3000), np.array([(1 << 22) - 1, 0, (1 << 22) - 1], np.uint32)):
        block = coder.encode(ids)
        np.testing.assert_array_equal(coder.decode(block), ids)
    assert len(coder.encode(np.tile(np.arange(50, dtype=np.uint32), 3000))) < 0.2 * 2 * 150_000  # the contexts predict
    assert len(coder.encode(zipf)) < 2 * len(zipf)


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(2).integers(0, 1000, 5000).astype(np.uint32)
    block = coder.encode(ids)
    assert coder.encode(ids) == block
    for at in (0, 4, 30, len(block) // 2, len(block) - 40):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(coder.Corrupt):
            coder.decode(bytes(broken))
    for cut in (block[:10], block[: len(block) // 2], b""):
        with pytest.raises(coder.Corrupt):
            coder.decode(cut)


def plain(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


TEXTS = [None, "", " ", "Hello world, it's 3.14!", "ÉCOLE große naïve İstanbul", "漢字 \U0001f600 é", "<|endoftext|> x", "a\x00b\x1cc d", "tab\tnew\nline\r\n  two", "x" * 5000, "don't stop_here a-b_c 10,000"]


def test_words_that_are_remembered_give_the_ids_of_the_whole_text():
    encoder = tokens.Encoder(PATH, 2)
    for t in [*TEXTS, *TEXTS]:
        assert np.frombuffer(encoder(t), np.uint32).tolist() == plain(t), t


def test_documents(documents, monkeypatch):
    rng = random.Random(3)
    texts = [*TEXTS, *(" ".join(rng.choices(["the", "Station", "of", "there", "12"], k=rng.randint(0, 300))) for _ in range(60))]
    df = documents(texts)
    blocks = tokens.write(df, PATH, partitions=5)
    got = sorted(map(tuple, tokens.documents(blocks).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    want, at = [], 0
    for i, t in enumerate(texts, 1):
        ids = plain(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert {r["doc_id"]: list(r["ids"]) for r in tokens.ids(blocks).collect()} == {i: plain(t) for i, t in enumerate(texts, 1)}


def test_files_are_read_back(documents, tmp_path):
    blocks = tokens.write(documents(["a b", "c"]), PATH, path=str(tmp_path / "blocks"))
    assert sorted(r["n_tokens"] for r in tokens.documents(blocks).collect()) == sorted(len(plain(t)) for t in ("a b", "c"))


def test_defined_cases(odd, empty):
    got = tokens.documents(tokens.write(odd, PATH)).collect()
    rows = odd.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
    at = 0
    for start, n, _ in starts:
        assert start == at
        at += n
    ids = [i for _, _, i in starts]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert tokens.documents(tokens.write(empty, PATH)).count() == 0


def other(path, **parts):
    """The tokenizer's file with some parts in another way."""
    import json

    with open(PATH, encoding="utf-8") as f:
        held = json.load(f) | parts
    path.write_text(json.dumps(held), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("parts", [
    {"normalizer": None},
    {"pre_tokenizer": {"type": "WhitespaceSplit"}},
    {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Whitespace"}, {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}]}},
    {"added_tokens": [{"id": 0, "content": "hello", "single_word": False, "lstrip": False, "rstrip": False, "normalized": True, "special": False}]},
    {"truncation": {"direction": "Right", "max_length": 2, "strategy": "LongestFirst", "stride": 0}},
])
def test_other_tokenizers_read_whole_texts(spark, documents, tmp_path, parts):
    from tokenizers import Tokenizer

    path = other(tmp_path / "t.json", **parts)
    whole = Tokenizer.from_file(path)
    texts = [*TEXTS, "Hello a-b hello", "hello  World's  12 x"]
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    encoder = tokens.Encoder(path, 2)
    assert not encoder.apart and [np.frombuffer(x, np.uint32).tolist() for x in encoder.each(texts)] == want
    got = {r["doc_id"]: r["ids"] for r in tokens.ids(tokens.write(documents(texts), path)).collect()}
    assert got == {i + 1: ids for i, ids in enumerate(want)}
    assert tokens.Encoder(PATH, 2).apart


def test_many_null_ids_in_several_partitions(documents):
    rows = [(None if i % 3 else i, f"text {i % 7}", None, None, None) for i in range(200)]
    blocks = tokens.write(documents(rows), PATH, partitions=5)
    got = tokens.documents(blocks).orderBy("start").collect()
    assert len(got) == 200 and [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert [r["doc_id"] for r in got] == [None] * 133 + sorted(r[0] for r in rows if r[0] is not None)
