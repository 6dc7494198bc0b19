"""Token ids of documents, in blocks of the context-mixing range coder.

Documents are dealt to range partitions by id and sorted, so that blocks follow each other in ascending id order. A
block holds whole documents, up to about `coder.MOST` ids (a longer document makes a longer block), and is one row of
a Parquet table: part and block (its place), the documents' ids and lengths, and the coded bytes. Places of documents
in the whole stream are sums over blocks, never over rows.

Defined cases: a null or empty text is a document of the end id alone; a very long text is one document of one block;
null ids come first, and rows of one id are
ordered by a hash of the text; other columns are ignored; an empty table gives files without a block.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.llm import coder
from tarnflow.llm.common import store

#: Texts without these (only Latin, no controls) and without what starts a special token are the sum of their words:
#: lower case works letter by letter there, and no piece of the tokenizer reaches over white space.
ODD = "[^\\t\\n\x0b\\f\\r -~¡-įı-ɏ]|<[|]"
#: In a word without an apostrophe runs of letters, single digits and runs of other signs are pieces of their own.
SIGNS = r"(\p{N}|[^\p{L}\p{N}]+)"
#: Pieces that a worker remembers, and characters of texts that are read at once.
PIECES_KEPT, AT_ONCE = 800_000, 1 << 24


def _each_list(lists: pa.ListArray, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of strings, where the k-th different string stands for the next sizes[k] values: number of values of each
    list, and the values of all."""
    flat = lists.flatten()
    which = flat.indices
    parts = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values)
    ends = np.concatenate([[0], np.cumsum(sizes[which.to_numpy()])])
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return np.diff(ends[bounds]), parts.take(which).flatten().to_numpy()


def _numbered(lists: pa.ListArray) -> tuple[pa.ListArray, pa.Array]:
    """Lists of strings as lists of numbers of different strings, and these."""
    coded = lists.flatten().dictionary_encode()
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), pa.int32()), coded), coded.dictionary


#: How a tokenizer normalises and splits texts if they may be taken apart into words and pieces beforehand.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def apart(tokenizer: dict) -> bool:
    """Whether a tokenizer (its JSON) gives a text the ids of its words and pieces, read one by one."""
    plain = tokenizer.get("normalizer") == NORMALIZER and tokenizer.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
    marks = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"]) for t in tokenizer.get("added_tokens") or ())
    return plain and marks and not tokenizer.get("truncation") and not tokenizer.get("padding")


class Encoder:
    """Ids of texts from a tokenizer of the tokenizers library.

    Where the tokenizer works word by word as `apart` tells, each piece is read once while it is remembered; any other
    tokenizer reads each text as a whole.
    """

    def __init__(self, path: str, end: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are what runs side by side
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.apart = apart(json.load(f))
        self.tokenizer, self.end, self.known = Tokenizer.from_file(path), array("I", [end]).tobytes(), {"": b""}

    def __call__(self, text: str | None) -> bytes:
        """The text's ids and the end id, as u32."""
        return next(self.each([text]))

    def each(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text and the end id, as u32; texts are read together."""
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(t or "")
            if size > AT_ONCE:
                yield from self._read_all(held)
                held, size = [], 0
        yield from self._read_all(held)

    def _read_all(self, texts: list[str]) -> Iterator[bytes]:
        if self.apart:
            return self._together(pa.array(texts, pa.string()))
        return (ids + self.end for ids in self._whole(texts))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.match_substring_regex(texts, ODD)
        words, different = _numbered(pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", texts))))
        marked = pc.match_substring(different, "'")
        pieces, parts = _numbered(pc.ascii_split_whitespace(pc.if_else(marked, different, pc.replace_substring_regex(different, SIGNS, r" \1 "))))
        coded = self._read(parts.to_numpy(zero_copy_only=False).tolist())
        sizes, values = _each_list(pieces, np.array([len(x) for x in coded], np.int64) // 4, np.frombuffer(b"".join(coded), np.uint32))
        sizes, values = _each_list(words, sizes, values)
        at = 0
        for n, is_odd, text in zip(sizes.tolist(), odd.to_pylist(), texts):
            yield (self._whole([text.as_py()])[0] if is_odd else values[at : at + n].tobytes()) + self.end
            at += n

    def _read(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces; new ones are read as one text, in which each is a word of the tokenizer's."""
        known = self.known
        new = [x for x in pieces if x not in known]
        if len(known) + len(new) > PIECES_KEPT:
            known.clear()
            new = pieces
        plain, other = [x for x in new if "'" not in x and x], [x for x in new if "'" in x or not x]
        known.update(zip(other, self._whole(other)))
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, of = array("I", e.ids).tobytes(), np.array(e.word_ids, np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(part)))]) * 4
            if len(ends) != len(part) + 1:
                known.update(zip(part, self._whole(part)))
                continue
            known.update((x, ids[a:b]) for x, a, b in zip(part, ends[:-1].tolist(), ends[1:].tolist()))
        return [known[x] for x in pieces]


@functools.lru_cache(maxsize=2)
def encoder_of(path: str, end: int) -> Encoder:
    """Workers that Spark uses again keep their pieces from task to task."""
    return Encoder(path, end)


def write(df: DataFrame, tokenizer: str, path: str | None = None, doc_id: str = "doc_id", text: str = "text", end: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode and write all documents; the table of blocks, read back from `path` (or from the shared folder)."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer, end)
        part, block, ids, held, sizes, size = 0, 0, [], [], [], 0

        def done() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "block": [block], "ids": [ids], "sizes": [sizes], "n": [size], "coded": [coder.encode(np.frombuffer(b"".join(held), np.uint32))]})

        for b in batches:
            for p, i, coded in zip(b["part"].tolist(), b["id"].tolist(), encoder.each(b["text"].tolist())):
                if held and (p != part or size + len(coded) // 4 > coder.MOST):
                    yield done()
                    block, ids, held, sizes, size = (block + 1 if p == part else 0), [], [], [], 0
                part = p
                ids.append(None if i is None or i != i else i)
                held.append(coded)
                sizes.append(len(coded) // 4)
                size += len(coded) // 4
        if held:
            yield done()

    rows = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    # By the text's hash too, so that rows without an id, or of one id, are not all in one partition.
    order = [F.col("id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id().cast("long"))
    blocks = dealt.mapInPandas(run, f"part long, block long, ids array<{kind}>, sizes array<long>, n long, coded binary")
    if path is None:
        return store(blocks)
    blocks.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(blocks.schema).parquet(path)


def documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the coded bytes."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, block, ids, sizes, coded in zip(b["part"], b["block"], b["ids"], b["sizes"], b["coded"]):
                got, n = coder.decode(coded).astype("<u4"), np.asarray(sizes, np.int64)
                ends = np.cumsum(n)
                if len(got) != ends[-1]:
                    raise coder.Corrupt("documents and ids differ in length")
                yield pd.DataFrame({"part": part, "block": block, "doc_id": pd.Series(list(ids), dtype=object), "inside": ends - n, "n_tokens": n, "ids_crc32": [zlib.crc32(got[e - k : e].tobytes()) for e, k in zip(ends.tolist(), n.tolist())]})

    rows = blocks.select("part", "block", "ids", "sizes", "coded").mapInPandas(run, f"part long, block long, doc_id {kind}, inside long, n_tokens long, ids_crc32 long")
    # Sums per part go through one task: as many rows as there are range partitions.
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = blocks.select("part", "block", place.alias("at")).join(parts, "part")
    return rows.join(places, ["part", "block"]).select("doc_id", (F.col("before") + F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def ids(blocks: DataFrame) -> DataFrame:
    """(doc_id, ids) of all documents, from the coded bytes."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for known, sizes, coded in zip(b["ids"], b["sizes"], b["coded"]):
                parts = np.split(coder.decode(coded).astype(np.int32), np.cumsum(np.asarray(sizes, np.int64))[:-1])
                yield pd.DataFrame({"doc_id": pd.Series(list(known), dtype=object), "ids": parts})

    return blocks.select("ids", "sizes", "coded").mapInPandas(run, f"doc_id {kind}, ids array<int>")
