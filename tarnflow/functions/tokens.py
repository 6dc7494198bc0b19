"""Tokens of whole texts in Python workers: a text is parted once, all is counted in it, and no token is a value of Spark's that isn't asked for.

Same tokens as `text.tokenize`: the lower-case words between delimiters, their character pairs and their characters. Lower case is
made by Spark, so that both have the same.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.text import BLANKS, DELIMITERS

_MARKS = [c for c in BLANKS + DELIMITERS if c != " "]
#: A code point has so many bits.
_SPACE, _BITS = ord(" "), 21
#: Words whose tokens a worker keeps, postings of a batch, and postings that are sorted at once.
KEPT, BATCH, BLOCK = 1 << 16, 1 << 18, 1 << 20


def low(text: Column) -> Column:
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def words(text: str) -> list[str]:
    """The parts of a lower-case text."""
    for c in _MARKS:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def frequencies(text: str) -> Counter[str]:
    """How often each token is in a lower-case text."""
    found = words(text)
    out = Counter(found)
    c = np.frombuffer(" ".join(found).encode("utf-32-le"), np.uint32).astype(np.int64)
    for k, n in zip(*(x.tolist() for x in np.unique(c[c != _SPACE], return_counts=True))):
        out[chr(k)] += n
    c = c[:-1] << _BITS | c[1:]
    for k, n in zip(*(x.tolist() for x in np.unique(c, return_counts=True))):
        a, b = k >> _BITS, k & (1 << _BITS) - 1
        if _SPACE not in (a, b):
            out[chr(a) + chr(b)] += n
    return out


def _counter(term: str) -> Callable[[str], int]:
    """Counts a term in words that stand between two spaces each."""
    whole = f" {term} "
    if len(term) > 2:
        return lambda x: x.count(whole)
    if len(term) == 2 and term[0] == term[1]:  # two of one character may overlap
        pair = re.compile(f"(?={re.escape(term)})")
        return lambda x: x.count(whole) + len(pair.findall(x))
    return lambda x: x.count(whole) + x.count(term)


def counts(text: Column, terms: list[str]) -> Column:
    """(len, tf): the number of a text's tokens, and how often each of the terms is among them."""

    @F.pandas_udf("len long, tf array<long>")
    def run(x: pd.Series) -> pd.DataFrame:
        counters = [_counter(t) for t in terms]
        lengths, tf = [], []
        for t in x:
            found = words(t)
            line = f" {'  '.join(found)} "
            lengths.append(2 * sum(map(len, found)))
            tf.append([c(line) for c in counters])
        return pd.DataFrame({"len": pd.Series(lengths, dtype="int64"), "tf": tf})

    return run(low(text))


def length(text: Column) -> Column:
    """Number of tokens: a word of n characters has 1 + (n - 1) + n."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([2 * sum(map(len, words(t))) for t in x], dtype="int64")

    return run(low(text))


def joined(text: Column) -> Column:
    """All tokens in order, with a space between."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        kept: dict[str, str] = {}
        out = []
        for t in x:
            found = words(t)
            if len(kept) > KEPT:
                kept.clear()
            for w in found:
                if w not in kept:
                    kept[w] = " ".join([w, *map(add, w, w[1:]), *w])
            out.append(" ".join([kept[w] for w in found]))
        return pd.Series(out, dtype="object")

    return run(low(text))


def counted(texts: DataFrame, ordered: bool = False) -> DataFrame:
    """(key, doc_len, postings) of rows (key, texts): the tokens of all texts of a row, which are lower-case; `ordered`: a row's
    postings are in the order of terms."""
    key = texts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, first, lengths, starts, terms, tf = b.column(0), 0, [], [0], [], []

            def made() -> pa.RecordBatch:
                each = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tf, pa.int64())], ["term", "tf"])
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), each)
                return pa.RecordBatch.from_arrays([keys.slice(first, len(lengths)), pa.array(lengths, pa.int64()), lists], ["key", "doc_len", "postings"])

            for some in b.column(1):
                found = frequencies(" ".join(some.as_py()))
                each = sorted(found) if ordered else list(found)
                terms += each
                tf += map(found.__getitem__, each)
                lengths.append(found.total())
                starts.append(len(terms))
                if len(terms) >= BATCH:
                    yield made()
                    first, lengths, starts, terms, tf = first + len(lengths), [], [0], [], []
            yield made()

    return texts.select("key", "texts").mapInArrow(run, f"key {key}, doc_len long, postings array<struct<term:string,tf:long>>")


def by_term(forward: DataFrame) -> DataFrame:
    """(term, doc_id, tf, at) of rows (doc_id, at, terms, tf), in the order of (term, doc_id) within blocks of some `BLOCK` rows that
    follow each other, so that sorting takes bounded memory and no disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> Iterator[pa.RecordBatch]:
            doc_id, at, terms, tf = pa.Table.from_batches(held).combine_chunks().columns
            held.clear()
            row = np.repeat(np.arange(len(doc_id), dtype=np.int32), pc.list_value_length(terms).to_numpy())
            term, tf = terms.combine_chunks().flatten().dictionary_encode(), tf.combine_chunks().flatten()
            rank, place = np.empty(len(term.dictionary), np.int64), np.empty(len(doc_id), np.int64)
            rank[pc.sort_indices(term.dictionary).to_numpy()] = np.arange(len(rank))
            place[np.argsort(doc_id.to_numpy(), kind="stable")] = np.arange(len(place))
            key = rank[term.indices.to_numpy()]
            key *= len(place)
            key += place[row]
            order = np.argsort(key)
            del key
            for start in range(0, len(order), BATCH):
                some = order[start : start + BATCH]
                of = pa.array(row[some])
                columns = [term.take(pa.array(some)).dictionary_decode(), doc_id.combine_chunks().take(of), tf.take(pa.array(some)), at.combine_chunks().take(of)]
                yield pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "tf", "at"])

        size = 0
        for b in batches:
            held.append(b)
            size += len(b.column(2).flatten())
            if size >= BLOCK:
                yield from made()
                pa.default_memory_pool().release_unused()
                size = 0
        if size:
            yield from made()

    # A batch has so many rows at most, so long lists are parted.
    n, most = F.size("terms"), F.lit(64)
    parted = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / most)), lambda i: F.struct(F.slice("terms", i * most + 1, most).alias("terms"), F.slice("tf", i * most + 1, most).alias("tf")))
    rows = forward.where(n > 0).select("doc_id", "at", F.inline(parted))
    return rows.mapInArrow(run, "term string, doc_id long, tf long, at long")


def impacts(blocks: DataFrame, k1: float, b: float, mean: float) -> DataFrame:
    """(term, block, docs) of rows (block, texts), texts being structs (doc_id, doc_len, text) with lower-case texts: the documents
    of a block that have a term, with the part of their score that doesn't depend on the query."""
    doc_id = blocks.schema["texts"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).type.value_type.field("doc_id").type
            for block, some in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts: dict[int, list[str]] = {}
                lengths = {}
                for x in some.as_py():
                    texts.setdefault(x["doc_id"], []).append(x["text"])
                    lengths[x["doc_id"]] = x["doc_len"]
                places: dict[str, int] = {}
                term, tf, width = [], [], []
                for d in texts:
                    found = frequencies(" ".join(texts[d]))
                    term += [places.setdefault(t, len(places)) for t in found]
                    tf += found.values()
                    width.append(len(found))
                if not places:
                    continue
                term, tf, doc = np.array(term), np.array(tf, float), np.repeat(np.arange(len(texts)), width)
                norm = k1 * (1 - b + b * np.array([lengths[d] for d in texts], float) / mean)
                order = np.argsort(term, kind="stable")
                impact = (tf * (k1 + 1) / (tf + norm[doc]))[order]
                each = pa.StructArray.from_arrays([pa.array(list(texts), ids).take(pa.array(doc[order])), pa.array(impact)], ["doc_id", "impact"])
                starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(places)))]).astype(np.int32)
                columns = [pa.array(list(places), pa.string()), pa.array(np.full(len(places), block), pa.int64()), pa.ListArray.from_arrays(pa.array(starts), each)]
                yield pa.RecordBatch.from_arrays(columns, ["term", "block", "docs"])

    return blocks.select("block", "texts").mapInArrow(run, f"term string, block long, docs array<struct<doc_id:{doc_id},impact:double>>")
