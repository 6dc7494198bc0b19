"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, word pairs and pairs with one word between them of a whole text, hashed to `1 << BITS`
coordinates, present or not. Training is online with a learning rate per coordinate and an L1 term that leaves few
weights; only these are sent to the executors. It runs on the driver, over the feature numbers of at most `sample`
labelled rows in the order of a hash, as many of either label (features are computed on the executors).

Defined cases: a null or empty text has no feature and scores the bias alone; a very long text is scored whole; a row of
the labels without its document (or with a null label or id) is not learned from; of several texts of one id the
smallest is learned from, once for each label of the id; without any label all scores are 0.5, and a score of 0.5 counts
as toxic; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import bucket_of, first_of_each

BITS = 20
WORD = re.compile(rb"[a-z\x80-\xff]+")
Weights = tuple[np.ndarray, np.ndarray, float]  # coordinates, their weights, bias


def coordinates(text: str | None) -> np.ndarray:
    """Hashed features of a whole text, in order, repeats included."""
    h = np.fromiter(map(zlib.crc32, WORD.findall((text or "").lower().encode("utf-8", "replace"))), np.uint32)
    h = h.astype(np.uint64)
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    skip = h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:] * np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate([h * np.uint64(0xFF51AFD7ED558CCD), pair, skip]) >> np.uint64(64 - BITS)


def ftrl(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.1, epochs: int = 4, positive: float | None = None) -> Weights:
    """FTRL-proximal over the rows in the given order; `positive` weighs the gradients of label 1.

    Where it isn't given, it is half of what would make both labels count alike, from 1 to 10.
    """
    if positive is None:
        positive = float(np.clip(0.5 * (len(y) - y.sum()) / max(1.0, y.sum()), 1, 10))
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias, without L1

    def weights(at: np.ndarray) -> np.ndarray:
        part = z[at]
        cut = np.where(at == size, 0.0, l1)
        return np.where(np.abs(part) <= cut, 0.0, (np.sign(part) * cut - part) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for row, label in zip(rows, y.tolist()):
            at = np.append(row, size)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            g *= positive if label else 1.0
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
    at = np.flatnonzero(np.abs(z[:-1]) > l1)
    return at, weights(at), float(weights(np.array([size]))[0])


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None, sample: int = 8000, **settings) -> Weights:
    """Weights from at most `sample` labelled rows."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (F.lit(True) if learn is None else learn))
    chosen = chosen.select(F.col(doc_id).alias("id"), (F.col(label).cast("int") > 0).cast("int").alias("y"), F.xxhash64(F.lit("toxicity"), F.col(doc_id)).alias("h")).distinct()
    chosen = first_of_each(chosen, "h", "y", sample, "id")
    texts = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    # At most `sample` rows of 20 bytes are broadcast, so that the texts aren't shuffled; then one text of each id stays.
    rows = texts.join(F.broadcast(chosen), "id").groupBy("h", "id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "y": b["y"], "at": [np.unique(coordinates(t)).astype(np.int32).tobytes() for t in b["text"]]})

    got = rows.mapInPandas(run, "h long, y int, at binary").toPandas().sort_values(["h", "y"], kind="stable")
    if got.empty:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return ftrl([np.frombuffer(a, np.int32) for a in got["at"]], got["y"].to_numpy(float), **settings)


def score(df: DataFrame, model: Weights, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score), one row for each row of df."""
    at, w, bias = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = np.zeros(1 << BITS)
        dense[at] = w

        def one(t: str | None) -> float:
            found = coordinates(t)
            found = np.unique(found[dense[found] != 0])
            return float(1 / (1 + np.exp(-np.clip(dense[found].sum() + bias, -35, 35))))

        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [one(t) for t in b["text"]]})

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, score double")


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows to learn from; the rest is held out."""
    return bucket_of(doc_id, 5) != 0
