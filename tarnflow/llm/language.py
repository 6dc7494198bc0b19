"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads windows of `WINDOW` bytes in both directions, gives each position a distribution over the languages,
and a document's probabilities are the mean over all positions of its whole text. It is trained in numpy by
backpropagation through time, on the driver, on a bounded sample of labelled rows (`sample` documents, as many of each
language, read whole, of all whose pieces at most `pieces`); scoring runs on the executors in blocks of `BLOCK` windows, whatever
the texts' lengths.

Defined cases: a null text, or one without a letter, gives `und` with score 0; where no row has a label to learn from,
all rows give `und`; equal probabilities go to the language that is first in order; repeated rows are scored alike; rows
with a null id are scored and never learned from; other columns are ignored, or kept where `keep` is set, but for
columns named `lang_pred` and `score`, which are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.common import bucket_of, first_of_each, release, store

WINDOW, BLOCK, UNKNOWN = 128, 1024, "und"
Params = dict[str, np.ndarray]
GATES = "zrn"


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (rows of bytes, zero-padded), bytes in each, and the text each is of."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    out = np.zeros((int(counts.sum()), WINDOW), np.uint8)
    filled = np.full(len(out), WINDOW, np.int64)
    flat, at = out.reshape(-1), 0
    for t, n in zip(texts, counts.tolist()):
        flat[at * WINDOW : at * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
        at += n
        if n:
            filled[at - 1] = len(t) - (n - 1) * WINDOW
    return out, filled, np.repeat(np.arange(len(texts)), counts)


def init(hidden: int, labels: int, rng: np.random.Generator) -> Params:
    p: Params = {"c": np.zeros(labels, np.float32)}
    for way in "fb":
        for g in GATES:
            p[f"{way}E{g}"] = (rng.standard_normal((256, hidden)) * 0.3).astype(np.float32)
            p[f"{way}U{g}"] = (rng.standard_normal((hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        p[f"{way}W"] = (rng.standard_normal((hidden, labels)) / np.sqrt(hidden)).astype(np.float32)
    return p


def _run(p: Params, way: str, x: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States (time, window, hidden) of one direction; x is (time, window). tape collects what BPTT needs."""
    steps, n = x.shape
    hidden = p[f"{way}Uz"].shape[0]
    out = np.empty((steps, n, hidden), np.float32)
    h = np.zeros((n, hidden), np.float32)
    (ez, er, en), (uz, ur, un) = ([p[f"{way}{kind}{g}"] for g in GATES] for kind in "EU")
    z, r, c, u = (np.empty((n, hidden), np.float32) for _ in range(4))
    half = np.float32(0.5)
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        if tape is not None:
            z, r, c, u = (np.empty((n, hidden), np.float32) for _ in range(4))
        for gate, e, w in ((z, ez, uz), (r, er, ur)):  # sigmoid(a) = (tanh(a / 2) + 1) / 2
            np.dot(h, w, out=gate)
            gate += e[x[t]]
            gate *= half
            np.tanh(gate, out=gate)
            gate *= half
            gate += half
        np.dot(h, un, out=u)
        np.multiply(r, u, out=c)
        c += en[x[t]]
        np.tanh(c, out=c)
        new = out[t]
        np.subtract(h, c, out=new)
        new *= z
        new += c
        if tape is not None:
            tape.append((t, h, z, r, c, u))
        h = new
    return out


def _positions(p: Params, x: np.ndarray, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of every position (time, window, label), and the states of both directions."""
    f, b = (_run(p, way, x, tapes and tapes[k]) for k, way in enumerate("fb"))
    a = f @ p["fW"]
    a += b @ p["bW"]
    a += p["c"]
    a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=2, keepdims=True)
    return a, f, b


def _states(p: Params, way: str, x: np.ndarray) -> np.ndarray:
    """States of `_run` up to rounding, (time * window, hidden), for scoring: both gates in one array, signs and factors in the
    weights, and exponentials, which take half the time of hyperbolic tangents."""
    steps, n = x.shape
    hidden = p[f"{way}Uz"].shape[0]
    ez, er, uz, ur = (-p[f"{way}{k}"] for k in ("Ez", "Er", "Uz", "Ur"))
    en, un = 2 * p[f"{way}En"], 2 * p[f"{way}Un"]
    out, h = np.empty((steps, n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    gates, e = (np.empty((2, n, hidden), np.float32) for _ in range(2))
    c, u = (np.empty((n, hidden), np.float32) for _ in range(2))
    with np.errstate(over="ignore"):  # what overflows is a gate of 0, or a state of 1
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            np.dot(h, uz, out=gates[0])
            np.dot(h, ur, out=gates[1])
            np.take(ez, x[t], 0, out=e[0], mode="clip")
            np.take(er, x[t], 0, out=e[1], mode="clip")
            gates += e
            np.exp(gates, out=gates)
            gates += 1
            np.divide(1, gates, out=gates)  # sigmoid(a) = 1 / (1 + exp(-a))
            np.dot(h, un, out=u)
            np.multiply(gates[1], u, out=c)
            np.take(en, x[t], 0, out=u, mode="clip")
            c += u
            np.exp(c, out=c)
            c += 1
            np.divide(-2, c, out=c)  # tanh(a) = 1 - 2 / (1 + exp(2 a))
            c += 1
            new = out[t]
            np.subtract(h, c, out=new)
            new *= gates[0]
            new += c
            h = new
    return out.reshape(-1, hidden)


def _scored(p: Params, x: np.ndarray) -> np.ndarray:
    """Label probabilities of every position, (label, time, window)."""
    steps, n = x.shape
    x = x.astype(np.intp)
    a = p["fW"].T @ _states(p, "f", x).T
    a += p["bW"].T @ _states(p, "b", x).T
    a += p["c"][:, None]
    a -= a.max(axis=0)
    np.exp(a, out=a)
    a /= a.sum(axis=0)
    return a.reshape(-1, steps, n)


def gradients(p: Params, x: np.ndarray, filled: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy over all filled positions, and its gradients by backpropagation through time."""
    tapes: tuple[list, list] = ([], [])
    a, f, b = _positions(p, x, tapes)
    real = np.arange(len(x))[:, None] < filled[None, :]
    total = real.sum()
    loss = -np.log(np.maximum(a[:, np.arange(x.shape[1]), y][real], 1e-9)).mean()
    a[:, np.arange(x.shape[1]), y] -= 1
    a *= (real / total)[:, :, None].astype(np.float32)
    g: Params = {"c": a.sum(axis=(0, 1))}
    for way, states, tape in (("f", f, tapes[0]), ("b", b, tapes[1])):
        hidden = states.shape[2]
        g[f"{way}W"] = states.reshape(-1, hidden).T @ a.reshape(-1, a.shape[2])
        out = a @ p[f"{way}W"].T
        dh = np.zeros_like(out[0])
        grads = {k: np.zeros((hidden, hidden), np.float32) for k in GATES}
        gates = {k: np.empty_like(states) for k in GATES}
        for t, before, z, r, c, u in reversed(tape):
            dh = dh + out[t]
            dc = dh * (1 - z) * (1 - c * c)
            du = dc * r
            dr = dc * u * r * (1 - r)
            dz = dh * (before - c) * z * (1 - z)
            for k, d, e in (("z", dz, dz), ("r", dr, dr), ("n", du, dc)):
                grads[k] += before.T @ d
                gates[k][t] = e
            dh = dh * z + dz @ p[f"{way}Uz"].T + dr @ p[f"{way}Ur"].T + du @ p[f"{way}Un"].T
        for k in GATES:
            g[f"{way}U{k}"] = grads[k]
            flat = gates[k].reshape(-1, hidden)
            g[f"{way}E{k}"] = np.stack([np.bincount(x.reshape(-1), flat[:, i], 256) for i in range(hidden)], axis=1).astype(np.float32)
    return float(loss), g


def fit(x: np.ndarray, filled: np.ndarray, y: np.ndarray, labels: int, hidden: int = 16, steps: int = 300, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    p = init(hidden, labels, rng)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        _, g = gradients(p, np.ascontiguousarray(x[pick].T), filled[pick], y[pick])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        lr = rate * (1 - step / (steps + 1))
        for k, a in g.items():
            a *= min(1.0, 1.0 / max(norm, 1e-12))
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.01 * (a * a - v[k])
            p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", learn: Column | None = None, sample: int = 4000, pieces: int = 1 << 18, **settings) -> tuple[list[str], Params]:
    """Languages and network, from at most `sample` labelled rows in the order of a hash, equally many of each language.

    Whole texts are cut into pieces of `WINDOW` characters, labelled like their text; of more than about `pieces` of them, which
    bounds what the driver holds, those with the smallest hashes are learned from, wherever they stand.
    """
    n, t = F.length(text), F.col(text).cast("string")
    rows = df.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (n > 0) & (F.lit(True) if learn is None else learn))
    rows = rows.select(F.xxhash64(F.lit("language"), F.col(doc_id)).alias("h"), F.col(doc_id).alias("id"), F.col(label).alias("label"), t.alias("w"))
    rows = store(first_of_each(rows, "h", "label", sample, "id", "w"))
    total = rows.agg(F.sum(F.ceil(F.length("w") / WINDOW))).first()[0] or 0
    cut = F.regexp_extract_all("w", F.lit(f"(?s).{{1,{WINDOW}}}"), 0)
    parts = rows.select("h", "id", "label", F.posexplode(cut).alias("at", "w")).withColumn("place", F.xxhash64("h", "at"))
    if total > pieces:
        parts = parts.where(F.col("place") < int(-(2**63) + pieces / total * 2**64))
    got = parts.orderBy("place", "id", "label", "at", "w").select("label", "w").toPandas()
    release(rows)
    names = sorted(got["label"].unique())
    if not names:
        return [], {}
    x, filled, of = windows([w.encode("utf-8", "replace") for w in got["w"]])
    return names, fit(x, filled, np.searchsorted(names, got["label"].to_numpy(str))[of], len(names), **settings)


def probabilities(p: Params, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities over all positions of each text; rows of zeros for empty texts."""
    x, filled, of = windows(texts)
    sums = np.zeros((len(texts), len(p["c"])))
    for at in range(0, len(x), BLOCK):
        part = np.ascontiguousarray(x[at : at + BLOCK].T)
        a = _scored(p, part)
        a *= np.arange(WINDOW)[:, None] < filled[None, at : at + BLOCK]
        np.add.at(sums, of[at : at + BLOCK], a.sum(axis=1, dtype=np.float64).T)
    return sums / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def identify(df: DataFrame, model: tuple[list[str], Params], doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score), one row for each row of df; with `keep`, df and these two columns instead."""
    names, p = model

    def predicted(part: pd.Series) -> tuple[list[str], np.ndarray]:
        known = np.array([bool(names) and t is not None and any(map(str.isalpha, t)) for t in part], bool)
        if not known.any():
            return [UNKNOWN] * len(part), np.zeros(len(part))
        q = probabilities(p, [t.encode("utf-8", "replace") if k else b"" for t, k in zip(part, known)])
        best = q.argmax(axis=1)
        return [names[i] if k else UNKNOWN for i, k in zip(best, known)], np.where(known, np.clip(q[np.arange(len(q)), best], 0, 1), 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                lang, score = predicted(part.iloc[:, 1] if not keep else part[text])
                yield (part if keep else part.iloc[:, :1]).assign(lang_pred=lang, score=score)

    rows = df.drop("lang_pred", "score") if keep else df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    fields = (rows if keep else rows.select("doc_id")).schema
    return rows.mapInPandas(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def least_right(scored: DataFrame, held: Column, label: str = "lang", share: float = 0.8) -> float:
    """Score below which a text has no language of the model: `share` of the lowest score that any held-out row of `scored`
    (`identify` with `keep`) has whose label the network predicts; 0 where there is none."""
    lowest = scored.where(held & (F.col("lang_pred") == F.col(label)) & (F.col("lang_pred") != UNKNOWN)).agg(F.min("score")).first()[0]
    return share * (lowest or 0.0)


def least_score(df: DataFrame, model: tuple[list[str], Params], held: Column, doc_id: str = "doc_id", text: str = "text", label: str = "lang", share: float = 0.8) -> float:
    """`least_right` of all held-out rows of df with a label, which it scores."""
    rows = df.where(F.col(label).isNotNull() & (F.length(text) > 0) & held)
    rows = rows.select(F.col(doc_id).alias("id"), F.col(label).alias("label"), F.col(text).cast("string").alias("text"))
    return least_right(identify(rows, model, "id", "text", keep=True), F.lit(True), "label", share)


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows to learn from; the rest is held out."""
    return bucket_of(doc_id, 4) != 2
