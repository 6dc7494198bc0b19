"""Embedding whitening: leading principal components by matrix-free block Lanczos.

1. Entries become integers (floor(scale * c)); each distinct vector is kept once: the fit list, stored in the shared folder.
   Its n and per-dimension sums S are exact.
2. The covariance is never formed. A pass over the fit list multiplies it with a block V: every task sums
   (x - S/n)'((x - S/n) V) of its vectors, centred before multiplying, and Spark adds up the entries of the d x block results.
3. Block Lanczos with full reorthogonalisation on the driver, which holds d x (basis) numbers. Directions of a new block that
   are in the span of the basis already (breakdown) are replaced by random ones at right angles to it. The iteration ends when
   the residuals of the wanted Ritz pairs are small, or the basis spans the whole space.
4. The trace comes from the exact deviations sum (n x - S)^2 of the fit list, and gives the explained shares.
5. All rows are projected in one pass; another one over the fit list gives the covariance of what came out.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped, all others stay, also repeated ones
and those with a null id; a shorter vector counts as filled with zeros up to the longest one, an empty vector is all zeros;
equal eigenvalues give some orthonormal vectors of their space; a component whose eigenvalue is zero up to rounding has no
whitened values, so it gives no rows (a single distinct vector gives none at all); a component's entry of largest size is
positive, so reruns agree; other columns are ignored; an empty table gives an empty one. Deviations are decimal(38, 0).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import store

EPS = float(np.finfo(np.float64).eps)
WHOLE = "decimal(38,0)"


def quantised(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, x) of the rows with a sound vector, filled up to one width."""
    v = F.col(vector)
    sound = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return df.where(sound).select(F.col(vec_id).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) - mean


def _added(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the tasks' matrices: an entry of each a row, added by Spark."""
    rows = parts.groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape[0] * shape[1])
    for r in rows:
        out[r["k"]] = r["v"]
    return out.reshape(shape)


def _over(fit: DataFrame, d: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of part(x) over the batches of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += part(_matrix(b.column("x"), d))
        yield pa.RecordBatch.from_pydict({"k": np.arange(total.size, dtype=np.int32), "v": total.reshape(-1)})

    return _added(fit.select("x").mapInArrow(run, "k int, v double"), shape)


def lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = 8, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the k largest eigenvalues of a symmetric operator of d dimensions, given by its products."""
    rng = np.random.default_rng(seed)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))

    def orthonormal(w: np.ndarray, size: float) -> np.ndarray:
        """Directions of w beside the basis; random ones where it has too few."""
        out = np.zeros((d, 0))
        wanted = min(w.shape[1], d - basis.shape[1])
        for column in [*w.T, *(rng.standard_normal((d, 1)) for _ in range(3 * wanted))]:
            if out.shape[1] == wanted:
                break
            c = column.reshape(d)
            least = size if column.ndim == 1 else 0.0
            before = float(np.linalg.norm(c))
            for _ in range(3):  # more than once, as rounding leaves traces of the basis
                c = c - basis @ (basis.T @ c)
                c = c - out @ (out.T @ c)
            after = float(np.linalg.norm(c))
            if after > max(least, 1e3 * EPS * before):
                out = np.column_stack([out, c / after])
        return out

    q = orthonormal(rng.standard_normal((d, min(block, d))), 0.0)
    while True:
        w = times(q)
        basis, image = np.column_stack([basis, q]), np.column_stack([image, w])
        projected = basis.T @ image
        values, vectors = np.linalg.eigh((projected + projected.T) / 2)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        ritz = basis @ vectors
        size = float(np.abs(values).max(initial=0.0))
        residual = np.linalg.norm(image @ vectors - ritz * values, axis=0).max(initial=0.0)
        # With k values at hand the basis is one larger at least, so that none hides that is equal to the last.
        if basis.shape[1] == d or (basis.shape[1] > k and residual <= 64 * EPS * size):
            return values, ritz
        q = orthonormal(w, 1e3 * EPS * size)


def _deviations(x: np.ndarray, n: int, s: list[int]) -> pa.Array:
    """sum (n x - S)^2 of each row, exact: in longs where these hold it, else in Python's integers."""
    most = (int(np.abs(x).max(initial=0)) + 1) * n + max(map(abs, s), default=0)
    if most * most * max(1, len(s)) < 2**63:
        t = x.astype(np.int64) * n - np.array(s, np.int64)
        return pa.array((t * t).sum(axis=1)).cast(pa.decimal128(38, 0))
    t = x.astype(object) * n - np.array(s, object)
    return pa.array([Decimal(int(v)) for v in (t * t).sum(axis=1)], pa.decimal128(38, 0))


def whiten(df: DataFrame, k: int = 4, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and each of the first k components."""
    rows = quantised(df, vec_id, vector, scale)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation {WHOLE}, whitened double, explained double, identity_error double"
    d = rows.agg(F.max(F.size("x"))).first()[0]
    if not d:  # no row, or no dimension
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))
    fit = store(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    total = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast(WHOLE)).alias("s"), F.count("*").alias("n")).collect()
    n, s = total[0]["n"], [int(r["s"]) for r in sorted(total, key=lambda r: r["i"])]
    mean = np.array([v / n for v in s])

    def times(v: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, mean)
            return c.T @ (c @ v)

        return _over(fit, d, v.shape, part) / n

    def deviation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"t": _deviations(_matrix(b.column("x"), d), n, s)})

    values, vectors = lanczos(times, d, k, block)
    trace = int(fit.mapInArrow(deviation, f"t {WHOLE}").agg(F.sum("t")).first()[0]) / n**3
    sound = values > 1e4 * EPS * max(trace, 0.0)
    values, vectors = values[sound], vectors[:, sound]
    if not len(values):
        return df.sparkSession.createDataFrame([], schema)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    to_white = vectors / np.sqrt(values)
    m = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = _centred(x, mean) @ to_white
        return np.vstack([z.T @ z, z.sum(axis=0)])

    second = _over(fit, d, (m + 1, m), moments) / n
    error = float(np.abs(second[:m] - np.outer(second[m], second[m]) - np.eye(m)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"), d)
            each = pa.array(np.repeat(np.arange(len(x)), m))
            count = len(each)
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("id").take(each),
                "component": np.tile(np.arange(1, m + 1, dtype=np.int32), len(x)),
                "n": np.full(count, n, np.int64),
                "deviation": _deviations(x, n, s).take(each),
                "whitened": (_centred(x, mean) @ to_white).reshape(-1),
                "explained": np.tile(explained, len(x)),
                "identity_error": np.full(count, error),
            })

    return rows.mapInArrow(project, schema)


def digest(whitened: DataFrame) -> DataFrame:
    """Deviations as longs; one that a long can't hold is an error, not a wrong number."""
    return whitened.withColumn("deviation", F.col("deviation").cast("long"))
