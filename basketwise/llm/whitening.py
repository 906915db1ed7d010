"""Whitening of embeddings by a covariance weighted with multiplicities.

Equal vectors are one: they are centred, multiplied and projected once, with their number as weight, and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Entries become whole numbers of 1/64, moved up.
SCALE, SHIFT = 64, 1_000_000
_LONG = (1 << 63) - 1


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, x)`` of rows whose vector has only finite entries: whole numbers ``floor(64 c) + 1000000``."""
    odd = F.exists(vector_col, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    entry = lambda c: F.when(F.abs(c.cast("double")) < 2.0**50, F.floor(c.cast("double") * SCALE) + SHIFT).otherwise(F.raise_error(F.lit("an entry is too large")).cast("long"))
    return df.where(F.col(vector_col).isNotNull() & ~odd).select(F.col(id_col).alias("id"), F.transform(vector_col, entry).alias("x"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), size)


def exact_sums(table: DataFrame, size: int) -> list[int]:
    """Weighted sums of ``x`` by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * size
        for batch in batches:
            x, c = matrix(batch.column("x"), size), np.asarray(batch.column("c"))
            if len(c) and float(np.abs(x).max(initial=0)) * float(c.sum()) >= 2.0**62:
                x, c = x.astype(object), c.astype(object)
            sums = [a + int(b) for a, b in zip(sums, c @ x)]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([str(s) for s in sums])], ["j", "s"])

    found = table.select("x", "c").mapInArrow(run, "j int, s string").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = {r["j"]: int(r["s"]) for r in found}
    return [out.get(j, 0) for j in range(size)]


def covariance(table: DataFrame, column: str, size: int, centred, n: int) -> np.ndarray:
    """The weighted covariance (divisor ``n``) of ``column`` after ``centred(matrix)``: a product of matrices a batch, sums of one
    triangle a task."""
    low, high = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((size, size))
        for batch in batches:
            m = centred(matrix(batch.column(column), size))
            gram += m.T @ (m * np.asarray(batch.column("c"))[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(gram[low, high])], ["cell", "v"])

    found = table.select(column, "c").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((size, size))
    at = [r["cell"] for r in found]
    out[low[at], high[at]] = [r["v"] / n for r in found]
    return out + np.triu(out, 1).T


def weighted_mean(table: DataFrame, column: str, size: int, n: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for batch in batches:
            sums += np.asarray(batch.column("c")) @ matrix(batch.column(column), size)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(sums)], ["j", "s"])

    found = table.select(column, "c").mapInArrow(run, "j int, s double").groupBy("j").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(size)
    for r in found:
        out[r["j"]] = r["s"] / n
    return out


def principal(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns. Those that are 0 but for rounding
    are left out: nothing can be divided by their root."""
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1]
    real = value > max(value[0], 0.0) * len(v) * 1e-13 if len(v) else np.zeros(0, bool)
    return value[real][:components], vector[:, real][:, :components]


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """The sum over dimensions of ``(n x - S)**2``, exactly; null where a long doesn't hold it."""
    if not len(x):
        return []
    far = max(float(np.abs(x).max(initial=0)) * n, float(max(map(abs, sums), default=0)))
    if far < 2.0**61:
        off = x * n - np.array(sums, np.int64)
        if float(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return (off * off).sum(1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
    return [int(d) if d <= _LONG else None for d in exact]


def whitened(df: DataFrame, components: int = 32, weights: str = "count", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component.

    Vectors that are null or hold null or non-finite entries are left out; entries become whole numbers. Equal vectors are
    grouped; with ``weights="count"`` the fit list holds each as often as there are rows of it, with ``"one"`` once.
    ``n`` is the size of the fit list, S its sums by dimension; the covariance is a product of centred vectors weighted so.
    Components are its unit eigenvectors by falling eigenvalue, ``components`` at most and none whose eigenvalue is 0 but for
    rounding (of equal vectors, or a single one, there is none, and so no row). ``deviation`` is exact, null where it
    exceeds a long; ``explained`` is the eigenvalue's share of the trace; ``identity_error`` the largest entry by which the
    fit list's whitened covariance differs from the identity, one value for all rows.

    Repeated rows each give rows, equal to those of their vector; ties between eigenvalues leave their vectors free within
    their plane; null ids stay; other columns play no part; an empty table gives no rows. Vectors of several lengths, and
    entries of 2**50 or more, are an error. Squares of the dimension, and nothing else, reach the driver and each task.
    """
    if weights not in ("count", "one"):
        raise ValueError(f"unknown weights: {weights}")
    rows = whole_vectors(df, id_col, vector_col)
    once = rows.groupBy("x").agg(F.count("*").alias("rows"))
    table = written(once.select("x", (F.col("rows") if weights == "count" else F.lit(1)).cast("long").alias("c")), "vectors")
    about = table.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("size"), F.sum("c").alias("n")).first()
    n, size = about["n"] or 0, about["size"] or 0
    if about["low"] != about["size"]:
        raise ValueError(f"vectors of several lengths: {about['low']} to {about['size']}")
    sums = exact_sums(table, size)
    high = np.array(sums, object)
    # n x - S is whole and small where vectors lie close; only its quotient is rounded
    whole = all(abs(s) < 2**61 for s in sums)

    def off_centre(x: np.ndarray) -> np.ndarray:
        if whole and float(np.abs(x).max(initial=0)) * n < 2.0**61:
            return (x * n - high.astype(np.int64)).astype(np.float64) / n
        return ((x.astype(object) * n - high) / n).astype(np.float64)

    spread = covariance(table, "x", size, off_centre, n) if n else np.zeros((0, 0))
    value, vector = principal(spread, components)
    k, trace = len(value), float(np.trace(spread))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), size)
            w = off_centre(x) @ vector / np.sqrt(value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("c"), pa.array(deviations(x, sums, n), pa.int64()), lists], ["x", "c", "deviation", "w"])

    each = written(table.mapInArrow(project, "x array<long>, c long, deviation long, w array<double>"), "whitened")
    mean = weighted_mean(each, "w", k, n)
    error = float(np.abs(covariance(each, "w", k, lambda w: w - mean, n) - np.eye(k)).max()) if k else 0.0
    joined = rows.join(each.select("x", "deviation", "w"), "x")
    shares = F.array(*(F.lit(float(e) / trace) for e in value)).cast("array<double>")
    long = joined.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
