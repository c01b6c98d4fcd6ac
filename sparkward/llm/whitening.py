"""Whitening of embeddings by a one-sided Jacobi SVD.

Entries become whole numbers, x = floor(64 c) + 1000000, and each distinct vector x enters the fit once. Sums are exact,
so a row is centred without loss before anything is multiplied: x - S/n = (x - q) - r/n with S = q n + r. Every task
reduces its rows to a triangle R by QR factorisations of [R; rows] (TSQR), and triangles are reduced in the same way, a
few to a task, until one is left. Plane rotations then make the columns of R orthogonal: their lengths are the singular
values, and the rotations, gathered, are the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import base
from sparkward.llm.vectors import matrices

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries beyond this are clipped, so that whole numbers stay exact in doubles.
MOST = float(1 << 40)
#: Triangles that one task reduces to one, sweeps of plane rotations at most.
FAN, SWEEPS = 32, 60


def whole(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """x of a vector of doubles, by built-in functions."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c)) * scale).cast("long") + offset)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == math.inf))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - S/n with whole numbers subtracted as such."""
    q = np.array([s // n for s in sums], np.float64)
    r = np.array([s % n / n for s in sums])
    return (x - q) - r


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _local(sums: list[int], n: int):
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                r = _triangle(np.concatenate((r, centred(x, sums, n))))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    return run


def _merged(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                r = _triangle(np.concatenate((r, np.frombuffer(raw, np.float64).reshape(-1, d))))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    return run


def tsqr(spark: SparkSession, vectors: DataFrame, sums: list[int], n: int) -> np.ndarray:
    """R of the centred rows of vectors (one column of whole numbers); the driver gets FAN triangles at most."""
    d = len(sums)
    parts, _ = base.written(spark, vectors.mapInArrow(_local(sums, n), "r binary"), "triangles")
    count = parts.count()
    while count > FAN:
        parts, _ = base.written(spark, parts.repartition(-(-count // FAN)).mapInArrow(_merged(d), "r binary"), "triangles")
        count = parts.count()
    r = np.zeros((0, d))
    for row in parts.collect():
        r = _triangle(np.concatenate((r, np.frombuffer(row["r"], np.float64).reshape(-1, d))))
    return r


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors, as columns) of r by one-sided Jacobi rotations.

    A round turns disjoint pairs of columns at once, and the rounds of a sweep meet every pair. The sign of a vector is
    that its entry of largest size is positive.
    """
    d = r.shape[1]
    a = np.zeros((max(len(r), 1), d))
    a[: len(r)] = r
    v = np.eye(d)
    players = list(range(d)) + [-1] * (d % 2)
    half = len(players) // 2
    for _ in range(SWEEPS):
        off = 0.0
        ring = players[:]
        for _ in range(len(players) - 1):
            pairs = [(x, y) for x, y in zip(ring[:half], ring[half:][::-1], strict=True) if x >= 0 and y >= 0]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = (np.array(c, int) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha * beta)
            turn = np.abs(gamma) > 1e-16 * size
            if not turn.any():
                continue
            off = max(off, float((np.abs(gamma[turn]) / size[turn]).max()))
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if off < 1e-15:
            break
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    v = v[:, order]
    v *= np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    return sigma[order], v


def _gathered(sums: list[int], n: int, axes: np.ndarray):
    """The sums of z and of its products over a task's rows, as doubles."""
    k = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                z = centred(x, sums, n) @ axes
                total += z.sum(0)
                products += z.T @ z
        at = [(i, -1, float(total[i])) for i in range(k)] + [(i, j, float(products[i, j])) for i in range(k) for j in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*at, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["i", "j", "s"])

    return run


def _projected(sums: list[int], n: int, axes: np.ndarray, explained: list[float], error: float):
    k = axes.shape[1]
    largest = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column(1)):
                z = centred(x, sums, n) @ axes
                gap = [[n * a - s for a, s in zip(row, sums, strict=True)] for row in x.astype(np.int64).tolist()]
                far = [sum(g * g for g in row) for row in gap]
                far = [f if f <= largest else None for f in far]
                ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
                at = np.repeat(np.arange(len(rows)), k)
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(at), n, np.int64)), pa.array([f for f in far for _ in range(k)], pa.int64()),
                    pa.array(z.ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(len(at), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


_TOLD = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(spark: SparkSession, rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and leading component.

    Rows whose vector is null or holds null, NaN or infinite entries are dropped, and so are those whose length is not
    the most frequent one of the different vectors (of equals the longest). Entries beyond 2^40 are clipped. Rows that
    repeat enter the fit once and are returned as often as they stand there; null ids are kept. A component without
    variance (under 1e-13 of the largest deviation) has no whitened form and is left out, so fewer different rows than
    dimensions give fewer components, and one different row none. deviation is null where it is beyond a long. An empty
    table gives an empty one. Only ids and vectors are read, so other columns may have any name. The driver holds the
    sums and a few triangles, whose size is that of the vectors and not of the table.
    """
    vector = F.col(vector_col).cast("array<double>")
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    coded, _ = base.written(spark, given.select("vec_id", whole(F.col("v"), scale, offset).alias("x")), "whole")
    fit, _ = base.written(spark, coded.select("x").distinct(), "fit")
    sizes = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], _TOLD)
    d, n = sizes["d"], sizes["count"]
    fit, coded = fit.where(F.size("x") == d), coded.where(F.size("x") == d)
    sums = [int(s) for s in fit.agg(*(F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d))).first()]
    sigma, v = jacobi(tsqr(spark, fit, sums, n))
    k = min(components, d, int((sigma > 1e-13 * sigma[0]).sum()))
    if not k:
        return spark.createDataFrame([], _TOLD)
    spread = sigma / math.sqrt(n)
    axes = v[:, :k] / spread[:k]
    explained = [float(x) for x in spread[:k] ** 2 / (spread**2).sum()]
    at = {(r["i"], r["j"]): r["s"] for r in fit.mapInArrow(_gathered(sums, n, axes), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    error = max(abs(at[i, j] / n - at[i, -1] / n * at[j, -1] / n - (i == j)) for i in range(k) for j in range(k))
    return coded.mapInArrow(_projected(sums, n, axes, explained, error), _TOLD)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading 16 components of embeddings; hard rows as whiten() states."""
    base.tune(spark)
    return whiten(spark, base.table(spark, sf_dir, "embeddings"))
