"""Whitening of embeddings by eigenvectors refined from single to double precision.

Every entry c becomes the whole number floor(256 c). The covariance of the distinct vectors is summed over
tasks as matrix products of vectors less a whole-number centre, which doubles hold exactly as long as sums stay below
2^53; then reruns and partitions don't change a bit. Its eigenvectors are first found in single precision and
then corrected by the iteration of Ogita and Aishima, matrix products in double precision: residuals of
orthogonality and of diagonality give a correction that converges quadratically where eigenvalues lie apart.
Eigenvalues too close for that form clusters; the matrix, shifted by a cluster's mean and projected on its
vectors, is a small problem of its own, solved again in single precision relative to the cluster's width, so
that the iteration can tell its vectors apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prepare, table

#: Entries of a block of vectors that a task multiplies at once.
BLOCK = 1 << 20


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One correction of the approximate eigenvectors x of the symmetric a: (values, better vectors, closeness, largest change).

    Values nearer to each other than the closeness can't be told apart by x: for them the step only
    makes the vectors orthonormal.
    """
    r = np.eye(x.shape[1]) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding over a small gap would spoil orthogonality
    values = np.diag(s) / (1 - np.diag(r))
    close = 2 * (np.linalg.norm(s - np.diag(values)) + np.abs(values).max(initial=0) * (np.linalg.norm(r) + len(s) * 1e-15))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > close
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return values, x + x @ e, close, np.abs(e).max(initial=0)


def clusters(values: np.ndarray, close: float) -> list[np.ndarray]:
    """Runs of two or more values, each nearer to the next than ``close``, as places."""
    order = np.argsort(values, kind="stable")
    runs = np.split(order, np.flatnonzero(np.diff(values[order]) > close) + 1)
    return [run for run in runs if len(run) > 1]


def eigen(a: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    First the vectors converge but for turns inside clusters, then each cluster's shifted projection is
    solved the same way, and a last step joins the parts.
    """
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    b = (a + a.T) / (2 * scale)
    x, before = np.linalg.eigh(b.astype(np.float32))[1].astype(np.float64), np.inf
    for _ in range(steps):
        values, x, close, moved = refine(b, x)
        if moved < 1e-15 or before / 2 < moved < 1e-12:
            break
        before = moved
    values, better, close, _ = refine(b, x)
    for run in clusters(values, close):
        part = x[:, run]
        small = part.T @ (b @ part - values[run].mean() * part)
        if np.abs(small).max() > 1e-15 * len(b):  # else the values are equal to double precision: any basis will do
            x[:, run] = part @ eigen(small, steps)[1]
            better = None
    x = refine(b, x)[1] if better is None else better
    for _ in range(3):
        x += x @ (np.eye(len(b)) - x.T @ x) / 2
    x /= np.linalg.norm(x, axis=0)
    values = np.einsum("ij,ij->j", x, b @ x) * scale
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def quantised(rows: DataFrame, vector: str = "embedding", factor: int = 256) -> DataFrame:
    """rows with x, the vector in whole numbers; without vectors that are null, hold null or non-finite entries, or entries too large for a long."""
    scaled = F.transform(vector, lambda c: c.cast("double") * factor)
    fits = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < float(2**63), F.lit(False)))  # false for NaN too
    return rows.where(F.col(vector).isNotNull() & F.coalesce(fits, F.lit(False))).withColumn("x", F.transform(scaled, lambda c: F.floor(c).cast("long")))


def matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix of longs) of a batch, by length of the vectors, in blocks."""
    lists = batch.column(column)
    lengths, flat, starts = lists.value_lengths().to_numpy(zero_copy_only=False), lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for dims in np.unique(lengths):
        every = np.flatnonzero(lengths == dims)
        step = max(1, BLOCK // max(1, int(dims)))
        for i in range(0, len(every), step):
            rows = every[i : i + step]
            yield rows, flat[starts[rows][:, None] + np.arange(dims)]


def vector_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length of the vectors x: how many there are, and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for rows, x in matrices(batch, 0):
                held = total.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                held[0] += len(rows)
                exact = x if np.abs(x).max(initial=0) < 1 << 40 else x.astype(object)
                held[1] = [a + int(b) for a, b in zip(held[1], exact.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([[str(s) for s in sums] for _, sums in total.values()], pa.list_(pa.string()))], names=["dims", "n", "sums"])

    parts = fit.select("x").mapInArrow(run, "dims int, n long, sums array<string>")
    whole = parts.groupBy("dims").agg(F.sum("n").alias("n"))
    each = parts.select("dims", F.posexplode("sums").alias("at", "s")).groupBy("dims", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = {r["dims"]: (r["n"], [0] * r["dims"]) for r in whole.where("dims > 0").collect()}
    for r in each.collect():
        out[r["dims"]][1][r["at"]] = int(r["s"])
    return out


def covariances(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """By length of the vectors x, their covariance, divisor n: products of vectors less a whole-number centre, and what the centre is off."""
    centres = {dims: np.array([(2 * s + n) // (2 * n) for s in by_dim], dtype=np.int64) for dims, (n, by_dim) in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch, 0):
                if x.shape[1]:
                    y = x.astype(np.float64) - centres[x.shape[1]]
                    total[x.shape[1]] = total.get(x.shape[1], 0) + y.T @ y
        rows = [(dims, i, m[i]) for dims, m in total.items() for i in range(dims)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["dims", "i", "row"])

    parts = fit.select("x").mapInArrow(run, "dims int, i int, row array<double>").select("dims", "i", F.posexplode("row").alias("j", "v"))
    summed = parts.groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).groupBy("dims", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row"))
    out = {dims: np.zeros((dims, dims)) for dims in sums}
    for r in summed.select("dims", "i", "row.v").collect():  # a row for each dimension
        out[r["dims"]][r["i"]] = r["v"]
    for dims, (n, by_dim) in sums.items():
        off = np.array([(s - n * int(c)) / n for s, c in zip(by_dim, centres[dims], strict=True)])
        out[dims] = out[dims] / n - np.outer(off, off)
    return out


class Model:
    """Of vectors of one length: count and sums of the fit list, values and components that have any variance, explained shares."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        values, vectors = eigen(covariance)
        has = values[:components] > len(values) * 1e-15 * values[:1].max(initial=0)
        self.n, self.sums, self.mean = n, sums, np.array([s / n for s in sums])
        trace = float(np.trace(covariance))
        self.vectors = vectors[:, :components][:, has] / np.sqrt(values[:components][has])
        self.explained = values[:components][has] / trace if trace else values[:0]
        self.error = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2, exact; None above what a long holds."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def identity_errors(fit: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """By length, the largest absolute entry of the whitened fit list's covariance less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch, 0):
                if (model := models.get(x.shape[1])) is not None:
                    z = model.project(x)
                    total[x.shape[1]] = total.get(x.shape[1], 0) + np.c_[z, np.ones(len(z))].T @ z
        flat = [m.ravel() for m in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(flat, pa.list_(pa.float64()))], names=["dims", "sums"])

    parts = fit.select("x").mapInArrow(run, "dims int, sums array<double>").select("dims", F.posexplode("sums").alias("at", "v"))
    found: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("dims", "at").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["dims"], {})[r["at"]] = r["v"]
    out = {}
    for dims, sums in found.items():
        k, n = models[dims].vectors.shape[1], models[dims].n
        m = np.array([sums[i] for i in range(k * k + k)]).reshape(k + 1, k) / n
        out[dims] = float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())
    return out


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error of every row with a usable vector and each of the first ``components``.

    Vectors that are null or hold null, non-finite or too large entries (256 times 3.6e16) give no rows. Equal vectors
    count once in the fit, however many rows have them; repeated rows are kept. Vectors of each length are whitened by
    themselves. A component without variance (a fit list of one vector, say) can't be whitened and gives no rows, so
    does an empty vector. The driver holds one matrix a length, of its squared size.
    """
    prepare(rows.sparkSession)
    held = quantised(rows.select(F.col(key), F.col(vector).alias("__v")), "__v").select(key, "x")
    fit = held.select("x").distinct().checkpoint()
    sums = vector_sums(fit)
    matrix = covariances(fit, sums)
    models = {dims: Model(n, by_dim, matrix[dims], components) for dims, (n, by_dim) in sums.items()}
    models = {dims: m for dims, m in models.items() if m.vectors.shape[1]}
    for dims, error in identity_errors(fit, models).items():
        models[dims].error = error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch, 1):
                if (m := models.get(x.shape[1])) is None:
                    continue
                k = m.vectors.shape[1]
                each = lambda values: np.tile(values, len(at))  # noqa: B023, E731
                columns = [
                    pa.array(each(np.arange(1, k + 1)), pa.int32()),
                    pa.array(np.full(k * len(at), m.n), pa.int64()),
                    pa.array([v for v in m.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(m.project(x).ravel(), pa.float64()),
                    pa.array(each(m.explained), pa.float64()),
                    pa.array(np.full(k * len(at), m.error), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(at, k))), *columns], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return held.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_whiten(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
