"""Whitening of embeddings by an incremental eigendecomposition.

A vector's entries become the integers floor(256 * c), and every different integer vector is fitted
once. Each task keeps the eigenvalues and eigenvectors of the scatter of the vectors that it has
seen. A new vector changes the scatter by a rank-one term, its centred direction; the new
eigenvalues are the roots of the secular equation

    1 + rho * sum(z_j^2 / (d_j - x)) = 0

one between each two old ones, found for all at once by rational interpolation inside brackets. Where
``z_j`` vanishes or two old values meet, the pair is deflated and keeps its value. Eigenvectors come
from the ``z`` of which the roots are exact, so they stay orthogonal (Gu and Eisenstat). Directions
without variance are not kept until a vector leaves the span.

Spectra of tasks are combined in rounds: one takes the eigenpairs of another and the difference of
their means as rank-one updates. The leading vectors, with some more as guard, are then refined over
all vectors: each pass multiplies them by the covariance, takes Ritz pairs, and stops when the residual
has reached rounding. What meets on the driver are matrices of dimension times guard.

Sums and centred values are exact integers up to the division by n. Vectors that are null or hold a null or an entry
that is not finite are dropped. Vectors of different lengths are whitened apart; empty ones, those alone
of their length, and components without variance give no rows. Entries beyond 64 bits are cut to
them, and a ``deviation`` beyond 64 bits is null. Repeated rows are given back each; repeated vectors
count once. Only ``vec_id`` and ``embedding`` are read, so other columns may have any name. No rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.shared import saved

SCALE = 256
COMPONENTS = 4
GUARD = 8
# Vectors of one task, and spectra that one task combines in a round.
TASK_VECTORS = 4096
FAN = 8
PASSES = 12
EPS = np.finfo(float).eps


def between(c: np.ndarray, s1: np.ndarray, s2: np.ndarray, a1: np.ndarray, a2: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The root of c + s1 / (a1 - x) + s2 / (a2 - x) between ``low`` and ``high``, or else their middle."""
    with np.errstate(all="ignore"):
        a, b = c * (a1 + a2) + s1 + s2, c * a1 * a2 + s1 * a2 + s2 * a1
        q = (a + np.copysign(np.sqrt(np.maximum(0, a * a - 4 * b * c)), a)) / 2
        one, two = q / c, b / q
        # Right of the last pole there is only one.
        one[-1] = a1[-1] + s1[-1] / c[-1]
    ok = (one > low) & (one < high)
    x = np.where(ok, one, two)
    return np.where(ok | (two > low) & (two < high), x, (low + high) / 2)


def roots(d: np.ndarray, z: np.ndarray, rho: float) -> np.ndarray:
    """``e[i, j] = d[j] - x[i]`` for the roots ``x`` of the secular equation, ``z`` of length one, ``d`` ascending.

    Every root is an offset from its nearer pole, so differences keep their digits. In each step the poles
    left of a root and those right of it are replaced by one each, of the same value and slope.
    """
    k = len(d)
    at = np.arange(k)
    square = rho * z * z
    width = np.append(np.diff(d), rho)
    half = width / 2
    left = at[:, None] >= at
    middle = square / (d - d[:, None] - half[:, None])
    value = 1 + middle.sum(axis=1)
    nearer = (value < 0) & (at < k - 1)
    origin = at + nearer
    gaps = d - d[origin][:, None]
    low = np.where(nearer, -half, np.where(value < 0, half, 0.0))
    high = np.where(nearer, 0.0, np.where(value < 0, width, half))
    one, two = d - d[origin], np.append(d[1:], d[-1] + rho) - d[origin]
    right = np.append(square[1:], 0.0)
    around = middle[at, at] + np.append(middle[at[:-1], at[1:]], 0.0)
    x = between(value - around, square, right, one, two, low, high)
    for _ in range(100):
        e = gaps - x[:, None]
        term = square / e
        w = 1 + term.sum(axis=1)
        low, high = np.where(w < 0, x, low), np.where(w > 0, x, high)
        done = (np.abs(w) <= 4 * EPS * (1 + np.abs(term).sum(axis=1))) | (high - low <= 2 * EPS * np.abs(x))
        if done.all():
            break
        slope = term / e
        before = np.where(left, slope, 0.0).sum(axis=1)
        after = slope.sum(axis=1) - before
        a1, a2 = one - x, two - x
        step = between(w - a1 * before - a2 * after, a1 * a1 * before, a2 * a2 * after, a1, a2, low - x, high - x)
        x = np.where(done, x, x + step)
    return gaps - x[:, None]


def eigen_update(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of diag(``d``) + ``rho`` * ``z`` ``z``', ``z`` of length one, ``d`` ascending; vectors are columns."""
    e = roots(d, z, rho)
    between = d - d[:, None]
    np.fill_diagonal(between, 1)
    exact = np.sqrt(np.abs((e / between).prod(axis=0)))
    vectors = (np.copysign(exact, z) / e).T
    vectors /= np.sqrt(np.einsum("ij,ij->j", vectors, vectors))
    # A root is its pole less the difference to it, whichever is nearer.
    at = np.abs(e).argmin(axis=1)
    return d[at] - e[np.arange(len(d)), at], vectors


@dataclass
class Spectrum:
    """Number, mean and scatter of some vectors; the scatter by its eigenvalues, ascending, and eigenvectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(0), np.zeros((dims, 0)))

    def update(self, v: np.ndarray, rho: float) -> None:
        """The scatter grows by ``rho`` * ``v`` ``v``'."""
        q, d = self.vectors, self.values
        z = v @ q
        if len(d) < len(v):
            rest = v - q @ z
            again = rest @ q
            z, rest = z + again, rest - q @ again
            length = np.sqrt(rest @ rest)
            if length > 1e-10 * np.sqrt(v @ v):
                q, d, z = np.column_stack((rest / length, q)), np.append(0.0, d), np.append(length, z)
        norm = np.sqrt(z @ z)
        if not norm or not rho:
            return
        z, rho = z / norm, rho * norm * norm
        tol = 8 * EPS * max(d[-1], rho)
        on = np.flatnonzero(rho * np.abs(z) > tol)
        if len(on) > 1:
            a, b = z[on[:-1]], z[on[1:]]
            if (np.diff(d[on]) * np.abs(a * b) <= tol * (a * a + b * b)).any():
                d, z, q, on = rotate(d, z, q, on, tol)
        if not len(on):
            return
        z = z[on]
        norm = np.sqrt(z @ z)
        found, u = eigen_update(d[on], z / norm, rho * norm * norm)
        if len(on) == len(d):
            self.values, self.vectors = found, q @ u
            return
        d, q = d.copy(), q.copy()
        d[on], q[:, on] = found, q[:, on] @ u
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], q[:, order]

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        apart = x - self.mean
        self.mean = self.mean + apart / self.n
        if self.n > 1:
            self.update(apart, (self.n - 1) / self.n)

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(vector, value)
        total = self.n + other.n
        apart = other.mean - self.mean
        if self.n:
            self.update(apart, self.n * other.n / total)
        self.mean = self.mean + apart * (other.n / total)
        self.n = total


def rotate(d: np.ndarray, z: np.ndarray, q: np.ndarray, on: np.ndarray, tol: float) -> tuple[np.ndarray, ...]:
    """Of each two old values that meet, one loses its part of ``z`` by a rotation of the two vectors."""
    d, z, q = d.copy(), z.copy(), q.copy()
    kept = [int(on[0])]
    for j in map(int, on[1:]):
        i = kept[-1]
        r = np.hypot(z[i], z[j])
        c, s = z[j] / r, z[i] / r
        if (d[j] - d[i]) * abs(c * s) <= tol:
            q[:, i], q[:, j] = c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]
            d[i], d[j] = c * c * d[i] + s * s * d[j], s * s * d[i] + c * c * d[j]
            z[i], z[j] = 0.0, r
            kept[-1] = j
        else:
            kept.append(j)
    return d, z, q, np.array(kept)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, the integer vector ``x`` and its length ``dims`` of the rows that are whitened."""
    e = F.col("embedding")
    finite = F.forall(e, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    good = vectors.where(e.isNotNull() & F.coalesce(finite, F.lit(False)))
    x = F.transform(e, lambda c: F.floor(c.cast("double") * SCALE))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).withColumn("dims", F.size("x"))


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dims)


def times_n_centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact; Python's integers where 64 bits are not enough."""
    most = max(np.abs(x.astype(float)).max(initial=0) * n, max(map(abs, sums), default=0))
    if most < 2.0**61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (times_n_centred(x, n, sums) / n).astype(float)


@dataclass
class Fit:
    """What every row is whitened with."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float = 0.0
    identity_error: float = 0.0

    def whiten(self, apart: np.ndarray) -> np.ndarray:
        return apart @ self.vectors / np.sqrt(self.values)


def sums_of(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length of the vectors: how many, and the exact sum of each entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims in np.unique(batch.column("dims").to_numpy()).tolist():
                x = matrix(batch.filter(pa.array(batch.column("dims").to_numpy() == dims)), dims)
                small = np.abs(x.astype(float)).max(initial=0) * len(x) < 2.0**61
                own = (x if small else x.astype(object)).sum(axis=0).astype(object)
                total[dims] = total.get(dims, 0) + np.append(own, len(x)).astype(object)
        rows = [(dims, i, str(v)) for dims, own in total.items() for i, v in enumerate(own)]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string()))], ["dims", "at", "total"])

    found = fit.mapInArrow(add, "dims int, at int, total string")
    out: dict[int, dict[int, int]] = {}
    for row in found.groupBy("dims", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out.setdefault(row["dims"], {})[row["at"]] = int(row["total"])
    return {dims: (own[dims], [own[i] for i in range(dims)]) for dims, own in out.items()}


def row_of(at: int, s: Spectrum) -> pa.RecordBatch:
    parts = [pa.array([v.tobytes()], pa.binary()) for v in (s.mean, s.values, np.ascontiguousarray(s.vectors))]
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([s.n], pa.int64()), *parts], ["at", "n", "mean", "values", "vectors"])


def spectra_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Spectrum]]:
    for at, n, *parts in zip(*(batch.column(c).to_pylist() for c in ("at", "n", "mean", "values", "vectors"))):
        mean, values, vectors = (np.frombuffer(p) for p in parts)
        yield at, Spectrum(n, mean, values, vectors.reshape(len(mean), len(values)))


SPECTRA = "at long, n long, mean binary, values binary, vectors binary"


def spectrum_of(fit: DataFrame, dims: int, n: int, sums: list[int]) -> Spectrum:
    """The spectrum of all vectors: of tasks first, then combined in rounds."""
    tasks = -(-n // TASK_VECTORS)

    def incremental(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(dims)
        for batch in batches:
            for x in centred(matrix(batch, dims), n, sums):
                own.add(x)
        if own.n:
            yield row_of(TaskContext.get().partitionId(), own)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, group = Spectrum.empty(dims), None
        for batch in batches:
            for at, own in spectra_of(batch):
                if at // FAN != group:
                    if group is not None:
                        yield row_of(group, whole)
                    whole, group = Spectrum.empty(dims), at // FAN
                whole.merge(own)
        if group is not None:
            yield row_of(group, whole)

    found = saved(fit.select("x").repartition(tasks, "x").mapInArrow(incremental, SPECTRA), "spectra")
    while found.count() > 1:
        grouped = found.withColumn("group", F.floor(F.col("at") / FAN)).repartition("group").sortWithinPartitions("group", "at")
        found = saved(grouped.drop("group").mapInArrow(combine, SPECTRA), "spectra")
    return next(spectra_of(found.toArrow().to_batches()[0]))[1]


def summed(fit: DataFrame, shape: tuple[int, int], of_batch) -> np.ndarray:
    """The sum over all vectors of the matrix that ``of_batch`` makes of some of them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += of_batch(batch)
        i, j = np.indices(shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    out = np.zeros(shape)
    for row in fit.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row["i"], row["j"]] = row["v"]
    return out


def refined(fit: DataFrame, start: Spectrum, dims: int, n: int, sums: list[int], components: int) -> Fit:
    """Ritz pairs of the covariance from the leading vectors of ``start``."""
    basis = np.linalg.qr(start.vectors[:, ::-1][:, : components + GUARD])[0]
    before = np.inf
    for _ in range(PASSES):
        # The covariance times the basis, and below it the trace.
        def product(batch: pa.RecordBatch) -> np.ndarray:
            apart = centred(matrix(batch, dims), n, sums)
            trace = np.zeros(basis.shape[1])
            trace[0] = (apart * apart).sum()
            return np.vstack((apart.T @ (apart @ basis), trace))

        total = summed(fit, (dims + 1, basis.shape[1]), product) / n
        image, trace = total[:-1], float(total[-1, 0])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, image = basis @ turn, image @ turn
        miss = np.abs(image - vectors * values)[:, :components].max(initial=0)
        # Rounding is reached, or nothing is gained any more.
        if miss <= 4 * EPS * values[0] or miss > before / 2:
            break
        before = miss
        basis = np.linalg.qr(image)[0]
    kept = np.flatnonzero(values[:components] > 8 * dims * EPS * trace)
    vectors = vectors[:, kept]
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=0))
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))] < 0, -1.0, 1.0)
    return Fit(n, sums, values[kept], vectors, trace)


def fitted(fit: DataFrame, dims: int, n: int, sums: list[int], components: int) -> Fit:
    start = spectrum_of(fit, dims, n, sums)
    if not len(start.values):
        return Fit(n, sums, np.zeros(0), np.zeros((dims, 0)))
    found = refined(fit, start, dims, n, sums, components)
    k = len(found.values)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        white = found.whiten(centred(matrix(batch, dims), n, sums))
        return white.T @ white

    if k:
        found.identity_error = float(np.abs(summed(fit, (k, k), products) / n - np.eye(k)).max())
    return found


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every usable row with each of its components: ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    rows = usable(vectors)
    fit = saved(rows.where("dims > 0").select("x", "dims").distinct(), "fit")
    fits = {dims: fitted(fit.where(F.col("dims") == dims), dims, n, sums, components) for dims, (n, sums) in sums_of(fit).items()}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("dims").to_numpy()
            for dims in np.unique(lengths).tolist():
                own = fits.get(dims)
                k = len(own.values) if own else 0
                if not k:
                    continue
                part = batch.filter(pa.array(lengths == dims))
                x = matrix(part, dims)
                exact = times_n_centred(x, own.n, own.sums)
                if np.abs(exact.astype(float)).max(initial=0) ** 2 * dims >= 2.0**62:
                    exact = exact.astype(object)
                deviation = [v if v < 1 << 63 else None for v in (exact * exact).sum(axis=1).tolist()]
                white = own.whiten((exact / own.n).astype(float))
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, own.n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(white.ravel()), pa.array(np.tile(own.values / own.trace, m)), pa.array(np.full(m * k, own.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(
        apply, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


def op11_whitening(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
