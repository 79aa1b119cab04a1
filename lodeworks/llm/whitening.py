"""Whitening of embeddings by matrix-free block subspace iteration."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

#: An entry c becomes floor(SCALE * c).
SCALE = 256
#: Columns of the block beyond the components asked for, at first.
SPARE = 12
#: Residuals, as a share of the largest eigenvalue, at which components count as found.
TOLERANCE = 2e-13
#: If more passes than these would be left at the present rate, the block is widened.
PATIENCE = 8
MAX_PASSES = 500
WIDTHS = {2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<i8")}
LONG = np.iinfo(np.int64)


def _integers(column: pa.Array, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a whole vector (of d entries, where d is given), and the integers of those rows.

    Whole: not null, without null, infinite or undefined entries. Rows of one batch may differ in length; without d,
    the lengths of the whole rows are returned instead of the integers.
    """
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    # flatten() leaves out what lies under null rows.
    flat = column.flatten().cast(pa.float64())
    bad = ~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
    ends = np.cumsum(np.maximum(lengths, 0))
    before = np.concatenate(([0], np.cumsum(bad)))
    whole = (lengths >= 0) & (before[ends] == before[ends - np.maximum(lengths, 0)])
    if d is None:
        return whole, lengths[whole]
    whole &= lengths == d
    at = (ends - lengths)[whole][:, None] + np.arange(d)
    c = flat.to_numpy(zero_copy_only=False)[at] if whole.any() else np.zeros((0, d))
    x = np.floor(SCALE * c) if not np.isinf(SCALE * c).any() else np.floor(np.clip(c, -1e300, 1e300) * SCALE)
    # Beyond the range of a long, its ends; the largest double below 2**63 is far from it.
    out = np.where(x >= 2.0**63, 0, np.where(x < -(2.0**63), 0, x)).astype(np.int64)
    return whole, np.where(x >= 2.0**63, LONG.max, np.where(x < -(2.0**63), LONG.min, out))


def _pack(x: np.ndarray) -> pa.Array:
    """Each row in the least of 2, 4 and 8 bytes an entry that holds it: equal rows, equal bytes."""
    high, low, d = x.max(1, initial=0), x.min(1, initial=0), x.shape[1]
    width = np.full(len(x), 8)
    for w in (4, 2):
        width[(high <= np.iinfo(WIDTHS[w]).max) & (low >= np.iinfo(WIDTHS[w]).min)] = w
    ends = np.concatenate(([0], np.cumsum(width * d))).astype(np.int64)
    data = np.empty(ends[-1], np.uint8)
    for w, kind in WIDTHS.items():
        rows = np.flatnonzero(width == w)
        if len(rows) and d:
            data[(ends[rows][:, None] + np.arange(w * d)).ravel()] = np.frombuffer(x[rows].astype(kind).tobytes(), np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def _unpack(column: pa.Array, d: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    out = np.empty((len(column), d), np.int64)
    if not out.size:
        return out
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, width = np.frombuffer(column.buffers()[2], np.uint8), np.diff(ends) // d
    for w, kind in WIDTHS.items():
        rows = np.flatnonzero(width == w)
        if len(rows):
            out[rows] = data[ends[rows][:, None] + np.arange(w * d)].view(kind)
    return out


@dataclass
class Whitening:
    """What was fitted: n distinct vectors of d integers with sums S; k components, their eigenvalues of the covariance,
    the trace of it, the residuals that certify them and how far the whitened fit list is from uncorrelated."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    block: int
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(eigenvalue); not a number for a component along which nothing varies."""
        least = max(self.trace, 0.0) * 1e-14
        return np.where(self.eigenvalues > least, 1 / np.sqrt(np.maximum(self.eigenvalues, 1e-300)), np.nan)


def _summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum rows ``(i, v)`` in Spark; as many numbers as the shape has come to the driver."""
    out = np.zeros(int(np.prod(shape)))
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).toArrow().to_pylist():
        out[r["i"]] = r["v"]
    return out.reshape(shape)


def _products(fit: DataFrame, d: int, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """One pass: sums of X^T (X Q) and of |x|^2 over the centred rows x of the fit list, which stay where they lie."""
    b = q.shape[1]
    held = fit.sparkSession.sparkContext.broadcast((mean, q))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, q = held.value
        z, trace = np.zeros((d, b)), 0.0
        for batch in it:
            x = _unpack(batch.column(0), d) - mean
            z += x.T @ (x @ q)
            trace += float((x * x).sum())
        v = np.append(z.ravel(), trace)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["i", "v"])

    got = _summed(fit.mapInArrow(work, "i int, v double"), (d * b + 1,))
    held.unpersist()
    return got[:-1].reshape(d, b), float(got[-1])


def _dimension(vectors: DataFrame, column: str) -> int | None:
    """The commonest length of whole vectors, the longest of those on a tie; a few lengths reach the driver."""

    def lengths(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, times = np.unique(_integers(batch.column(0))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(times.astype(np.int64))], names=["d", "n"])

    best = vectors.select(column).mapInArrow(lengths, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(2).collect()
    if len(best) > 1:
        warnings.warn(f"vectors differ in length: only those of {best[0]['d']} entries are whitened", stacklevel=3)
    return best[0]["d"] if best else None


def fit(vectors: DataFrame, column: str = "embedding", k: int = 4, tolerance: float = TOLERANCE, seed: int = 5) -> Whitening | None:
    """The k leading eigenvectors of the covariance of the distinct integer vectors of ``vectors``; None if there are none.

    The fit list is stored once, a row of 2 bytes an entry (more where needed); equal vectors meet after each task has
    put its own together, so a vector that a third of all rows share is a row a task. Every pass over it computes
    X^T (X Q) for a block Q of a few columns, centred within the task, and leaves d x block sums; QR of the result and
    Rayleigh-Ritz within the block give the next Q. It ends when the residual |V q - e q| of each of the k leading Ritz
    pairs is below ``tolerance`` times the largest. V itself is never formed: memory of a task is a batch, and d x block.
    The error falls by the ratio of the block's last eigenvalue to the k-th a pass, so where the spectrum is flat and
    more than ``PATIENCE`` passes would be left, the block is widened, up to d, at which one pass is exact.
    """
    spark = vectors.sparkSession
    d = _dimension(vectors, column)
    if d is None:
        return None

    def integers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            _, x = _integers(batch.column(0), d)
            yield pa.RecordBatch.from_arrays([_pack(x)], names=["x"])

    distinct = stored(vectors.select(column).mapInArrow(integers, "x binary").distinct(), "whiten-fit")

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, object), np.zeros(d, object)
        for batch in it:
            x = _unpack(batch.column(0), d)
            n += len(x)
            # Halves of 32 bits, whose sums over a batch are exact.
            high, low = high + (x >> 32).sum(0).astype(object), low + (x & 0xFFFFFFFF).sum(0).astype(object)
        digits = [str((int(h) << 32) + int(v)) for h, v in zip(high, low, strict=True)] + [str(n)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(digits)], names=["i", "v"])

    totals = distinct.mapInArrow(sums, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("i").collect()
    s, n = [int(r["v"]) for r in totals[:-1]], int(totals[-1]["v"])
    k = min(k, d)
    found = Whitening(n, s, np.zeros((d, k)), np.zeros(k), 0.0, np.zeros(k), 0, 0, None)
    if not k:
        return found
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, min(d, k + SPARE))))[0]
    before = None
    for found.passes in range(1, MAX_PASSES + 1):
        z, trace = _products(distinct, d, found.mean, q)
        z, found.trace, found.block = z / n, trace / n, q.shape[1]
        # Rayleigh-Ritz: the block's own eigenpairs, falling.
        h = q.T @ z
        theta, u = np.linalg.eigh((h + h.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        y, z = q @ u, z @ u
        found.residuals = np.linalg.norm(z[:, :k] - y[:, :k] * theta[:k], axis=0)
        found.components, found.eigenvalues = y[:, :k], np.maximum(theta[:k], 0.0)
        worst, goal = float(found.residuals.max()), tolerance * max(float(theta[0]), 0.0)
        if worst <= goal:
            break
        if q.shape[1] == d:
            # The block spans all: what is left is rounding, unless it still falls.
            if before is not None and worst > before / 2:
                break
            before = worst
        q = np.linalg.qr(z)[0]
        rate = abs(theta[-1]) / max(abs(theta[k - 1]), 1e-300)
        left = np.log(goal / worst) / np.log(min(max(rate, 1e-6), 1 - 1e-9)) if goal else 0
        if q.shape[1] < d and (left > PATIENCE or not goal):
            more = rng.standard_normal((d, min(q.shape[1], d - q.shape[1])))
            q = np.linalg.qr(np.hstack((q, more)))[0]
    else:
        warnings.warn(f"residuals of {found.residuals} after {MAX_PASSES} passes", stacklevel=2)
    live = np.flatnonzero(~np.isnan(found.scales))
    if len(live):
        # A pass of its own over what was whitened, not the figures of the iteration.
        mean, w = found.mean, found.components[:, live] * found.scales[live]
        held, m = spark.sparkContext.broadcast((mean, w)), len(live)

        def moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, w = held.value
            first, second = np.zeros(m), np.zeros((m, m))
            for batch in it:
                t = (_unpack(batch.column(0), d) - mean) @ w
                first, second = first + t.sum(0), second + t.T @ t
            v = np.append(first, second.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["i", "v"])

        got = _summed(distinct.mapInArrow(moments, "i int, v double"), (m + m * m,)) / n
        found.identity_error = float(np.abs(got[m:].reshape(m, m) - np.outer(got[:m], got[:m]) - np.eye(m)).max())
    return found


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n x - S)^2 as long; null where no long holds it."""
    s = np.array(sums, object)
    if not x.size:
        return pa.array([0] * len(x), pa.int64())
    most = max(abs(int(x.max())), abs(int(x.min()))) * n + max(abs(v) for v in sums)
    if most * most * len(sums) < 1 << 63:
        return pa.array(((n * x - s.astype(np.int64)) ** 2).sum(1))
    exact = ((n * x.astype(object) - s) ** 2).sum(1)
    return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())


def transform(vectors: DataFrame, found: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Each whole vector along each component: ``(key, component, n, deviation, whitened, explained, identity_error)``.

    One scan, nothing is shuffled. Rows as ``whiten`` says.
    """
    kind = dict(vectors.dtypes)[key]
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None or not len(found.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    held = vectors.sparkSession.sparkContext.broadcast((found, found.mean))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, mean = held.value
        k, d = len(f.eigenvalues), len(f.sums)
        explained = f.eigenvalues / f.trace if f.trace > 0 else np.zeros(k)
        for batch in it:
            whole, x = _integers(batch.column(1), d)
            if not len(x):
                continue
            y = ((x - mean) @ f.components) * f.scales
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).filter(pa.array(whole)).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), f.n)),
                    _deviations(x, f.n, f.sums).take(pa.array(rows)),
                    pa.array(y.ravel(), mask=np.isnan(y.ravel())),
                    pa.array(np.tile(explained, len(x))),
                    pa.array([f.identity_error] * len(rows), pa.float64()),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.select(key, column).mapInArrow(work, schema)


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 4) -> DataFrame:
    """Fit on ``vectors`` and whiten them: see ``fit`` and ``transform``.

    Defined results: a vector that is null, or has null, infinite or undefined entries, gets no rows; a null key stays
    null; repeated rows and ties are whitened alike and counted once in the fit; vectors of another length than the
    commonest (the longest of those) get no rows, with a warning; vectors of fewer than k entries have as many components;
    where nothing varies along a component (one distinct vector, say), whitened is null there, explained 0 and
    identity_error speaks of the other components, null if there are none; entries beyond the range of a long count as
    its end, and a deviation beyond it is null; an empty table, or one without a whole vector, gives no rows; extra
    columns are ignored. Equal eigenvalues leave their components free to turn among each other.
    """
    return transform(vectors, fit(vectors, column, k), key, column)
