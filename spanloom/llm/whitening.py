"""Whitening of embeddings by singular values: blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations.

Entries are whole numbers x = floor(scale * c) + shift, so counts, sums and deviations are exact. Tasks centre their
blocks of distinct x vectors and reduce them to triangles; triangles are merged in a tree of Spark groups until one is left. That
triangle R, dim x dim whatever the number of rows, has the covariance R'R / n. It is bidiagonalised by Householder reflections; the
squares of the singular values come from qd transforms with shifts below the smallest one, each to high relative accuracy, and the
directions from the twisted factorisation whose middle pivot is least. The leading directions are small and go into the tasks' closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import parts_for, save

#: Whole numbers up to here are exact as doubles; entries beyond are held at this bound.
BOUND = 1 << 52
#: Triangles merged by one group, rows of a block before it is reduced, and rows per task of the fit list.
FAN, BLOCK, ROWS = 16, 2_048, 200_000
EPS = float(np.finfo(float).eps)
#: Eigenvalues closer than this, relatively, have their directions made orthogonal to each other.
CLOSE = 1e-3


def whole_entries(rows: DataFrame, vector: str, scale: float, shift: int) -> DataFrame:
    """``row`` (all columns, see ``whiten``) and x, for rows whose vector is not null and has finite entries only."""
    ok = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), c.cast("double") * scale))) + shift
    return rows.where(F.coalesce(ok, F.lit(False))).withColumn("x", F.transform(F.col(vector), whole))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums per dimension of a task's vectors: one row per dimension, sums as decimals."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            part = x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) > (1 << 62) // batch.num_rows else x.sum(axis=0).astype(object)
            n, total = n + batch.num_rows, part if total is None else total + part
    if n:
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))], names=["dim", "n", "s"])


@dataclass(frozen=True)
class Centre:
    """n vectors with the sums ``s`` (whole numbers of any size) per dimension."""

    n: int
    s: tuple[int, ...]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - s, exactly: as 64-bit numbers where they fit, else as Python's."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, *(abs(v) for v in self.s), 0) if len(self.s) else 0
        if most < 1 << 61:
            return x * self.n - np.array(self.s, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.s, dtype=object)

    def squares(self, deviations: np.ndarray) -> list[int]:
        """Sum of squares per row, exactly."""
        if deviations.dtype != object and int(np.abs(deviations).max(initial=0)) ** 2 * max(1, deviations.shape[1]) < 1 << 62:
            return (deviations * deviations).sum(axis=1).tolist()
        return [sum(int(v) * int(v) for v in row) for row in deviations]


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def _triangles(centre: Centre, width: int):
    """A task's centred rows reduced to one triangle, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, waiting, held = np.zeros((0, width)), [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(0).slice(i, BLOCK))
                waiting.append(centre.deviations(x).astype(float) / centre.n)
                held += len(x)
                if held >= BLOCK:
                    r, waiting, held = _triangle(np.concatenate([r, *waiting])), [], 0
        r = _triangle(np.concatenate([r, *waiting]))
        if len(r):
            yield pa.record_batch([pa.array([r.tobytes()], pa.binary())], names=["r"])

    return run


def _merged(width: int):
    def run(group: pa.Table) -> pa.Table:
        stack = [np.frombuffer(b, float).reshape(-1, width) for b in sorted(group["r"].to_pylist())]
        return pa.table({"r": pa.array([_triangle(np.concatenate(stack)).tobytes()], pa.binary())})

    return run


def triangle_of(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of a QR factorisation of the centred rows x of ``fit``: R'R is the sum of their outer products."""
    width = len(centre.s)
    parts = save(fit.select("x").mapInArrow(_triangles(centre, width), "r binary"), "triangles")
    left, turn = parts.count(), 0
    while left > 1:
        groups = parts_for(left, FAN)
        dealt = parts.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(groups)))
        parts = save(dealt.groupBy("g").applyInArrow(_merged(width), "r binary"), f"triangles_{turn}")
        left, turn = parts.count(), turn + 1
    return np.frombuffer(parts.first().r, float).reshape(-1, width) if left else np.zeros((0, width))


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder: diagonal and upper diagonal of U'rV, and the reflection vectors of V, each from its place on."""
    width = r.shape[1]
    a = np.zeros((width, width))
    a[: len(r)] = r[:width]

    def reflection(x: np.ndarray) -> np.ndarray:
        v = x / (np.abs(x).max() or 1.0)
        norm = np.sqrt(v @ v)
        if norm == 0 or not np.any(x[1:]):
            return np.zeros_like(x)
        v[0] += np.copysign(norm, v[0])
        return v / np.sqrt(v @ v)

    right = []
    for k in range(width):
        v = reflection(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 2 < width:
            v = reflection(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _shifted(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One dqds transform; the last list holds its differences d, one of them negative if the shift was too large."""
    d, out, off, ds = q[0] - shift, [], [], [q[0] - shift]
    for i in range(len(e)):
        top = d + e[i]
        ratio = q[i + 1] / top if top else 0.0
        out.append(top)
        off.append(e[i] * ratio)
        d = d * ratio - shift if top else q[i + 1] - shift
        ds.append(d)
    return [*out, d], off, ds


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling, each to high relative accuracy.

    A transform without shift gives the diagonal of the inverse of BB', whose trace bounds the least eigenvalue from below: that bound
    is the next shift, so shifts never pass an eigenvalue but by rounding, and then the shift is halved. Off-diagonals negligible beside
    what has been found split the matrix.
    """
    tiny = (4 * EPS) ** 2
    values: list[float] = []
    work = [([float(v) ** 2 for v in diagonal], [float(v) ** 2 for v in upper], 0.0)]
    while work:
        q, e, sigma = work.pop()
        while q:
            at = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tiny * (sigma + min(q[i], q[i + 1]))), None)
            if at is not None:
                work.append((q[: at + 1], e[:at], sigma))
                q, e = q[at + 1 :], e[at + 1 :]
                continue
            if len(q) == 1:
                values.append(q[0] + sigma)
                break
            q, e, ds = _shifted(q, e, 0.0)
            if min(ds) <= 0:  # a zero singular value: it has gone to the end
                shift = 0.0
            else:
                shift = 1.0 / sum(1.0 / d for d in ds) if min(ds) > 1e-300 else 0.0
            if min(q[-1], e[-1]) <= tiny * sigma or shift <= tiny * sigma:
                if e[-1] <= tiny * (sigma + q[-1]) or q[-1] <= tiny * sigma:
                    values.append(q[-1] + sigma)
                    q, e = q[:-1], e[:-1]
                    continue
                shift = 0.0
            while shift:
                nq, ne, nd = _shifted(q, e, shift)
                if min(nd) >= 0:
                    q, e, sigma = nq, ne, sigma + shift
                    break
                shift = shift / 2 if shift > tiny * max(sigma, 1e-300) else 0.0
    return np.sort(np.array(values))[::-1]


def twisted(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of B'B for some of its eigenvalues.

    B'B - value = L D L' from the top and U D U' from the bottom; where the two meet with the least pivot, the vector starts. Vectors
    of close eigenvalues are made orthogonal; one that this leaves too short is found again by inverse iteration.
    """
    n = len(diagonal)
    q = diagonal * diagonal
    floor = EPS * EPS * max(q.max(initial=0), 1e-300)
    safe = lambda v: v if abs(v) > floor else (floor if v >= 0 else -floor)
    blocks = np.concatenate([[0], np.flatnonzero(np.abs(upper) <= EPS * np.sqrt(q.max(initial=0)) * 1e-2) + 1, [n]]).astype(int)

    def factors(lo: int, hi: int, value: float) -> tuple[list[float], list[float], list[float], list[float], int]:
        """Multipliers from the top and from the bottom, pivots from the top, and the place of the twist, of one unreduced block."""
        a, b = diagonal[lo:hi], upper[lo : hi - 1]
        main, off = a * a + np.concatenate([[0.0 if lo == 0 else upper[lo - 1] ** 2], b * b]), a[:-1] * b
        m, s = hi - lo, [-value]
        down, up, piv = [], [], []
        start = main[0] - q[lo]  # what an off-diagonal cut at the block's edge leaves of the entry
        s[0] = start - value
        for i in range(m - 1):
            p = safe(s[i] + q[lo + i])
            piv.append(p)
            down.append(off[i] / p)
            s.append(down[i] * b[i] / a[i] * s[i] - value if a[i] else main[i + 1] - q[lo + i + 1] - down[i] * off[i] - value)
        piv.append(safe(s[-1] + q[hi - 1]))
        p = [0.0] * m
        p[-1] = q[hi - 1] - value
        for i in range(m - 2, -1, -1):
            below = safe(b[i] ** 2 + p[i + 1])
            ratio = q[lo + i] / below
            up.append(off[i] / below)
            p[i] = p[i + 1] * ratio - value
        up.reverse()
        gamma = np.abs(np.array(s) + np.array(p) + value)
        return down, up, piv, off.tolist(), int(np.argmin(gamma))

    def vector(lo: int, hi: int, value: float) -> np.ndarray:
        down, up, _, _, k = factors(lo, hi, value)
        z = np.zeros(hi - lo)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(k, hi - lo - 1):
            z[i + 1] = -up[i] * z[i]
        return z / np.linalg.norm(z)

    def solved(lo: int, hi: int, value: float, y: np.ndarray) -> np.ndarray:
        down, _, piv, _, _ = factors(lo, hi, value)
        y = y.copy()
        for i in range(1, len(y)):
            y[i] -= down[i - 1] * y[i - 1]
        y /= piv
        for i in range(len(y) - 2, -1, -1):
            y[i] -= down[i] * y[i + 1]
        return y / np.linalg.norm(y)

    def block_of(value: float, taken: list[tuple[int, float]]) -> tuple[int, int]:
        """The block whose own eigenvalues hold this one; blocks hold as many equal ones as they have."""
        best, far = 0, np.inf
        for k in range(len(blocks) - 1):
            lo, hi = blocks[k], blocks[k + 1]
            own = spectra[k]
            free = [v for j, v in enumerate(own) if (k, j) not in taken]
            if free:
                gap = min(abs(v - value) for v in free)
                if gap < far:
                    best, far = k, gap
        own = spectra[best]
        j = min((j for j in range(len(own)) if (best, j) not in taken), key=lambda j: abs(own[j] - value))
        taken.append((best, j))
        return int(blocks[best]), int(blocks[best + 1])

    spectra = [dqds(diagonal[lo:hi], upper[lo : hi - 1]) for lo, hi in zip(blocks[:-1], blocks[1:], strict=True)] if len(blocks) > 2 else [values]
    out, taken, rng = np.zeros((len(values), n)), [], np.random.default_rng(7)
    for i, value in enumerate(values):
        lo, hi = block_of(value, taken) if len(blocks) > 2 else (0, n)
        near = [j for j in range(i) if values[j] - value <= CLOSE * value]
        z = np.zeros(n)
        z[lo:hi] = vector(lo, hi, value)
        for _ in range(8):
            rest = z - out[near].T @ (out[near] @ z)
            rest -= out[near].T @ (out[near] @ rest)
            length = np.linalg.norm(rest)
            z = rest / length if length else rest
            if length > 0.5:
                break
            if length < 1e-8:
                z = np.zeros(n)
                z[lo:hi] = rng.normal(size=hi - lo)
            z[lo:hi] = solved(lo, hi, value * (1 + 2 * EPS * rng.normal()), z[lo:hi])
        out[i] = z / (np.linalg.norm(z) or 1.0)
    return out


@dataclass(frozen=True)
class Model:
    """Unit directions (one per row) with their eigenvalues and shares of the trace, falling, of the fit list's covariance."""

    centre: Centre
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        """Centred rows (n * x - s) along the directions, in standard deviations."""
        return deviations.astype(float) / self.centre.n @ (self.directions / np.sqrt(self.values)[:, None]).T


def fit(distinct: DataFrame, components: int) -> Model | None:
    """The whitening of the rows x (one per row, each counts once); None for an empty table.

    Directions along which the rows don't vary (variance below dim * 2^-52 of the largest) can't be whitened and are left out.
    """
    sums = distinct.select("x").mapInArrow(_sums, "dim int, n long, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").cast("string").alias("s")).orderBy("dim").collect()
    if not sums:
        return None
    centre = Centre(sums[0].n, tuple(int(r.s) for r in sums))
    r = triangle_of(distinct, centre)
    diagonal, upper, right = bidiagonal(r)
    squares = dqds(diagonal, upper)
    total = float((r * r).sum())
    kept = squares[:components][squares[:components] > len(squares) * EPS * (squares[0] if len(squares) else 0)]
    z = twisted(diagonal, upper, kept)
    for k in range(len(right) - 1, -1, -1):
        v = right[k]
        z[:, k + 1 :] -= 2 * np.outer(z[:, k + 1 :] @ v, v)
    return Model(centre, z, kept / centre.n, kept / total if total else kept)


def _moments(model: Model):
    """A task's part of the covariance of whitened rows: one row per pair of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        once, twice = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                w = model.whitened(model.centre.deviations(_matrix(batch.column(0).slice(i, BLOCK))))
                once, twice = once + w.sum(axis=0), twice + w.T @ w
        i, j = np.divmod(np.arange(k * k), k) if k else (np.zeros(0, int), np.zeros(0, int))
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(twice.ravel()), pa.array(once[i])], names=["i", "j", "twice", "once"])

    return run


def identity_error(distinct: DataFrame, model: Model) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity; 0 without components."""
    n = model.centre.n
    rows = distinct.select("x").mapInArrow(_moments(model), "i int, j int, twice double, once double").groupBy("i", "j").agg(F.sum("twice").alias("twice"), F.sum("once").alias("once")).collect()
    mean = {r.i: r.once / n for r in rows}
    return max((abs(r.twice / n - mean[r.i] * mean[r.j] - (r.i == r.j)) for r in rows), default=0.0)


def _project(model: Model, error: float):
    k, n = len(model.values), model.centre.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                deviations = model.centre.deviations(_matrix(part.column(1)))
                rows, w = part.num_rows, model.whitened(deviations)
                far = pa.array([Decimal(v) for v in model.centre.squares(deviations)], pa.decimal128(38, 0))
                again = pa.array(np.repeat(np.arange(rows), k))
                yield pa.record_batch(
                    [part.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n), pa.int64()), far.take(again), pa.array(w.ravel()), pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, error))],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """key, component (from 1), n, deviation (decimal), whitened, explained, identity_error for every row with a usable vector.

    A vector that is null or holds null or non-finite entries is left out, rows that repeat a vector count once in the fit and each have
    their result, and so do rows with a null key. Vectors of different lengths are whitened apart; those of length 0, and tables of one distinct
    vector, have no component and return nothing. Components number ``components`` or, if the fit list varies in fewer directions, those.
    An entry beyond 2^52 / scale is held there. An empty table returns nothing. Other columns are not read.
    """
    usable = whole_entries(rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vec")), "vec", scale, shift).select("key", "x")
    distinct = save(usable.select("x").distinct(), "distinct")
    lengths = sorted(r.w for r in distinct.groupBy(F.size("x").alias("w")).count().collect() if r.w)
    schema = f"key {usable.schema['key'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    found = []
    for width in lengths:
        own = distinct.where(F.size("x") == width)
        own = own.repartition(parts_for(own.count(), ROWS)) if len(lengths) > 1 else own
        model = fit(own, components)
        if len(model.values):
            found.append(usable.where(F.size("x") == width).mapInArrow(_project(model, identity_error(own, model)), schema))
    out = reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("key", key)
