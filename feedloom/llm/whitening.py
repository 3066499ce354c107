"""Whitening of embeddings by a bidiagonal qd solver.

Rows are centred and reduced to one triangular factor by blockwise QR: each task folds its batches into a factor,
and factors fold into factors, ``FAN`` at a time, until one is left. The driver sees that one factor (width x
width) and the column sums. Householder reflections make it bidiagonal, dqds finds its singular values to high
relative accuracy, and twisted factorisations give the leading directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Entries become floor(SCALE * c) + OFFSET; what lies beyond LIMIT counts as LIMIT.
SCALE, OFFSET, LIMIT = 1024.0, 100_000, 2.0**61
#: Factors folded by one task of the reduction tree.
FAN = 64
EPS = np.finfo(float).eps
TOLERANCE = (100 * EPS) ** 2
LONG = (1 << 63) - 1


def finite(vector: str) -> Column:
    """Whether a vector is there and holds neither nulls nor non-finite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def usual_width(rows: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors, of equally frequent ones the largest; 0 without rows."""
    found = rows.groupBy(F.size(vector).alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return found["w"] if found else 0


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors without nulls as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _scaled(column: pa.ListArray, width: int) -> np.ndarray:
    return np.floor(np.clip(SCALE * matrix(column, width), -LIMIT, LIMIT)).astype(np.int64) + OFFSET


def _column_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many rows there are and their exact sums, as Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _scaled(batch.column(0), width)
            n += len(x)
            # halves of 32 bits, so that no sum of a task leaves its 64
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)],
            names=["dim", "n", "high", "low"],
        )

    wide = "decimal(38,0)"
    sums = (
        rows.mapInArrow(run, "dim int, n bigint, high bigint, low bigint").groupBy("dim")
        .agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
        .orderBy("dim").collect()  # one row per dimension
    )
    return sums[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in sums]


def folded(blocks: DataFrame, width: int) -> np.ndarray:
    """Triangular factor of rows (one array<double> or binary column of doubles), by a tree of QR reductions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, width))
        for batch in batches:
            for value in batch.column(0):
                part = np.frombuffer(value.as_buffer(), dtype=np.float64).reshape(-1, width)
                kept = np.linalg.qr(np.vstack([kept, part]), mode="r")
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array([kept.tobytes()], pa.binary())], names=["block"])

    factors = materialise(blocks.mapInArrow(run, "block binary"))
    left = factors.count()
    while left > 1:
        left = -(-left // FAN)
        factors = factors.repartition(left).mapInArrow(run, "block binary")
    found = factors.first()
    factor = np.zeros((width, width))
    if found:
        part = np.frombuffer(found["block"], dtype=np.float64).reshape(-1, width)
        factor[: len(part)] = part
    return factor


def bidiagonal(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): diagonal and superdiagonal of u' * factor * v for orthogonal u and v, and v."""
    rest, n = factor.copy(), len(factor)
    right = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0:
            return None
        w = x / size
        w[0] += 1.0 if w[0] >= 0 else -1.0
        return w / np.linalg.norm(w)

    for k in range(n):
        w = reflector(rest[k:, k])
        if w is not None:
            rest[k:, k:] -= 2 * np.outer(w, w @ rest[k:, k:])
        if k + 2 < n:
            w = reflector(rest[k, k + 1 :])
            if w is not None:
                rest[k:, k + 1 :] -= 2 * np.outer(rest[k:, k + 1 :] @ w, w)
                right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ w, w)
    return np.diag(rest).copy(), np.diag(rest, 1).copy(), right


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool] | None:
    """One dqds transform: new q and e, the least d, and whether it was the last. None if the shift was too large."""
    d = q[0] - shift
    low, new_q, new_e = d, [], []
    for i, x in enumerate(e):
        if d < 0:
            return None
        top = d + x
        ratio = q[i + 1] / top if top > 0 else 1.0
        new_q.append(top)
        new_e.append(x * ratio)
        d = d * ratio - shift
        low = min(low, d)
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e, low, low == d


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> list[float]:
    """Squares of the singular values of a bidiagonal matrix by dqds, largest first."""
    unit = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if unit == 0:
        return [0.0] * len(a)
    found, todo = [], [(((a / unit) ** 2).tolist(), ((b / unit) ** 2).tolist(), 0.0)]
    while todo:
        q, e, moved = todo.pop()
        low, at_end, sweeps = 0.0, False, 100 * len(q) + 100
        while q:
            if len(q) == 1 or e[-1] <= TOLERANCE * (moved + q[-1]):
                found.append(moved + q.pop())
                if e:
                    e.pop()
                low, at_end = 0.0, False
                continue
            split = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= TOLERANCE * moved or e[i] == 0), None)
            if split is not None:
                todo.append((q[: split + 1], e[:split], moved))
                q, e = q[split + 1 :], e[split + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q.reverse()
                e.reverse()
                low, at_end = 0.0, False
            # at the end the last row bounds the least value from below, elsewhere a share of the least d is tried
            bound = q[-1] - (q[-1] * e[-1]) ** 0.5 if at_end else low / 4
            for shift in (max(bound, 0.0), max(bound, 0.0) / 8, 0.0):
                done = _step(q, e, shift)
                if done is not None:
                    break
            q, e, low, at_end = done
            moved += shift
            sweeps -= 1
            if sweeps < 0:
                raise ArithmeticError("qd transforms did not converge")
    return sorted((x * unit * unit for x in found), reverse=True)


def _twisted(a: np.ndarray, b: np.ndarray, value: float, seen: np.ndarray) -> tuple[np.ndarray, float]:
    """Eigenvector of b'b near ``value`` and the correction of the value, by a twisted factorisation.

    ``seen`` holds the shares other vectors of the same cluster have of each coordinate; the twist avoids them.
    """
    n, tiny = len(a), EPS * value + np.finfo(float).tiny
    square, ratio, both, off = a * a, b / a[:-1], a[:-1] * b, b * b
    stationary, progressive = np.empty(n), np.empty(n)
    down, up = np.empty(n), np.empty(n)
    s = stationary[0] = -value
    for i in range(n - 1):
        pivot = (s + square[i]) or tiny
        down[i] = both[i] / pivot
        s = stationary[i + 1] = down[i] * ratio[i] * s - value
    p = progressive[n - 1] = square[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = (off[i] + p) or tiny
        t = square[i] / pivot
        up[i] = ratio[i] * t
        p = progressive[i] = p * t - value
    gamma = stationary + progressive + value
    twist = int(np.argmax((1.0 - np.minimum(seen, 1.0) + EPS) / np.maximum(np.abs(gamma), EPS * tiny)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -up[i] * z[i]
    norm = np.linalg.norm(z)
    return z / norm, gamma[twist] / norm**2


def _apart(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray | None:
    """Unit vector of what ``z`` has beyond the others; None if that is rounding."""
    for _ in range(2):
        for other in others:
            z = z - (z @ other) * other
        size = np.linalg.norm(z)
        if size < 1e-4:
            return None
        z = z / size
    return z


def _another(a: np.ndarray, b: np.ndarray, value: float, others: list[np.ndarray], first: int) -> np.ndarray:
    """A further eigenvector of a cluster too tight for twists: inverse iteration beside the others."""
    n = len(a)
    square = np.diag(a) + np.diag(b, 1)
    square = square.T @ square - value * (1 + 8 * EPS) * np.eye(n)
    z = _apart(np.eye(n)[first], others)
    for _ in range(3):
        z = _apart(np.linalg.solve(square, z), others)
    return z


def directions(factor: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, trace) of factor' * factor: at most ``most`` leading eigenpairs, vectors as columns.

    Directions whose singular value is rounding beside the largest are left out. A vector's largest entry is positive.
    """
    n = len(factor)
    a, b, right = bidiagonal(factor)
    squares = squared_singular_values(a, b)
    trace = float(sum(squares))
    lead = [v for v in squares[:most] if v > (n * EPS) ** 2 * squares[0]]
    # a zero on the diagonal has no factorisation; at this size it changes nothing that is kept
    a = np.where(np.abs(a) < EPS * np.sqrt(squares[0]) * EPS, EPS * EPS * np.sqrt(squares[0]) + np.finfo(float).tiny, a)
    vectors: list[np.ndarray] = []
    for k, value in enumerate(lead):
        cluster = [z for z, other in zip(vectors, lead) if other - value < 1e-6 * value]
        seen = sum((z * z for z in cluster), np.zeros(n))
        z, change = _twisted(a, b, value, seen)
        if not cluster and abs(change) < 1e-8 * value:
            z, _ = _twisted(a, b, value + change, seen)
        z = _apart(z, cluster)
        if z is None:
            z = _another(a, b, value, cluster, int(np.argmin(seen)))
        vectors.append(z)
    if not lead:
        return np.zeros(0), np.zeros((n, 0)), trace
    out = right @ np.stack(vectors, axis=1)
    out *= np.where(np.take_along_axis(out, np.abs(out).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    return np.array(lead), out, trace


def _deviations(y: np.ndarray, n: int, r: list[int]) -> list[int | None]:
    """Per row the sum over dimensions of (n * y - r) squared, exactly; None where a long cannot hold it."""
    guess = ((float(n) * y - np.array(r, dtype=float)) ** 2).sum(axis=1)
    small = guess < 2.0**62
    t = np.int64(n) * y[small] - np.array(r, dtype=np.int64)
    out: list[int | None] = [None] * len(y)
    for i, total in zip(np.flatnonzero(small).tolist(), (t * t).sum(axis=1).tolist()):
        out[i] = total
    for i in np.flatnonzero(~small & (guess < 2.0**64)).tolist():
        total = sum((n * int(v) - w) ** 2 for v, w in zip(y[i], r))
        out[i] = total if total <= LONG else None
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """Per vector and component up to ``most``: ``key``, ``component``, ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``.

    Entries c become x = floor(1024 * c) + 100000. Rows whose vector is null or holds null or non-finite entries
    are dropped, and so are vectors that are not of the most frequent length. All others are the fit list:
    repeated rows and keys count each time and null keys are rows as any other. Components belong to positive
    eigenvalues only: equal vectors and an empty table give no rows, and vectors of a lower rank fewer components.
    ``deviation`` is null where a long cannot hold it. ``identity_error`` is measured on the whitened values: the
    largest absolute entry of their covariance minus the identity. Other columns are not read.
    """
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    good = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).filter(finite("v"))
    width = usual_width(good, "v")
    none = vectors.sparkSession.createDataFrame([], schema)
    if width == 0:
        return none
    good = good.filter(F.size("v") == width)
    n, sums = _column_sums(good.select("v"), width)
    whole, part = np.array([s // n for s in sums], dtype=np.int64), [s % n for s in sums]
    tail = np.array([r / n for r in part])

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (_scaled(batch.column(0), width) - whole) - tail
            yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], names=["block"])

    factor = folded(good.select("v").mapInArrow(centred, "block binary"), width)
    values, right, trace = directions(factor, most)
    count = len(values)
    if count == 0:
        return none
    project, names = right / np.sqrt(values / n), [f"w{i}" for i in range(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _scaled(batch.column(1), width) - whole
            w = (y - tail) @ project
            columns = [batch.column(0), pa.array(_deviations(y, n, part), pa.int64()), *[pa.array(w[:, i]) for i in range(count)]]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "deviation", *names])

    fields = ", ".join(f"{w} double" for w in names)
    rows = materialise(good.mapInArrow(run, f"k {kind}, deviation bigint, {fields}"))
    pairs = [(i, j) for i in range(count) for j in range(i + 1)]
    found = rows.agg(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, found))
    each = F.array(*[
        F.struct(F.lit(i + 1).alias("component"), F.col(w).alias("whitened"), F.lit(float(values[i] / trace)).alias("explained"))
        for i, w in enumerate(names)
    ])
    return rows.select("k", "deviation", F.explode(each).alias("c")).select(
        F.col("k").alias(key), "c.component", F.lit(n).cast("bigint").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(float(error)).alias("identity_error"),
    )
