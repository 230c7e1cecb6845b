"""Embedding whitening by a bidiagonal qd solver.

1. Distinct integer vectors are the fit list. Their count and sums are exact.
2. Blockwise QR: every task reduces its centred rows, block by block, to one triangle;
   triangles meet ``FAN`` at a time until one is left. No covariance is
   formed, so small directions keep their accuracy.
3. On that triangle, whose size depends on the number of components alone:
   Householder reflections from both sides make it bidiagonal, dqds finds all its
   singular values, and twisted factorisations of the shifted squares give the
   vectors of the largest.
4. A second pass over the fit list takes the covariance of the whitened rows, and
   every row is projected in its own task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyspark.llm.common import bound_batches, discard, materialize
from policyspark.llm.vectors import integer_vectors, matrix

#: Triangles that one task combines.
FAN = 32
_EPS = np.finfo(float).eps


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and upper diagonal of a bidiagonal form of ``r``, and the reflectors that acted from the right."""
    a = r.astype(float).copy()
    n = a.shape[1]
    right: list[np.ndarray] = []

    def reflector(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        v[0] += math.copysign(float(np.linalg.norm(x)), x[0])
        length = np.linalg.norm(v)
        return v / length if length else v

    for k in range(n):
        v = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def singular_squares(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix by dqds, in no order.

    A step takes the squares q (diagonal) and e (upper) to those of a similar
    matrix, shifted by what is known to be below all of them; no step subtracts but for the shift, so small
    values keep their relative accuracy. A shift that makes a square negative is
    taken back and made smaller.
    """
    found: list[float] = []
    todo, steps = [((diagonal**2).tolist(), (upper**2).tolist(), 0.0)], 0
    while todo:
        q, e, shifted = todo.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + shifted)
                break
            if e[-1] <= _EPS**2 * (q[-1] + shifted):
                found.append(q.pop() + shifted)
                e.pop()
                continue
            cut = next((i for i in range(n - 1) if e[i] <= _EPS**2 * (min(q[i], q[i + 1]) + shifted)), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], shifted))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] * 1.5 < q[-1]:  # the small end belongs below
                q.reverse()
                e.reverse()
            # the last 2 by 2 block's lower square is a guess from above
            half = (q[-2] + e[-1] + q[-1]) / 2
            root = math.sqrt(max(0.0, half * half - q[-2] * q[-1]))
            shift = q[-2] * q[-1] / (half + root) if half + root > 0 else 0.0
            for lower in (1, 1 - 1e-8, 0.99, 0.75, 0.25, 0):
                if step := _dqds(q, e, shift * lower):
                    (q, e), shifted = step, shifted + shift * lower
                    break
            steps += 1
            if steps > 100 * len(diagonal):
                raise ArithmeticError("dqds didn't converge")
    return np.array(found)


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    d, new_q, new_e = q[0] - shift, [], []
    for i in range(len(e)):
        if d < 0:
            return None
        x = d + e[i]
        ratio = q[i + 1] / x if x > 0 else 0.0
        new_q.append(x)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift if x > 0 else q[i + 1] - shift
    if d < 0 and shift > 0:
        return None
    new_q.append(max(d, 0.0))
    return new_q, new_e


def twisted_vector(diagonal: np.ndarray, upper: np.ndarray, square: float, avoid: np.ndarray) -> np.ndarray:
    """Unit eigenvector of the squares of a bidiagonal matrix for the eigenvalue ``square``.

    The shifted matrix is factored from above and from below; where both meet with
    the smallest pivot, the vector is built outwards from a one. ``avoid`` has
    the vectors found before, as rows; for close eigenvalues the next twist whose vector
    isn't among them serves.
    """
    n = len(diagonal)
    tiny = _EPS * _EPS * max(square, np.finfo(float).tiny)
    a = np.where(diagonal**2 < tiny, math.sqrt(tiny), diagonal)
    d, off, low = a * a, a[:-1] * upper, upper / a[:-1]
    s, up = np.zeros(n), np.zeros(max(0, n - 1))
    s[0] = -square
    for i in range(n - 1):
        pivot = s[i] + d[i] or tiny
        up[i] = off[i] / pivot
        s[i + 1] = up[i] * low[i] * s[i] - square
    p, down = np.zeros(n), np.zeros(max(0, n - 1))
    p[-1] = d[-1] - square
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] ** 2 + p[i + 1] or tiny
        down[i] = off[i] / pivot
        p[i] = p[i + 1] * d[i] / pivot - square
    gamma = np.abs(s + p + square)
    best = None
    for r in np.argsort(gamma)[: len(avoid) + 1].tolist():
        z = np.zeros(n)
        z[r] = 1
        for i in range(r - 1, -1, -1):
            z[i] = -up[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -down[i] * z[i]
        z /= np.linalg.norm(z)
        rest = z - avoid.T @ (avoid @ z) if len(avoid) else z
        left = float(np.linalg.norm(rest))
        if best is None or left > best[0] * 1.5:
            best = left, rest
        if left > 0.9:
            break
    return best[1] / best[0]


def _blocks(diagonal: np.ndarray, upper: np.ndarray) -> list[tuple[int, int]]:
    """Ranges between entries of the upper diagonal that are nothing beside their neighbours."""
    size = np.abs(diagonal)
    cuts = np.flatnonzero(np.abs(upper) <= _EPS * (size[:-1] + size[1:]) / 2) + 1
    ends = [0, *cuts.tolist(), len(diagonal)]
    return list(zip(ends, ends[1:]))


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest squared singular values of a triangle, their right vectors as rows, and the sum of all squares.

    At most ``most``, and none that isn't above rounding.
    """
    n = r.shape[1]
    diagonal, upper, right = bidiagonal(r)
    pairs = [(v, a, b) for a, b in _blocks(diagonal, upper) for v in singular_squares(diagonal[a:b], upper[a : b - 1]).tolist()]
    total = math.fsum(v for v, _, _ in pairs)
    pairs = sorted((x for x in pairs if x[0] > total * n * _EPS**2), reverse=True)[:most]
    vectors = np.zeros((0, n))
    for k, (value, a, b) in enumerate(pairs):
        close = [i for i in range(k) if pairs[i][1:] == (a, b) and pairs[i][0] - value <= 1e-3 * value]
        z = np.zeros(n)
        z[a:b] = twisted_vector(diagonal[a:b], upper[a : b - 1], value, vectors[close][:, a:b])
        vectors = np.concatenate([vectors, z[None]])
    for k in range(len(vectors)):  # what rounding left of earlier ones
        for _ in range(2):
            vectors[k] -= vectors[:k].T @ (vectors[:k] @ vectors[k])
        vectors[k] /= np.linalg.norm(vectors[k])
    for k in range(len(right) - 1, -1, -1):
        v = right[k]
        vectors[:, k + 1 :] -= 2 * np.outer(vectors[:, k + 1 :] @ v, v)
    return np.array([p[0] for p in pairs]), vectors, total


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, in integers of any size where a long might not do."""
    kind = np.int64 if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 61 else object
    return x.astype(kind) * n - np.array(sums, kind)


def _packed(r: np.ndarray) -> bytes:
    return r.astype("<f8").tobytes()


def triangle(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factors of the centred rows of ``fit`` (x): blocks of a task first, then ``FAN`` tasks at a time."""
    size = len(sums)

    def reduce_rows(batches):
        r = np.zeros((0, size))
        for batch in batches:
            y = _centred(matrix(batch.column(0), size), n, sums).astype(float) / n
            r = np.linalg.qr(np.concatenate([r, y]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_packed(r)])], ["part", "r"])

    def combine(frame):
        r = np.zeros((0, size))
        for raw in frame["r"]:
            r = np.linalg.qr(np.concatenate([r, np.frombuffer(raw, "<f8").reshape(-1, size)]), mode="r")
        return pd.DataFrame({"part": frame["part"].iloc[:1], "r": [_packed(r)]})

    parts = materialize(fit.mapInArrow(reduce_rows, "part long, r binary"), "triangles")
    while parts.count() > 1:
        before = parts
        grouped = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part")
        parts = materialize(grouped.applyInPandas(combine, "part long, r binary"), "triangles")
        discard(before)
    r = np.frombuffer(parts.first()["r"], "<f8").reshape(-1, size)
    discard(parts)
    return np.linalg.qr(np.concatenate([r, np.zeros((size, size))]), mode="r") if len(r) < size else r


def _moments(fit: DataFrame, n: int, sums: list[int], turn: np.ndarray) -> np.ndarray:
    """Covariance of the rows of ``fit`` times ``turn``: each task centres its own rows, then means and squares are combined."""
    size, k = turn.shape

    def stage(batches):
        count, mean, square = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = (_centred(matrix(batch.column(0), size), n, sums).astype(float) / n) @ turn
            if not len(w):
                continue
            m = w.mean(axis=0)
            square += (w - m).T @ (w - m) + np.outer(m - mean, m - mean) * (count * len(w) / (count + len(w)))
            mean, count = mean + (m - mean) * (len(w) / (count + len(w))), count + len(w)
        yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([mean.tolist()]), pa.array([square.ravel().tolist()])], ["count", "mean", "square"])

    parts = fit.mapInArrow(stage, "count long, mean array<double>, square array<double>")
    # the rows' mean is zero but for rounding, so squares around tasks' means and the means' own add up
    own = [F.sum(F.col("square")[i] + F.col("count") * F.col("mean")[i // k] * F.col("mean")[i % k]).alias(f"s{i}") for i in range(k * k)]
    mean = [F.sum(F.col("count") * F.col("mean")[i]).alias(f"m{i}") for i in range(k)]
    r = parts.agg(*own, *mean).first()
    m = np.array([r[f"m{i}"] for i in range(k)]) / n
    return np.array([r[f"s{i}"] for i in range(k * k)]).reshape(k, k) / n - np.outer(m, m)


def whiten(embeddings: DataFrame, scale: int = 256, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: up to ``components`` rows for each usable row.

    Rows without a usable vector go, as ``integer_vectors`` says. The fit list has
    each distinct integer vector once; repeated rows each get their rows, null vec_ids too. Components are
    numbered from 1 by falling eigenvalue; directions without any spread (one vector only,
    or fewer dimensions) aren't components and have no rows. A deviation beyond a
    long is null. An empty table gives an empty result; other columns are ignored.
    """
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    bound_batches(spark)
    vectors, size = integer_vectors(embeddings, scale, ["vec_id"])
    if not size:
        return spark.createDataFrame([], out)
    fit = materialize(vectors.select("x").distinct(), "fit")

    def totals(batches):
        total, count = np.zeros(size, np.int64), 0
        for batch in batches:
            x = matrix(batch.column(0), size)
            total, count = total + x.sum(axis=0), count + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1), pa.int32()), pa.array([*total.tolist(), count], pa.int64())], ["at", "total"])

    added = fit.mapInArrow(totals, "at int, total long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums = [int(r["total"]) for r in added.orderBy("at").collect()]
    n = sums.pop()
    squares, found, total = directions(triangle(fit, n, sums), min(components, size))
    if not len(squares):
        discard(fit)
        return spark.createDataFrame([], out)
    turn = found.T / np.sqrt(squares / n)
    error = float(np.abs(_moments(fit, n, sums, turn) - np.eye(len(squares))).max())
    discard(fit)
    explained = (squares / total).tolist()

    def project(batches):
        for batch in batches:
            y = _centred(matrix(batch.column(1), size), n, sums)
            fits = int(np.abs(y).max(initial=0)) ** 2 * size < 1 << 63
            far = (y.astype(np.int64) ** 2).sum(axis=1) if fits else [v if v < 1 << 63 else None for v in (y.astype(object) ** 2).sum(axis=1)]
            w = (y.astype(float) / n) @ turn
            for k in range(w.shape[1]):
                m = len(w)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(m, k + 1), pa.int32()), pa.array(np.full(m, n), pa.int64()), pa.array(far, pa.int64()), pa.array(w[:, k]), pa.array(np.full(m, explained[k])), pa.array(np.full(m, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(project, out)
