"""Whitening of embeddings; the components come from FEAST contour integration.

Sums and the covariance V are gathered by Spark from all vectors, as exact sums
and centred products of each batch.  Only V, a matrix as wide as the vectors,
reaches the driver.  The top of its spectrum is cut into intervals
(a, b) whose borders lie in gaps; for each, the projection of a random subspace
onto the eigenvectors with values in it is a contour integral of (z - V)^-1,
whose quadrature needs one complex shifted solve per node.  The solves are Spark
tasks.  Rayleigh-Ritz in the projected subspace gives values and vectors, and
the projection is repeated until their residuals are at rounding.  The inertia
of V - a and V - b says how many there must be; a subspace that gave fewer is enlarged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import missing_columns, staged

SCALE, SHIFT = 1024, 100_000
#: quadrature nodes on the upper half of a contour (Gauss-Legendre)
NODES = 8
#: an interval spans at most this factor, so that its small values are as well resolved as its large ones
SPAN = 4.0
#: no value lies within this relative distance of a border, where the spectrum allows it
CLEAR = 1e-3
#: residual, relative to V, at which a pair counts as found: a few roundings
RESIDUAL = 1e-13
#: variance, relative to the largest, from which on a direction counts as constant
CONSTANT = 1e-12
#: entries beyond this after scaling have no exact long in double arithmetic
LARGEST = float(1 << 52)
ROUNDS = 12


@dataclass(frozen=True)
class Basis:
    """`values` fall, `vectors` are the columns that belong to them; `mean`, `sums` and `n` of the fitted vectors, `trace` of V."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def finite(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is there and has finite entries only.

    An entry that does not fit an exact long after scaling counts as not finite.  Of vectors of several lengths the commonest
    length stays (the longer one of equally common ones).
    """
    whole = F.forall(F.col(f"`{vector}`").cast("array<double>"), lambda c: F.coalesce(F.abs(c) * SCALE + SHIFT < LARGEST, F.lit(False)))
    rows = df.where(F.col(f"`{vector}`").isNotNull() & whole)
    sizes = rows.groupBy(F.size(F.col(f"`{vector}`")).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows if sizes is None else rows.where(F.size(F.col(f"`{vector}`")) == sizes["size"])


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as longs: one row each of floor(1024 * c) + 100000."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(len(column), len(flat) // max(1, len(column))) * SCALE).astype(np.int64) + SHIFT


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for b in batches:
        x = matrix(b.column(0))
        # exact whatever the number of rows: high and low halves do not overflow before 2^31 rows
        part = [(int(h) << 26) + int(low) for h, low in zip((x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0), strict=True)]
        total = part if total is None else [s + p for s, p in zip(total, part, strict=True)]
        n += len(x)
    if n:
        columns = (range(len(total)), pa.int64()), ([str(s) for s in total], pa.string()), ([n] * len(total), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["i", "s", "n"])


def _partial_products(mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            y = matrix(b.column(0)) - mean
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield _rows_of(enumerate(total))

    return run


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[i] = total.get(i, 0.0) + np.frombuffer(row)
    if total:
        yield _rows_of(sorted(total.items()))


def _rows_of(rows) -> pa.RecordBatch:
    index, values = zip(*((int(i), row.tobytes()) for i, row in rows), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(values, pa.binary())], ["i", "row"])


def covariance(rows: DataFrame, vector: str) -> tuple[int, list[int], np.ndarray]:
    """Number, sums and covariance of the vectors; tasks send d rows each, which are added up by row number."""
    only = rows.select(F.col(f"`{vector}`").alias("vector"))
    found = (only.mapInArrow(_partial_sums, "i long, s string, n long").groupBy("i")
             .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect())
    if not found:
        return 0, [], np.zeros((0, 0))
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    mean = np.array([s / n for s in sums])
    parts = only.mapInArrow(_partial_products(mean), "i long, row binary").repartition("i").mapInArrow(_add_rows, "i long, row binary")
    v = np.array([np.frombuffer(r["row"]) for r in sorted(parts.collect(), key=lambda r: r["i"])]) / n
    return n, sums, (v + v.T) / 2


# ------------------------------------------------------------------ inertia

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a matrix congruent to V by an orthogonal one (Householder)."""
    a, d = v.copy(), len(v)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += norm if x[0] >= 0 else -norm
        x /= np.linalg.norm(x)
        p = a[k + 1:, k + 1:] @ x
        p -= (x @ p) * x
        a[k + 1:, k + 1:] -= 2 * (np.outer(p, x) + np.outer(x, p))
        a[k + 1, k] = a[k, k + 1] = -norm if a[k + 1, k] >= 0 else norm
    return np.diag(a).copy(), np.diag(a, 1) ** 2


def above(t: tuple[np.ndarray, np.ndarray], sigma: float) -> int:
    """Eigenvalues above sigma: positive pivots of the LDL' factors of T - sigma (Sylvester's law of inertia)."""
    diagonal, off = t
    count, q = 0, 1.0
    least = np.finfo(float).tiny * 1e20
    for i in range(len(diagonal)):
        q = diagonal[i] - sigma - (off[i - 1] / q if i else 0.0)
        if abs(q) < least:
            q = -least
        count += q > 0
    return count


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(a, b, number of values in it) from the top down, with at least the k largest values of V that are not 0."""
    t = tridiagonal(v)
    top = float(np.abs(v).sum(1).max()) * (1 + 1e-12)
    if top == 0:
        return []
    floor = top * CONSTANT

    def nth(m: int) -> float:
        """A number just below the m-th largest value."""
        low, high = 0.0, top
        while high - low > CLEAR / 8 * max(high, floor):
            mid = (low + high) / 2
            low, high = (mid, high) if above(t, mid) >= m else (low, mid)
        return low

    k = min(k, above(t, floor))
    if k == 0:
        return []
    low, lowest = nth(k), k
    while lowest < len(v):  # on to the next gap, so that close values are found together
        lowest = above(t, max(low * (1 - CLEAR), floor))
        low = nth(lowest)
        if low * (1 - CLEAR) <= floor or above(t, low * (1 - CLEAR)) == lowest:
            break
    bottom = max(low * (1 - CLEAR / 2), floor)
    upper = min(top, nth(1) * (1 + CLEAR)) if above(t, nth(1) * (1 + CLEAR)) == 0 else top
    out, b = [], upper
    while b > bottom:
        a = max(bottom, b / SPAN)
        while a > bottom and above(t, a * (1 + CLEAR)) != above(t, a * (1 - CLEAR)):
            a = max(bottom, a * (1 - CLEAR))
        inside = above(t, a) - above(t, b)
        if inside:
            out.append((a, b, inside))
        b = a
    return out


# ------------------------------------------------------------------ FEAST

def _contour(v: np.ndarray, a: float, b: float, basis: np.ndarray, node: int) -> np.ndarray:
    """The share of one quadrature node in the projection of `basis` onto the eigenvectors with values in (a, b)."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    theta = -np.pi / 2 * (x[node] - 1)
    centre, radius = (a + b) / 2, (b - a) / 2
    turn = radius * np.exp(1j * theta)
    solved = np.linalg.solve((centre + turn) * np.eye(len(v)) - v, basis.astype(complex))
    return w[node] / 2 * (turn * solved).real


def _solver(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, bounds, bases = sent.value
        for batch in batches:
            shares = []
            which = batch.column(0).to_pylist()
            for i, node in zip(which, batch.column(1).to_pylist(), strict=True):
                shares.append(_contour(v, *bounds[i], bases[i], node).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(shares, pa.binary())], ["i", "share"])

    return run


def projected(spark: SparkSession, v: np.ndarray, bounds: list[tuple[float, float]], bases: list[np.ndarray]) -> list[np.ndarray]:
    """Each basis, projected onto its interval: one solve per interval and node, dealt to the tasks."""
    sent = spark.sparkContext.broadcast((v, bounds, bases))
    solves = spark.range(len(bounds) * NODES, numPartitions=min(len(bounds) * NODES, spark.sparkContext.defaultParallelism))
    shares = solves.selectExpr(f"id div {NODES} AS i", f"cast(id % {NODES} AS int) AS node").mapInArrow(_solver(sent), "i long, share binary").collect()
    sent.destroy()
    out = [np.zeros_like(y) for y in bases]
    for i, share in shares:
        out[i] += np.frombuffer(share).reshape(out[i].shape)
    return out


def ritz(v: np.ndarray, subspace: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, vectors and residuals of V in the span of `subspace`."""
    q, s, _ = np.linalg.svd(subspace, full_matrices=False)
    q, _ = np.linalg.qr(q[:, s > s[0] * 1e-15])
    values, inner = np.linalg.eigh(q.T @ v @ q)
    vectors = q @ inner
    return values, vectors, np.linalg.norm(v @ vectors - vectors * values, axis=0)


def feast(spark: SparkSession, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of V that are not 0 (fewer if there are fewer) and their vectors, falling."""
    d, rng = len(v), np.random.default_rng(13)
    todo = intervals(v, k)
    bases = [rng.standard_normal((d, min(d, max(n + 4, n + n // 2)))) for _, _, n in todo]
    enough = RESIDUAL * max(1.0, np.sqrt(d)) * float(np.linalg.norm(v, 2))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    best = [np.inf] * len(todo)
    for _ in range(ROUNDS):
        if not todo:
            break
        spans = projected(spark, v, [(a, b) for a, b, _ in todo], bases)
        open_, next_bases, next_best = [], [], []
        for (a, b, n), span, before in zip(todo, spans, best, strict=True):
            values, vectors, residual = ritz(v, span)
            inside = (values > a) & (values < b)
            worst = residual[inside].max() if inside.any() else np.inf
            if inside.sum() == n and (worst <= enough or (worst >= before / 2 and worst <= 100 * enough)):
                done.append((values[inside], vectors[:, inside]))
                continue
            if inside.sum() != n or worst >= before / 2:  # no progress: a larger subspace
                more = min(d, 2 * vectors.shape[1] + 4) - vectors.shape[1]
                vectors = np.hstack([vectors, rng.standard_normal((d, more))])
            open_.append((a, b, n))
            next_bases.append(vectors)
            next_best.append(worst)
        todo, bases, best = open_, next_bases, next_best
    if todo:
        raise RuntimeError(f"components in {[t[:2] for t in todo]} did not settle in {ROUNDS} rounds")
    if not done:
        return np.zeros(0), np.zeros((d, 0))
    values, vectors = np.concatenate([x for x, _ in done]), np.hstack([x for _, x in done])
    order = np.argsort(-values, kind="stable")[:k]
    if len(done) == 1:
        return values[order], vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    # vectors of different intervals are orthogonal to rounding over their distance only
    q, _ = np.linalg.qr(vectors[:, order])
    values, inner = np.linalg.eigh(q.T @ v @ q)
    return values[::-1], (q @ inner)[:, ::-1]


# ------------------------------------------------------------------ whitening

def fit(rows: DataFrame, vector: str, k: int = 8) -> Basis:
    """Mean and leading components of all `rows`, as `finite` returns them."""
    n, sums, v = covariance(rows, vector)
    values, vectors = feast(rows.sparkSession, v, k) if len(v) else (np.zeros(0), np.zeros((0, 0)))
    return Basis(n, sums, values, vectors, float(np.trace(v)) if n else 0.0)


def _transformer(basis: Basis):
    mean = np.array([s / basis.n for s in basis.sums]) if basis.n else np.zeros(0)
    scaled = basis.vectors / np.sqrt(basis.values) if len(basis.values) else basis.vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            white = (x - mean) @ scaled
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviations(x, basis), pa.int64()), pa.array(list(white), pa.list_(pa.float64()))],
                                             ["key", "deviation", "whitened"])

    return run


def deviations(x: np.ndarray, basis: Basis) -> list[int | None]:
    """Exact sum over the dimensions of (n * x - S)^2; None where it does not fit a long."""
    apart = np.array([[basis.n * c - s for c, s in zip(row, basis.sums, strict=True)] for row in x.tolist()], object) if _large(x, basis) else None
    if apart is None:
        y = basis.n * x - np.array(basis.sums, np.int64)
        if float(np.abs(y.astype(float)).max(initial=0.0)) ** 2 * max(1, x.shape[1]) < 2.0 ** 62:
            return (y * y).sum(1).tolist()
        apart = y.astype(object)
    return [s if s < 1 << 63 else None for s in (sum(c * c for c in row) for row in apart.tolist())]


def _large(x: np.ndarray, basis: Basis) -> bool:
    return basis.n * float(np.abs(x.astype(float)).max(initial=0.0)) >= 2.0 ** 61 or max(map(abs, basis.sums), default=0) >= 1 << 61


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8) -> DataFrame:
    """One row per vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Vectors that are NULL or hold NULL or non-finite entries are left out, see `finite`.  Components with (relative) variance
    below 1e-12 cannot be whitened and are left out as well, so a table of one vector, or of equal ones, gives no rows, like
    an empty one.  Rows that repeat count as often as they occur; keys may be NULL or repeat; other columns have no influence.
    A deviation beyond 64 bits is NULL.
    """
    missing_columns(df, key, vector)
    spark = df.sparkSession
    rows = finite(df, vector)
    basis = fit(rows, vector, k)
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, deviation long, whitened array<double>"
    if not len(basis.values):
        white, error = spark.createDataFrame([], schema), 0.0
    else:
        white = staged(rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector")).mapInArrow(_transformer(basis), schema), "whitened")
        error = identity_error(white, len(basis.values))
    shares = F.array(*[F.lit(float(e / basis.trace)) for e in basis.values]) if len(basis.values) else F.array().cast("array<double>")
    return white.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(basis.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def identity_error(white: DataFrame, k: int) -> float:
    """Largest entry, without sign, of the covariance of the whitened vectors minus the identity; measured on all of them."""
    at = [F.col("whitened")[i] for i in range(k)]
    mean = white.agg(*[F.avg(c) for c in at]).first()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = white.agg(*[F.avg((at[i] - mean[i]) * (at[j] - mean[j])) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))
