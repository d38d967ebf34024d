"""Whitening of vectors by a bidiagonal qd solver.

1. Vectors are rounded to integers and each distinct one is kept once (the fit list).
2. Its rows, centred with exact sums, are reduced block by block to a triangular
   factor R (a QR of the factor so far with the next rows); factors of the tasks
   are combined in a tree, so that no task holds more than ``FAN`` of them.
3. R is made bidiagonal by Householder reflections; ``dqds`` (differential
   quotient-difference with shifts) finds all singular values to high relative
   accuracy; each wanted direction comes from a twisted factorisation, after a
   shift to a representation of its own where values lie close together.
4. Every row is projected on the leading directions and divided by their spread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtrail.llm.common import stored

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Triangular factors that one task combines.
FAN = 64
#: Numbers that the models of one pass may have (they are sent to every task); further lengths go in further passes.
PASS_NUMBERS = 4 << 20
_EPS = np.finfo(np.float64).eps
#: Values within this relative distance are a cluster.
_CLOSE = 1e-3


# ------------------------------------------------- Householder bidiagonalisation

def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, beta): ``x - 2 v (v.x)`` is ``beta`` in the first place and 0 elsewhere; v has length 1 or is 0."""
    size = np.abs(x).max()
    if size == 0 or not np.any(x[1:]):
        return np.zeros_like(x), float(x[0])
    v = x / size
    norm = np.sqrt(v @ v)
    beta = -norm if v[0] > 0 else norm
    v[0] -= beta
    return v / np.sqrt(v @ v), float(beta * size)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, right reflectors) of the bidiagonal form of a square matrix."""
    a = r.astype(np.float64).copy()
    d = len(a)
    diagonal, above, right = np.zeros(d), np.zeros(max(d - 1, 0)), []
    for k in range(d):
        v, diagonal[k] = _reflector(a[k:, k].copy())
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 1:
            v, above[k] = _reflector(a[k, k + 1:].copy())
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            right.append(v)
    return diagonal, above, right


def turned_back(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """Right singular vectors of the matrix from those (columns) of its bidiagonal form."""
    z = z.copy()
    for k in range(len(right) - 1, -1, -1):
        z[k + 1:] -= 2 * np.outer(right[k], right[k] @ z[k + 1:])
    return z


# ----------------------------------------------------------------------- dqds

def _step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, int]:
    """One dqds transform; the third result is the first place where it turned negative, or -1."""
    n = len(q)
    qq, ee = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for k in range(n - 1):
        if d < 0:
            return qq, ee, k
        qq[k] = d + e[k]
        ratio = q[k + 1] / qq[k] if qq[k] > 0 else 0.0
        ee[k] = e[k] * ratio
        d = d * ratio - shift if qq[k] > 0 else q[k + 1] - shift
    qq[n - 1] = d
    return qq, ee, n - 1 if d < 0 else -1


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, largest first."""
    tiny = (100 * _EPS) ** 2
    found: list[float] = []
    todo = [(diagonal.astype(np.float64) ** 2, above.astype(np.float64) ** 2, 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        while len(q):
            n = len(q)
            if n == 1 or e[-1] <= tiny * (sigma + q[-1]):
                found.append(sigma + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            split = np.flatnonzero(e <= tiny * np.maximum(sigma, np.minimum(q[:-1], q[1:])))
            if len(split):
                cut = int(split[-1]) + 1
                todo.append((q[:cut], e[:cut - 1], sigma))
                q, e = q[cut:], e[cut:]
                continue
            if 1.5 * q[0] < q[-1]:  # large values first, so that small ones come off at the end
                q, e = q[::-1].copy(), e[::-1].copy()
            # smaller value of the last two by two block
            t, c = q[-2] + e[-1] + q[-1], q[-2] * q[-1]
            root = t / 2 + np.sqrt(max(t * t / 4 - c, 0.0))
            shift = (c / root if root > 0 else 0.0) * (1 - 4 * _EPS)
            for _ in range(60):
                qq, ee, bad = _step(q, e, shift)
                if bad < 0:
                    break
                shift = 0.0 if shift < tiny * (sigma + q.max()) else shift / 4 if bad < n - 1 else shift * 0.75
            q, e, sigma = qq, ee, sigma + shift
    return np.sort(np.maximum(found, 0.0))[::-1]


# ------------------------------------------------------- twisted factorisations

def _shifted(d: np.ndarray, low: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """``L D L' - tau`` as another ``L D L'``."""
    n = len(d)
    dd, ll, s = np.empty(n), np.empty(n - 1), -tau
    for i in range(n - 1):
        dd[i] = d[i] + s or _EPS * abs(tau) or _EPS
        ll[i] = d[i] * low[i] / dd[i]
        s = ll[i] * low[i] * s - tau
    dd[n - 1] = d[n - 1] + s
    return dd, ll


def _below(d: np.ndarray, low: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Number of eigenvalues of ``L D L'`` below each ``x``."""
    s, count = -x, np.zeros(len(x), dtype=int)
    for i in range(len(d)):
        pivot = d[i] + s
        count += pivot < 0
        if i < len(low):
            pivot = np.where(pivot == 0, _EPS * np.abs(x) + 1e-300, pivot)
            s = s * (low[i] * low[i] * d[i] / pivot) - x
    return count


def _refined(d: np.ndarray, low: np.ndarray, rank: np.ndarray, guess: np.ndarray, slack: float) -> np.ndarray:
    """Eigenvalues number ``rank`` (from the smallest, 0) of ``L D L'`` by bisection around ``guess``."""
    a, b = guess - slack, guess + slack
    for _ in range(60):
        wide_a, wide_b = _below(d, low, a) > rank, _below(d, low, b) <= rank
        if not (wide_a.any() or wide_b.any()):
            break
        width = b - a
        a, b = np.where(wide_a, a - width, a), np.where(wide_b, b + width, b)
    for _ in range(120):
        middle = (a + b) / 2
        if (b - a <= 2 * _EPS * np.maximum(np.abs(a), np.abs(b))).all():
            break
        less = _below(d, low, middle) <= rank
        a, b = np.where(less, middle, a), np.where(less, b, middle)
    return (a + b) / 2


def _twisted(d: np.ndarray, low: np.ndarray, lam: float) -> tuple[np.ndarray, float]:
    """(unit vector, correction of ``lam``): factorisations from both ends meet where they fit best."""
    n = len(d)
    down, up, s, p = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0)), np.empty(n), np.empty(n)
    s[0] = -lam
    for i in range(n - 1):
        pivot = d[i] + s[i] or _EPS * abs(lam) or 1e-300
        down[i] = d[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - lam
    p[n - 1] = d[n - 1] - lam
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] * low[i] + p[i + 1] or _EPS * abs(lam) or 1e-300
        up[i] = low[i] * d[i] / pivot
        p[i] = p[i + 1] * d[i] / pivot - lam
    gamma = s + p + lam
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    norm = z @ z
    return z / np.sqrt(norm), gamma[k] / norm


def _lone_vector(d: np.ndarray, low: np.ndarray, lam: float) -> np.ndarray:
    """Vector of a value far from all others; the value is corrected until the vector's residual is rounding."""
    for _ in range(6):
        z, change = _twisted(d, low, lam)
        if not np.isfinite(change) or abs(change) <= 4 * _EPS * abs(lam):
            break
        lam += change
    return z


def _vectors(d: np.ndarray, low: np.ndarray, values: np.ndarray, wanted: set[int], depth: int = 0) -> dict[int, np.ndarray]:
    """Eigenvectors of ``L D L'`` by number (0 = largest value); ``values`` fall and are accurate in this representation."""
    n, out, start = len(values), {}, 0
    while start < n:
        stop = start + 1
        while stop < n and values[stop - 1] - values[stop] <= _CLOSE * abs(values[stop - 1]):
            stop += 1
        group = range(start, stop)
        if not wanted.intersection(group):
            pass
        elif stop - start == 1:
            out[start] = _lone_vector(d, low, values[start])
        else:
            out.update(_cluster(d, low, values, group, depth))
        start = stop
    return out


def _cluster(d: np.ndarray, low: np.ndarray, values: np.ndarray, group: range, depth: int) -> dict[int, np.ndarray]:
    """Vectors of values that lie close together: the representation is shifted to the cluster, where they are far apart."""
    members = np.array(group)
    top, bottom = values[members[0]], values[members[-1]]
    spread = max(top - bottom, 8 * _EPS * abs(top))
    if depth < 8:
        choices = [(tau, *_shifted(d, low, tau)) for tau in (top + spread / 2, bottom - spread / 2)]
        choices = [c for c in choices if np.isfinite(c[1]).all() and np.isfinite(c[2]).all()]
        if choices:
            tau, dd, ll = min(choices, key=lambda c: np.abs(c[1]).max())
            rank = len(values) - 1 - members
            near = np.sort(_refined(dd, ll, rank, values[members] - tau, spread / 4 + 4 * _EPS * abs(tau)))[::-1]
            apart = np.flatnonzero(near[:-1] - near[1:] > _CLOSE * np.abs(near[:-1]))
            if len(apart) or depth == 0:
                out, cuts = {}, [0, *(apart + 1).tolist(), len(near)]
                for x, y in zip(cuts, cuts[1:]):
                    if y - x == 1:
                        out[int(members[x])] = _lone_vector(dd, ll, near[x])
                    else:
                        filled = np.full(len(values), np.nan)
                        filled[members] = near
                        out.update(_cluster(dd, ll, filled, group[x:y], depth + 1))
                return out
    # values that no representation parts: any basis of their space will do
    return {int(i): _twisted(d, low, values[i])[0] for i in members}


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """Columns made orthogonal in order; a column that depends on earlier ones is replaced by another direction."""
    z = z.copy()
    for j in range(z.shape[1]):
        for step in range(z.shape[0] + 1):
            for _ in range(2):
                z[:, j] -= z[:, :j] @ (z[:, :j].T @ z[:, j])
            norm = np.sqrt(z[:, j] @ z[:, j])
            if norm > 1e-6:
                z[:, j] /= norm
                break
            z[:, j] = np.eye(z.shape[0])[(j + step) % z.shape[0]]
    return z


def leading_directions(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(largest eigenvalues of ``r' r``, unit eigenvectors as columns), at most ``count`` and none of numerical value 0."""
    diagonal, above, right = bidiagonal(r)
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if size == 0:
        return np.zeros(0), np.zeros((len(r), 0))
    diagonal, above = diagonal / size, above / size
    # a zero on the diagonal has no L D L'; one rounding error of the largest entry stands for it
    diagonal = np.where(np.abs(diagonal) < _EPS, _EPS, diagonal)
    above = np.where(np.abs(above) < _EPS * _EPS, 0.0, above)
    parts = np.split(np.arange(len(diagonal)), np.flatnonzero(above == 0) + 1)
    pairs = []
    for part in parts:
        a, b = diagonal[part], above[part[:-1]]
        values = dqds(a, b)
        pairs += [(v, part, k) for k, v in enumerate(values)]
    top = sorted(pairs, key=lambda x: -x[0])
    floor = (len(r) * _EPS) ** 2 * 16 * top[0][0]
    top = [x for x in top[:count] if x[0] > floor]
    z = np.zeros((len(r), len(top)))
    for part in parts:
        own = {k: j for j, (_, p, k) in enumerate(top) if p is part}
        if own:
            a, b = diagonal[part], above[part[:-1]]
            vectors = _vectors(a * a, b / a[:-1], dqds(a, b), set(own))
            for k, j in own.items():
                z[part, j] = vectors[k]
    values = np.array([v for v, _, _ in top])
    if np.abs(z.T @ z - np.eye(len(top))).max(initial=0.0) > 1e-12 or not np.isfinite(z).all():
        z = _orthonormal(np.nan_to_num(z))
    z = turned_back(z, right)
    sign = np.where(z[np.abs(z).argmax(axis=0), np.arange(z.shape[1])] < 0, -1.0, 1.0)
    return values * size * size, z * sign


# -------------------------------------------------------------------- on Spark

def usable(vector: Column) -> Column:
    """Whether a vector is not null or empty and has only finite entries."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def rounded(vector: Column) -> Column:
    """Entries as integers; those beyond 2^61 stop there."""
    edge = F.lit(float(1 << 61))
    return F.transform(vector.cast("array<double>"),
                       lambda c: F.floor(F.greatest(F.least(c * SCALE, edge), -edge)) + F.lit(OFFSET).cast("long"))


@dataclass
class Model:
    """Fit of the vectors of one length."""
    n: int
    sums: list[int]
    directions: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, exact: as integers of any size where 64 bits might not do."""
        reach = max(int(np.abs(x).max(initial=0)), 1) * self.n
        if max(reach, *map(abs, self.sums)) < 1 << 61:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(np.float64) / self.n) @ self.directions / np.sqrt(self.values)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_length(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.diff(batch.column(column).offsets.to_numpy())
    for dim in np.unique(sizes):
        yield int(dim), batch if (sizes == dim).all() else batch.filter(pa.array(sizes == dim))


def _sums(fit: DataFrame) -> dict[int, Model]:
    """Number of rows and exact sums of every length, added per task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        high: dict[int, np.ndarray] = {}
        low: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in _by_length(batch):
                x = _matrix(part.column("x"), dim)
                n[dim] = n.get(dim, 0) + len(x)
                high[dim] = high.get(dim, 0) + (x >> 32).sum(axis=0)
                low[dim] = low.get(dim, 0) + (x & 0xFFFFFFFF).sum(axis=0)
        for dim in n:
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n[dim]] * dim, pa.int64()),
                                              pa.array(high[dim], pa.int64()), pa.array(low[dim], pa.int64())], names=["dim", "at", "n", "high", "low"])

    # upper and lower halves are added apart, so that no sum can pass 64 bits
    rows = (fit.mapInArrow(run, "dim int, at int, n long, high long, low long").groupBy("dim", "at")
            .agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")))
    models: dict[int, Model] = {}
    for r in sorted(rows.toLocalIterator(), key=lambda r: (r.dim, r.at)):
        models.setdefault(r.dim, Model(r.n, [])).sums.append((int(r.high) << 32) + int(r.low))
    return models


def _factors(fit: DataFrame, models: dict[int, Model]) -> DataFrame:
    """One triangular factor per task and length: ``(dim, part, r)``."""
    given = fit.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        r: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in _by_length(batch):
                model = given.value[dim]
                x = model.deviations(_matrix(part.column("x"), dim)).astype(np.float64) / model.n
                r[dim] = np.linalg.qr(np.vstack((r[dim], x)) if dim in r else x, mode="r")
        for dim, factor in r.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([factor.ravel().tolist()], pa.list_(pa.float64()))], names=["dim", "part", "r"])

    return fit.mapInArrow(run, "dim int, part long, r array<double>")


def _combined(factors: DataFrame) -> DataFrame:
    """One factor per length; each step of the tree combines at most ``FAN``."""
    factors = stored(factors, "factors")

    def combine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[0])
        stack = np.vstack([np.asarray(r).reshape(-1, dim) for r in rows.sort_values("part")["r"]])
        return pd.DataFrame({"dim": [dim], "part": [int(key[1])], "r": [np.linalg.qr(stack, mode="r").ravel()]})

    parts = (factors.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        factors = factors.groupBy("dim", F.floor(F.col("part") / FAN).alias("up")).applyInPandas(combine, "dim int, part long, r array<double>")
        parts = -(-parts // FAN)
    return factors


def _identity_errors(fit: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest entry of the whitened fit list's covariance minus the identity, by length."""
    given = fit.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in _by_length(batch):
                model = given.value[dim]
                w = model.whitened(model.deviations(_matrix(part.column("x"), dim)))
                total[dim] = total.get(dim, 0) + w.T @ w
        for dim, products in total.items():
            row, col = np.indices(products.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(products.size, dim), pa.int32()), pa.array(row.ravel(), pa.int32()),
                                              pa.array(col.ravel(), pa.int32()), pa.array(products.ravel())], names=["dim", "i", "j", "w"])

    products = fit.mapInArrow(run, "dim int, i int, j int, w double").groupBy("dim", "i", "j").agg(F.sum("w").alias("w"))
    sizes = F.create_map(*[F.lit(x) for dim, m in models.items() for x in (dim, m.n)])
    off = F.abs(F.col("w") / F.element_at(sizes, F.col("dim")) - (F.col("i") == F.col("j")).cast("double"))
    return {r.dim: r.error for r in products.groupBy("dim").agg(F.max(off).alias("error")).collect()}


def _project(rows: DataFrame, models: dict[int, Model], kind: str) -> DataFrame:
    given = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                model = given.value[dim]
                off = model.deviations(_matrix(part.column("x"), dim))
                count = len(model.values)
                if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * dim < 1 << 63:
                    deviation = pa.array((off * off).sum(axis=1))
                else:
                    squares = (off.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([int(s) if s < 1 << 63 else None for s in squares], pa.int64())
                each = np.repeat(np.arange(len(part)), count)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1), len(part)), pa.int32()),
                     pa.array(np.full(len(each), model.n), pa.int64()), deviation.take(pa.array(each)), pa.array(model.whitened(off).ravel()),
                     pa.array(np.tile(model.values / model.trace, len(part))), pa.array(np.full(len(each), model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for every usable row and component.

    Vectors that are null, empty or hold a null or non-finite entry are dropped.
    The others become integers (``rounded``); the fit list holds each distinct one
    once, and covariances are over it.  Repeated rows, rows of one id and null
    ids keep their rows.  Vectors of different length are whitened apart.  A
    component without spread (a covariance of lower rank, a single vector)
    gives no rows.  ``deviation`` is null where the exact value passes 64 bits.
    Empty input gives no rows; extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
            .select("vec_id", rounded(F.col("v")).alias("x")))
    kind = rows.schema["vec_id"].dataType.simpleString()
    fit = stored(rows.select("x").distinct(), "fit_list")
    lengths = [r[0] for r in fit.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]
    passes: list[list[int]] = []
    for d in lengths:
        if not passes or sum(passes[-1]) + d > PASS_NUMBERS // (components + 2):
            passes.append([])
        passes[-1].append(d)
    return reduce(DataFrame.unionByName, [_whitened_lengths(rows, fit, p, components, kind) for p in passes]) if passes else spark.createDataFrame(
        [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _whitened_lengths(rows: DataFrame, fit: DataFrame, lengths: list[int], components: int, kind: str) -> DataFrame:
    among = F.size("x").isin(lengths)
    fit, rows = fit.where(among), rows.where(among)
    models = _sums(fit)
    sizes = F.create_map(*[F.lit(x) for dim, m in models.items() for x in (dim, m.n)])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, n, r in zip(batch["dim"], batch["n"], batch["r"]):
                factor = np.asarray(r).reshape(-1, dim) / np.sqrt(n)
                factor = np.vstack((factor, np.zeros((max(dim - len(factor), 0), dim))))
                values, z = leading_directions(factor, components)
                yield pd.DataFrame({"dim": [dim], "found": [values], "z": [z.ravel()], "trace": [float((factor ** 2).sum())]})

    solved = _combined(_factors(fit, models)).withColumn("n", F.element_at(sizes, F.col("dim"))).mapInPandas(
        solve, "dim int, found array<double>, z array<double>, trace double")
    for r in solved.toLocalIterator():
        models[r.dim].values, models[r.dim].trace = np.array(r.found, dtype=np.float64), r.trace
        models[r.dim].directions = np.array(r.z, dtype=np.float64).reshape(r.dim, -1) if r.found else np.zeros((r.dim, 0))
    for dim, error in _identity_errors(fit, models).items():
        models[dim].identity_error = error
    return _project(rows, models, kind)
