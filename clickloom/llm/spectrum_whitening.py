"""Whitening of embedding vectors by spectrum slicing.

Vectors become integers first (``floor(64 c) + 1000000``), so their moments are exact. Tasks sum them up, Spark
adds up the sums of the tasks, and the driver gets the (dims + 1)(dims + 2) / 2 totals, whatever the number of vectors.
Of the covariance, counts of positive pivots of LDLᵀ factorisations of V - shift (Sylvester's law of inertia) isolate
each leading eigenvalue in an interval of its own; Rayleigh quotient iteration, started by inverse iteration at the middle
of the interval, converges cubically; counts on both sides of the result certify its number. Eigenvalues
nearer to each other than rounding allows to tell make a cluster, whose vectors are kept orthogonal.

Cases: vectors that are null or hold null or non-finite entries are dropped, and so are those whose length is not the most
frequent one (the longest in a tie). Entries beyond +-2^53 / 64 count as that. Components whose variance is zero up to
rounding (dims * 2^-52 of the largest) can't be scaled to one and are left out: constant or repeated columns, fewer vectors than
components, no vectors. A deviation beyond 64 bits is null. Repeated rows and null ids count row by row. An empty table gives
no rows. Only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickloom.session import cut_lineage

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
ROWS = 8_192  # vectors at a time in a task
_EPS = float(np.finfo(float).eps)
_LIMIT = 2.0**53
_PIVOT = (1 + 17**0.5) / 8  # bound of element growth for 1 x 1 and 2 x 2 pivots


def above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric ``a`` above ``shift``: positive pivots of LDLᵀ of ``a - shift``.

    Pivots are single entries or 2 x 2 blocks (which hold one positive and one negative eigenvalue), chosen
    so that the elements can't grow without bound.
    """
    m = a - shift * np.eye(len(a))
    n, k, count = len(a), 0, 0
    while k < n:
        pivot, below = abs(m[k, k]), np.abs(m[k + 1 :, k])
        size, other = 1, None
        if len(below) and (largest := below.max()) > 0 and pivot < _PIVOT * largest:
            r = k + 1 + int(below.argmax())
            row = np.abs(m[r, k:])
            row[r - k] = 0
            if pivot * row.max() < _PIVOT * largest**2:
                size, other = (1, r) if abs(m[r, r]) >= _PIVOT * row.max() else (2, r)
        if other is not None and other != (at := k + size - 1):
            m[[at, other]] = m[[other, at]]
            m[:, [at, other]] = m[:, [other, at]]
        if size == 2:
            block, side = m[k : k + 2, k : k + 2], m[k + 2 :, k : k + 2]
            m[k + 2 :, k + 2 :] -= side @ np.linalg.solve(block, side.T)
            count += 1
        elif m[k, k] != 0:
            side = m[k + 1 :, k]
            m[k + 1 :, k + 1 :] -= np.outer(side, side / m[k, k])
            count += int(m[k, k] > 0)
        k += size
    return count


class Slices:
    """Counts of eigenvalues above the shifts tried so far."""

    def __init__(self, a: np.ndarray):
        self.a, self.bound = a, float(np.abs(a).sum(axis=1).max())
        edge = self.bound * (1 + 1e-9) or 1.0
        self.known = {-edge: len(a), edge: 0}

    def count(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = above(self.a, shift)
        return self.known[shift]

    def around(self, k: int) -> tuple[float, float]:
        """The narrowest known interval that holds eigenvalue ``k`` (1: the largest)."""
        low = max(s for s, c in self.known.items() if c >= k)
        return low, min(s for s, c in self.known.items() if c < k and s > low)

    def isolate(self, k: int, width: float) -> tuple[float, float]:
        """Bisect until eigenvalue ``k`` is alone, or the interval is as narrow as ``width``."""
        low, high = self.around(k)
        while high - low > width and self.count(low) - self.count(high) > 1:
            self.count((low + high) / 2)
            low, high = self.around(k)
        return low, high


def _solved(a: np.ndarray, shift: float, v: np.ndarray, nudge: float) -> np.ndarray:
    for step in (0.0, nudge, -3 * nudge):  # the shift may be an eigenvalue to the last bit
        try:
            w = np.linalg.solve(a - (shift + step) * np.eye(len(a)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(w).all() and w.any():
            return w / np.abs(w).max()
    return v


def _apart(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along the vectors found, at length one."""
    for _ in range(2):
        if found:
            basis = np.stack(found)
            v = v - basis.T @ (basis @ v)
    return v / np.linalg.norm(v)


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of the symmetric ``a``, falling, and their unit vectors as rows."""
    if not a.any():  # any vectors do
        return np.zeros(count), np.eye(len(a))[:count]
    slices, rng = Slices(a), np.random.default_rng(13)
    tight = 4 * len(a) * _EPS * slices.bound
    wide, values, vectors = a.astype(np.longdouble), [], []
    for k in range(1, count + 1):
        width, best = slices.bound, None
        while best is None:
            low, high = slices.isolate(k, tight)
            middle, v = (low + high) / 2, _apart(rng.normal(size=len(a)), vectors)
            for _ in range(3):
                v = _apart(_solved(a, middle, v, tight / 64), vectors)
            for _ in range(12):
                value = float(v @ a @ v)
                if np.linalg.norm(a @ v - value * v) <= 4 * _EPS * slices.bound or not low - tight <= value <= high + tight:
                    break
                v = _apart(_solved(a, value, v, tight / 64), vectors)
            value = float(v @ a @ v)
            small = np.linalg.norm(a @ v - value * v) <= tight
            if small and slices.count(value - tight) >= k > slices.count(value + tight):
                best = v
            elif high - low <= tight:
                if width <= tight:  # tried at full precision before
                    raise ArithmeticError(f"eigenvalue {k} could not be certified")
                width = high - low
            else:  # another one was found: halve the interval
                slices.count(middle)
        exact = best.astype(np.longdouble)
        values.append(float(exact @ wide @ exact / (exact @ exact)))
        vectors.append(best if best[np.abs(best).argmax()] > 0 else -best)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).reshape(-1, len(a))[order]


@dataclass
class Whitening:
    """Exact moments of the fit list and the components found in them. ``sums`` are those of x - 1000000."""

    n: int
    sums: list[int]
    values: np.ndarray
    explained: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)

    def white(self, y: np.ndarray) -> np.ndarray:
        mean = np.array([float(Fraction(s, self.n)) for s in self.sums])
        return (y - mean) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviation(self, y: np.ndarray) -> pa.Array:
        """Sum over the dimensions of (n x - S)^2, exactly."""
        far = self.n * float(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0)
        if far**2 * max(1, self.dims) < 2.0**62:
            off = self.n * y.astype(np.int64) - np.array(self.sums, np.int64)
            return pa.array((off * off).sum(axis=1))
        off = self.n * y.astype(np.int64).astype(object) - np.array(self.sums, object)
        return pa.array([int(v) if v < 1 << 63 else None for v in (off * off).sum(axis=1)], pa.int64())


def _vectors(batch: pa.RecordBatch, dims: int):
    """(ids, integers - 1000000 as doubles) of the usable vectors of a batch, some at a time."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        ids, lists = part.column(0), part.column(1)
        right = np.asarray(lists.value_lengths().fill_null(-1)) == dims
        ids, lists = ids.filter(pa.array(right)), lists.filter(pa.array(right))
        c = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls become NaN
        good = np.isfinite(c).all(axis=1)
        yield ids.filter(pa.array(good)), np.clip(np.floor(SCALE * c[good]), -_LIMIT, _LIMIT)


def _cross(y: np.ndarray) -> np.ndarray:
    """Exact products of all columns."""
    most = float(np.abs(y).max(initial=0))
    if most**2 * len(y) < _LIMIT:
        return (y.T @ y).astype(np.int64).astype(object)
    whole = y.astype(np.int64).astype(object)
    return whole.T.dot(whole)


def _length(table: DataFrame) -> int:
    most = table.filter("_v IS NOT NULL").groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return most["d"] if most else 0


def moments(table: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and sums of products of x - 1000000 over the usable vectors."""

    def run(batches):
        n, total = 0, None
        for batch in batches:
            for ids, y in _vectors(batch, dims):
                ones = np.concatenate([np.ones((len(y), 1)), y], axis=1)  # row 0: the number and the sums
                n, total = n + len(y), _cross(ones) if total is None else total + _cross(ones)
        if n:
            i, j = np.triu_indices(dims + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([str(v) for v in total[i, j]])], names=["i", "j", "q"])

    parts = table.mapInArrow(run, "i int, j int, q string")
    cells = parts.groupBy("i", "j").agg(F.sum(F.col("q").cast("decimal(38,0)")).alias("q")).collect()  # (dims + 1)(dims + 2) / 2 rows
    full = [[0] * (dims + 1) for _ in range(dims + 1)]
    for r in cells:
        full[r["i"]][r["j"]] = full[r["j"]][r["i"]] = int(r["q"])
    return full[0][0], full[0][1:], [row[1:] for row in full[1:]]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Moments, components and whitening error of all usable vectors; None where there is nothing to scale."""
    table = df.select(F.lit(None).cast("bigint").alias("_k"), F.col(vector).cast("array<double>").alias("_v"))
    dims = _length(table)
    n, s, q = moments(table, dims) if dims else (0, [], [])
    if not n:
        return None
    v = np.array([[float(Fraction(n * q[i][j] - s[i] * s[j], n * n)) for j in range(dims)] for i in range(dims)])
    values, vectors = leading(v, min(components, dims))
    kept = values > dims * _EPS * values[0]
    if not kept.any():
        return None
    trace = float(sum(Fraction(n * q[i][i] - s[i] * s[i], n * n) for i in range(dims)))
    model = Whitening(n, s, values[kept], values[kept] / trace, vectors[kept])
    model.identity_error = identity_error(table, model)
    return model


def identity_error(table: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance (divisor n) minus the identity.

    Each task centres its rows at their own mean before multiplying; the means are brought together afterwards.
    """
    k = len(model.values)

    def run(batches):
        for batch in batches:
            for ids, y in _vectors(batch, model.dims):
                if len(y):
                    w = model.white(y)
                    off = w - w.mean(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([len(w)]), pa.array([w.mean(axis=0).tolist()]), pa.array([(off.T @ off).ravel().tolist()])], names=["n", "mean", "m2"])

    parts = cut_lineage(table.mapInArrow(run, "n bigint, mean array<double>, m2 array<double>"))
    means = parts.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.lit(model.n)).alias("m"))
    mean = F.array(*[F.lit(float(r["m"])) for r in means.orderBy("i").collect()])  # one per component
    off = lambda at: F.get("mean", at.cast("int")) - F.get(mean, at.cast("int"))
    i, j = F.floor(F.col("at") / k), F.col("at") % k
    cells = parts.select("n", "mean", F.posexplode("m2").alias("at", "v")).select("at", (F.col("v") + F.col("n") * off(i) * off(j)).alias("v"))
    entries = cells.groupBy("at").agg((F.sum("v") / F.lit(model.n)).alias("v"))
    return entries.agg(F.max(F.abs(F.col("v") - (i == j).cast("double")))).first()[0]


def apply(df: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): one row per usable vector and component."""
    names = ["_k", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        k = len(model.values)
        for batch in batches:
            for ids, y in _vectors(batch, model.dims):
                rows = pa.array(np.repeat(np.arange(len(y)), k))
                cells = [
                    ids.take(rows),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                    pa.array(np.full(len(rows), model.n)),
                    model.deviation(y).take(rows),
                    pa.array(model.white(y).ravel()),
                    pa.array(np.tile(model.explained, len(y))),
                    pa.array(np.full(len(rows), model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(cells, names=names)

    table = df.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"))
    if model is None:
        run = lambda batches: (b for b in () if batches)
    schema = f"_k {dict(table.dtypes)['_k']}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return table.mapInArrow(run, schema).withColumnRenamed("_k", key)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on all usable vectors, then whiten each of them."""
    return apply(df, fit(df, vector, components), key, vector)
