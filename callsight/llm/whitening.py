"""Whitening of embeddings by an incremental eigendecomposition.

Vectors become integers, floor(256 c), and every distinct integer vector counts once for the fit.

1. Each partition holds the spectrum of the vectors it has seen (`Spectrum`: count, sums, eigenvalues
   and eigenvectors of their scatter) and takes every vector in as a centred rank-one update:
   S' = S + n / (n + 1) (x - m)(x - m)^T. The eigenvalues of a diagonal matrix with a rank-one change
   are the roots of a secular equation (`update`); entries that do not take part, and equal
   eigenvalues, are deflated first; the eigenvectors are computed from the vector for which the found
   roots are exact, which keeps them orthogonal.
2. Spectra are combined in a tree, MERGED at a time, by successive rank-one updates: one for each
   eigenvector of the smaller spectrum, and one for the difference of the means.
3. The basis is refined by Rayleigh-Ritz over all fitted vectors: partitions sum the products of
   centred vectors projected on it, and the small projected matrix is solved. As the basis spans the
   whole space, the components are eigenvectors of the covariance to double precision.

What moves is the fitted vectors once, to tell equal ones, then a matrix of dimensions x dimensions
per partition. Sums are exact integers.

Defined cases: rows whose vector is null, or holds null or entries that are not finite, are left out,
as are vectors of another length than the most frequent one (the longer of equally frequent ones);
rows that repeat are each answered; components whose eigenvalue is zero to double precision are not
returned, so vectors that are all equal, or no vectors, give none; a deviation beyond 64 bits is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight.llm.common import kept

SCALE = 256
COMPONENTS = 4
MERGED = 8  # spectra, or matrices, that a task combines
EPS = float(np.finfo(float).eps)


# ---- one rank-one change of a diagonal matrix


def _two_poles(c: np.ndarray, w1: np.ndarray, p1: np.ndarray, w2: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """The zero between the poles p1 < p2 of c + w1 / (p1 - x) + w2 / (p2 - x)."""
    b = c * (p1 + p2) + w1 + w2
    e = c * p1 * p2 + w1 * p2 + w2 * p1
    root = np.sqrt(np.maximum(b * b - 4 * c * e, 0))
    return np.where(b <= 0, (b - root) / (2 * c), 2 * e / (b + root))


def _roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum(z2 / (d - x)) for rising, distinct d, as (origin's number, distance from it).

    A root lies right above each pole, and is sought from the nearer one of the two poles around it. A step
    fits both poles, the nearer one with its own weight, and takes what is left as a constant; steps that
    leave the bracket are replaced by halving it.
    """
    k = len(d)
    weights = rho * z2
    at = np.arange(k)
    upper = np.append(d[1:], d[-1] + weights.sum())
    half = (upper - d) / 2
    terms = weights / (d - (d + half)[:, None])
    f = 1 + terms.sum(1)
    nearer = (f < 0) & (at < k - 1)
    origin = at + nearer
    delta = d - d[origin][:, None]
    pole_a, pole_b = np.where(nearer, d - upper, 0.0), np.where(nearer, 0.0, upper - d)
    own_a, own_b = weights, np.append(weights[1:], 0.0)
    low, high = np.where(nearer, -half, 0.0), np.where(nearer, 0.0, half)
    low[-1], high[-1] = (half[-1], pole_b[-1]) if f[-1] < 0 else (0.0, half[-1])
    with np.errstate(all="ignore"):
        x = _two_poles(f - own_a / -half - own_b / half, own_a, pole_a, own_b, pole_b)
        x = np.where((x > low) & (x < high), x, (low + high) / 2)
        sought = at
        for _ in range(80):
            now = x[sought]
            inverse = 1 / (delta - now[:, None])
            f, slope = 1 + inverse @ weights, (inverse * inverse) @ weights
            done = np.abs(f) <= 4 * EPS * (1 + np.abs(inverse) @ weights)
            low[sought], high[sought] = np.where(f < 0, now, low[sought]), np.where(f < 0, high[sought], now)
            if done.any():
                left = ~done
                sought, now, f, slope, delta = sought[left], now[left], f[left], slope[left], delta[left]
                if not len(sought):
                    break
            a, b = pole_a[sought] - now, pole_b[sought] - now
            near_b = nearer[sought]
            # the nearer pole keeps its weight, the other one takes the rest of the slope
            first = np.where(near_b, (slope - own_b[sought] / (b * b)) * a * a, own_a[sought])
            second = np.where(near_b, own_b[sought], (slope - own_a[sought] / (a * a)) * b * b)
            new = now + _two_poles(f - first / a - second / b, first, a, second, b)
            inside = (new > low[sought]) & (new < high[sought])
            x[sought] = np.where(inside, new, (low[sought] + high[sought]) / 2)
    return origin, x


def update(values: np.ndarray, vectors: np.ndarray, rho: float, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of vectors diag(values) vectors^T + rho y y^T, rho >= 0."""
    z = vectors.T @ y
    norm = float(np.sqrt(z @ z))
    if rho * norm == 0:
        return values, vectors
    z, rho = z / norm, rho * norm * norm
    limit = 8 * EPS * max(float(np.abs(values).max()), rho)
    # equal eigenvalues: turn their vectors so that one alone takes part
    close = np.diff(values) <= limit
    if close.any():
        vectors, z = vectors.copy(), z.copy()
        cuts = np.flatnonzero(~close) + 1
        for group in np.split(np.arange(len(values)), cuts):
            if len(group) > 1 and (size := float(np.sqrt(z[group] @ z[group]))) > 0:
                mirror = z[group].copy()
                mirror[-1] += np.copysign(size, mirror[-1])
                mirror /= np.sqrt(mirror @ mirror)
                vectors[:, group] -= 2 * np.outer(vectors[:, group] @ mirror, mirror)
                last = -np.copysign(size, z[group[-1]])
                z[group] = 0
                z[group[-1]] = last
    part = np.flatnonzero(rho * np.abs(z) > limit)
    if not len(part):
        return values, vectors
    d, w = values[part], z[part]
    if len(part) == 1:
        found, turned = d + rho * w * w, np.ones((1, 1))
    else:
        origin, x = _roots(d, w * w, rho)
        far = (d - d[origin][:, None]) - x[:, None]  # far[i, j] = d_j - root_i
        apart = d[:, None] - d  # apart[i, j] = d_i - d_j
        np.fill_diagonal(apart, 1.0)
        exact = np.copysign(np.sqrt(np.abs(np.prod(-far / apart, axis=0))), w)
        turned = (exact / far).T
        turned /= np.sqrt((turned * turned).sum(0))
        found = d[origin] + x
    values, vectors = values.copy(), vectors.copy()
    values[part] = found
    vectors[:, part] = vectors[:, part] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, and the eigendecomposition of the scatter of some vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims, np.int64), np.zeros(dims), np.eye(dims))

    def add(self, x: np.ndarray) -> None:
        if self.n:
            self._change(self.n / (self.n + 1), x - self.sums / self.n)
        self.n += 1
        self.sums = self.sums + x

    def merge(self, other: Spectrum) -> None:
        """Takes in another spectrum by a rank-one update for each of its eigenvectors."""
        if not other.n:
            return
        least = EPS * max(float(other.values.max()), 0.0)
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > least:
                self._change(float(value), vector)
        if self.n:
            self._change(self.n * other.n / (self.n + other.n), other.sums / other.n - self.sums / self.n)
        self.n += other.n
        self.sums = self.sums + other.sums

    def _change(self, rho: float, y: np.ndarray) -> None:
        self.values, self.vectors = update(self.values, self.vectors, rho, y)

    def row(self, part: int) -> pa.RecordBatch:
        columns = [self.n], [self.sums.tolist()], [self.values.tobytes()], [self.vectors.tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), *(pa.array(c, k) for c, k in zip(columns, SPECTRUM_KINDS, strict=True))],
            names=["part", "n", "sums", "vals", "vecs"],
        )

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        values = np.frombuffer(row["vals"]).copy()
        vectors = np.frombuffer(row["vecs"]).reshape(len(values), -1).copy()
        return cls(row["n"], np.array(row["sums"], np.int64), values, vectors)


SPECTRUM_KINDS = pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()
SPECTRUM_DDL = "part long, n long, sums array<long>, vals binary, vecs binary"


# ---- jobs


def is_finite(vector: Column) -> Column:
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, entry)


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def _matrix(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def _in_a_tree(rows: DataFrame, ddl: str, combine, name: str) -> dict | None:
    """The one row that is left when MERGED rows (`part`, ...) at a time are combined."""
    while True:
        found = rows.limit(2).collect()
        if len(found) < 2:
            return found[0].asDict() if found else None
        groups = -(-rows.count() // MERGED)
        numbered = rows.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(groups)))

        def joined(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([combine(table.to_pylist())])

        rows = kept(numbered.groupBy("part").applyInArrow(joined, ddl), name)


def spectrum(vectors: DataFrame, dims: int) -> Spectrum:
    """The spectrum of all rows `x`, by partitions and then in a tree."""

    def fold(batches):
        own, part = Spectrum.empty(dims), None
        for batch in batches:
            part = batch.column("part")[0].as_py() if part is None and batch.num_rows else part
            for x in _matrix(batch, "x", dims):
                own.add(x)
        if part is not None:
            yield own.row(part)

    def combine(rows: list[dict]) -> pa.RecordBatch:
        first, *others = sorted(map(Spectrum.of, rows), key=lambda s: -s.n)
        for other in others:
            first.merge(other)
        return first.row(rows[0]["part"])

    parts = vectors.select("x", F.spark_partition_id().cast("long").alias("part"))
    row = _in_a_tree(kept(parts.mapInArrow(fold, SPECTRUM_DDL), "spectra"), SPECTRUM_DDL, combine, "spectra")
    return Spectrum.of(row) if row else Spectrum.empty(dims)


def _products(vectors: DataFrame, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums, and sums of products, of all centred vectors projected on a basis."""
    dims, k = basis.shape
    ddl = "part long, total binary, products binary"

    def row(part: int, total: np.ndarray, products: np.ndarray) -> pa.RecordBatch:
        values = pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(list(values), names=["part", "total", "products"])

    def project(batches):
        total, products, part = np.zeros(k), np.zeros((k, k)), None
        for batch in batches:
            part = batch.column("part")[0].as_py() if part is None and batch.num_rows else part
            p = (_matrix(batch, "x", dims) - mean) @ basis
            total += p.sum(0)
            products += p.T @ p
        if part is not None:
            yield row(part, total, products)

    def combine(rows: list[dict]) -> pa.RecordBatch:
        total = sum(np.frombuffer(r["total"]) for r in rows)
        products = sum(np.frombuffer(r["products"]) for r in rows)
        return row(rows[0]["part"], total, products)

    parts = vectors.select("x", F.spark_partition_id().cast("long").alias("part"))
    found = _in_a_tree(kept(parts.mapInArrow(project, ddl), "products"), ddl, combine, "products")
    if found is None:
        return np.zeros(k), np.zeros((k, k))
    return np.frombuffer(found["total"]).copy(), np.frombuffer(found["products"]).reshape(k, k).copy()


@dataclass
class Whitening:
    """n, sums: of the fitted vectors. components: unit eigenvectors as columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fitted_vectors(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The distinct integer vectors `x` (a kept table) of the most frequent length, and that length."""
    x = vectors.where(is_finite(F.col(column))).select(integers(F.col(column)).alias("x"))
    distinct = kept(x.distinct(), "vectors")
    sizes = vectors.where(is_finite(F.col(column))).groupBy(F.size(column).alias("dims")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("dims")).first()
    dims = most.dims if most else 0
    return distinct.where(F.size("x") == dims), dims


def fit(vectors: DataFrame, column: str, components: int = COMPONENTS) -> Whitening:
    rows, dims = fitted_vectors(vectors, column)
    found = spectrum(rows, dims) if dims else Spectrum.empty(0)
    if not found.n or not dims:
        return Whitening(0, [0] * dims, np.zeros((dims, 0)), np.zeros(0), 0.0, 0.0)
    sums = found.sums.tolist()
    mean = np.array([s / found.n for s in sums])
    basis, _ = np.linalg.qr(found.vectors)  # orthogonal to the last bit before it is used as such
    total, products = _products(rows, mean, basis)
    covariance = products / found.n - np.outer(total, total) / found.n**2
    values, turned = np.linalg.eigh((covariance + covariance.T) / 2)
    values, chosen = values[::-1], (basis @ turned)[:, ::-1]
    trace = float(values.sum())
    k = int((values[:components] > dims * EPS * max(float(values[0]), 0.0)).sum())
    chosen = chosen[:, :k] / np.linalg.norm(chosen[:, :k], axis=0)
    chosen = chosen * np.where(chosen[np.abs(chosen).argmax(0), range(k)] < 0, -1.0, 1.0)
    model = Whitening(found.n, sums, chosen, values[:k].copy(), trace, 0.0)
    if k:
        total, products = _products(rows, mean, chosen / np.sqrt(model.eigenvalues))
        of_whitened = products / found.n - np.outer(total, total) / found.n**2
        model.identity_error = float(np.abs(of_whitened - np.eye(k)).max())
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - sums)^2, exact; None beyond 64 bits."""
    most = max(abs(n) * int(np.abs(x).max(initial=0)), 0) + max(map(abs, sums), default=0)
    wide = most * most * max(1, x.shape[1]) >= 1 << 63
    kind = object if wide else np.int64
    apart = x.astype(kind) * n - np.array(sums, kind)
    return [v if v < 1 << 63 else None for v in (apart * apart).sum(1).tolist()]


def transform(vectors: DataFrame, model: Whitening, column: str) -> DataFrame:
    """The rows that have a vector, with `whitened` (array of double) and `deviation`; these replace columns so named."""
    shared = vectors.sparkSession.sparkContext.broadcast((model, model.mean if model.n else None))
    dims = len(model.sums)
    kind = [("whitened", pa.list_(pa.float64())), ("deviation", pa.int64())]

    @F.arrow_udf("struct<whitened:array<double>,deviation:bigint>")
    def place(x: pa.Array) -> pa.Array:
        fitted, mean = shared.value
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), dims)
        white = (rows - mean) @ (fitted.components / np.sqrt(fitted.eigenvalues))
        columns = [pa.array(list(white), kind[0][1]), pa.array(deviations(rows, fitted.n, fitted.sums), kind[1][1])]
        return pa.StructArray.from_arrays(columns, [name for name, _ in kind])

    names = [name for name, _ in kind]
    whole = vectors.where(is_finite(F.col(column)) & (F.size(column) == dims) & F.lit(model.n > 0))
    placed = whole.withColumn("__placed", place(integers(F.col(column))))
    own = [F.col(c) for c in vectors.columns if c not in names]
    return placed.select(*own, *[F.col(f"__placed.{n}").alias(n) for n in names])
