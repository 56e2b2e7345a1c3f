"""Embedding whitening by a distributed Jacobi-Davidson eigensolver.

Vectors are scaled to integers, x = floor(256 * c), and every distinct one counts once.  Their covariance is
never formed: Spark multiplies it to a block of vectors at a time, V u = sum((x - m) ((x - m) . u)) / n, with one
matrix product and one row, its sum, per task.

The solver follows Sleijpen and van der Vorst (1996), for all wanted pairs side by side so that they share their
passes over the data.  A round takes Ritz pairs of the subspace (Rayleigh-Ritz), locks the leading ones whose
residuals are at double precision, solves the others' projected correction equations by a few steps of MINRES,
and adds the solutions to the subspace; a full subspace is cut to its leading Ritz vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

#: Residuals, as a share of the largest eigenvalue, that are double precision: what rounding of the products leaves.
TOLERANCE = 2.0**-44
#: Pairs beyond the wanted ones that are followed, and their tolerance: a larger pair that is overlooked would show among them.
GUARDS, GUARD_TOLERANCE = 2, 1e-6
#: Vectors of a full subspace, those that stay when it is cut, steps of MINRES in a round, and rounds.
SUBSPACE, KEPT, INNER, ROUNDS = 40, 12, 12, 200
#: Tasks that add up what tasks over the data have summed.
ADDERS = 8
EPS = np.finfo(float).eps

Product = Callable[[np.ndarray], np.ndarray]


def minres(apply: Product, rhs: np.ndarray, steps: int, reduction: float = 1e-3) -> np.ndarray:
    """Solutions of apply(x) = rhs for each column, by the recurrences of Paige and Saunders (1975).

    A column is done when its residual has shrunk by reduction; all go on until the last is, or for so many steps.
    """
    norm = lambda a: np.sqrt((a * a).sum(axis=0))
    beta = norm(rhs)
    x, w, w_old = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    r_old, r = rhs.copy(), rhs.copy()
    first = beta.copy()
    beta_old, d_bar, eps_n, phi_bar = np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), beta.copy()
    cs, sn = -np.ones_like(beta), np.zeros_like(beta)
    live = beta > 0
    for k in range(steps):
        if not live.any():
            break
        v = r / np.where(beta > 0, beta, 1)
        y = apply(v)
        if k:
            y = y - r_old * (beta / beta_old)
        alpha = (v * y).sum(axis=0)
        y = y - r * (alpha / np.where(beta > 0, beta, 1))
        r_old, r = r, y
        beta_old, beta = np.where(beta > 0, beta, 1), norm(y)
        eps_old, delta, g_bar = eps_n, cs * d_bar + sn * alpha, sn * d_bar - cs * alpha
        eps_n, d_bar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(g_bar, beta), EPS)
        cs, sn = g_bar / gamma, beta / gamma
        phi, phi_bar = cs * phi_bar, sn * phi_bar
        w_old, w = w, (v - w_old * eps_old - w * delta) / gamma
        x = np.where(live, x + w * phi, x)
        live &= (np.abs(phi_bar) > reduction * first) & (beta > EPS * first)
    return x


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The columns of new, made orthogonal to basis and to each other; those that add nothing go."""
    out = np.zeros((len(new), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(2):  # once more takes off what rounding has left
            for q in (basis, out):
                column = column - q @ (q.T @ column)
        left = np.linalg.norm(column)
        if size > 0 and left > 1e-10 * size:
            out = np.column_stack([out, column / left])
    return out


@dataclass
class Pairs:
    """Eigenvalues, falling, their unit vectors as columns, residual norms, and products that were taken."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def jacobi_davidson(product: Product, size: int, wanted: int, seed: int = 42) -> Pairs:
    """The `wanted` largest eigenpairs of a symmetric positive matrix of that size, known by product(block) only.

    Raises ArithmeticError where ROUNDS rounds don't bring all residuals to TOLERANCE.
    """
    taken = 0

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal taken
        taken += 1
        return product(block)

    wanted = min(wanted, size)
    followed = min(size, wanted + GUARDS)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((size, min(size, followed + 2))), np.zeros((size, 0)))
    image = times(basis)
    locked = 0
    for _ in range(ROUNDS):
        small = basis.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, ritz_image = basis @ s, image @ s
        scale = max(abs(theta[0]), np.finfo(float).tiny)
        residual = ritz_image[:, :followed] - ritz[:, :followed] * theta[:followed]
        norms = np.sqrt((residual**2).sum(axis=0))
        small_enough = norms <= scale * np.where(np.arange(followed) < wanted, TOLERANCE, GUARD_TOLERANCE)
        # leading pairs are locked in order: they stay in the subspace, get no more corrections, and are projected out
        locked = int(np.argmin(small_enough)) if not small_enough.all() else followed
        if locked == followed:
            return Pairs(theta[:wanted], ritz[:, :wanted], norms[:wanted], taken)
        if basis.shape[1] + followed > max(SUBSPACE, 2 * followed) and basis.shape[1] < size:
            basis, image = ritz[:, :max(KEPT, followed)], ritz_image[:, :max(KEPT, followed)]
        open_ = np.flatnonzero(~small_enough)
        q, shift = ritz[:, :followed], theta[open_]
        away = lambda t, q=q: t - q @ (q.T @ t)
        correction = minres(lambda t, shift=shift: away(times(away(t)) - away(t) * shift), -away(residual[:, open_]), INNER)
        new = _orthonormal(np.column_stack([correction, residual[:, open_]]), basis)[:, : max(0, size - basis.shape[1])]
        if not new.shape[1]:
            new = _orthonormal(np.eye(size), basis)[:, :followed]
        if not new.shape[1]:
            # the subspace is the whole space: its image is taken anew, and what is left is rounding
            basis, image = ritz, times(ritz)
            continue
        basis, image = np.column_stack([basis, new]), np.column_stack([image, times(new)])
    raise ArithmeticError(f"residuals {norms[:wanted] / scale} after {ROUNDS} rounds")


# ---------------------------------------------------------------- over tables


def _finite(vector: Column) -> Column:
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(ok(c.cast("double")), F.lit(False)))


def scaled(table: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key and x, an array of longs, of the rows whose vector has an entry at least and finite entries only."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * 256))
    return table.where(_finite(F.col(vector)) & (F.size(vector) > 0)).select(key, x.alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _plus(parts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """The sum of parts, if there are any."""
    total = None
    for part in parts:
        total = part if total is None else total + part
    if total is not None:
        yield total


def _summed(fit: DataFrame, size: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(rows of x), a matrix of that width, over all of fit (x): a row per task, summed in ADDERS tasks."""

    def added(sums: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for total in sums:
            yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], ["v"])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from added(_plus(part(_matrix(b.column(0), size).astype(float)) for b in batches if b.num_rows))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from added(_plus(np.array(v) for b in batches for v in b.column(0).to_pylist()))

    sums = mapped(mapped(fit.select("x"), sum_up, "v array<double>").repartition(ADDERS), add, "v array<double>").collect()
    return next(_plus(np.array(r["v"]) for r in sums)).reshape(-1, width)


@dataclass
class Whitening:
    """What whiten() takes from the fit list: its size, sums, and components (unit vectors as columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    residuals: np.ndarray
    products: int

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e); 0 where e is nothing but rounding."""
        real = self.values > self.trace * EPS * 64
        return np.where(real, 1 / np.sqrt(np.where(real, self.values, 1)), 0.0)


def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """Components of the distinct x of vectors (x, all of one size); None without rows."""
    rows = written(vectors.select("x").distinct(), "whitening-fit")
    head = rows.select(F.size("x").alias("d"), F.col("x")).first()
    if head is None:
        return None
    size = head["d"]
    at = rows.select(F.posexplode("x")).groupBy("pos").agg(F.count("*").alias("n"), F.sum("col").alias("s")).collect()
    n, sums = at[0]["n"], [r["s"] for r in sorted(at, key=lambda r: r["pos"])]
    mean = np.array([s / n for s in sums])  # exact integers, divided once

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            x -= mean
            return x.T @ (x @ block)

        return _summed(rows, size, block.shape[1], part) / n

    trace = float(_summed(rows, size, 1, lambda x: ((x - mean) ** 2).sum().reshape(1, 1))[0, 0]) / n
    found = jacobi_davidson(product, size, components)
    out = Whitening(n, sums, found.values, found.vectors, trace, 0.0, found.residuals, found.products)

    def spread(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ out.vectors * out.scales
        return np.column_stack([z.T @ z, z.sum(axis=0)])

    k = len(found.values)
    both = _summed(rows, size, k + 1, spread) / n
    covariance = both[:, :k] - np.outer(both[:, k], both[:, k])
    real = out.scales > 0
    if real.any():
        out.identity_error = float(np.abs(covariance - np.eye(k))[np.ix_(real, real)].max())
    return out


def one_size(vectors: DataFrame) -> DataFrame:
    """vectors (x) of the commonest size, the larger of equally common ones."""
    most = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return vectors.where(F.size("x") == most["d"]) if most else vectors


def whiten(table: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 4) -> DataFrame:
    """A row per kept row of table and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows go whose vector is null, empty, or holds null or non-finite entries, and those of another size than the commonest
    one.  Kept rows with the same vector, or a null or repeated key, each have their rows.  A component whose eigenvalue
    is zero but for rounding has 0 for whitened, and identity_error is over the others.  deviation is exact, and null where it
    exceeds a long.  Fewer sizes than components give fewer components, no rows none.  Other columns are not read.
    """
    kept = written(one_size(scaled(table, vector, key)), "whitening-rows")
    kind = kept.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(kept, components)
    if model is None:
        return kept.sparkSession.createDataFrame([], schema)
    n, sums, size = model.n, np.array(model.sums, dtype=object), len(model.sums)
    mean, k = np.array([s / n for s in model.sums]), len(model.values)
    matrix, explained = model.vectors * model.scales, model.values / model.trace if model.trace > 0 else np.zeros(k)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size)
            most = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) * n + max(map(abs, model.sums))
            if most * most * size < 1 << 63:
                off = x * n - sums.astype(np.int64)
                deviation = pa.array((off * off).sum(axis=1))
            else:
                exact = ((x.astype(object) * n - sums) ** 2).sum(axis=1)
                deviation = pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())
            z = (x - mean) @ matrix
            row, repeated = np.repeat(np.arange(len(x)), k), np.tile(np.arange(k), len(x))
            columns = [
                batch.column(0).take(pa.array(row)), pa.array((repeated + 1).astype(np.int32)), pa.array(np.full(len(row), n)), deviation.take(pa.array(row)),
                pa.array(z.reshape(-1)), pa.array(explained[repeated]), pa.array(np.full(len(row), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return mapped(kept.select(key, "x"), task, schema)
