"""Embedding whitening by matrix-free block Lanczos.

The covariance V is never formed. Each step multiplies a small block of directions by it in one distributed pass over
the fit list: a task centres its vectors, and adds up X'(X B) for its part. The driver holds the directions so far and
their images, reorthogonalises each new block twice against all of them, puts random directions in place of those that
break down, and stops by the residuals of the leading Ritz pairs, at the latest when the directions span the space,
where the pairs are exact.

Sums of the integer vectors and their deviations are exact; the trace is the sum of the deviations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, discard, stored, table

#: Components, and directions in a block beyond them.
COMPONENTS, EXTRA = 4, 4
#: Residual, as a share of the largest eigenvalue, at which a pair has converged; below the second, one that stays.
TOLERANCE, STALE = 1e-14, 1e-12
#: Share of the largest eigenvalue up to which one counts as zero.
ZERO = 1e-13
#: Levels of an entry: 256 to one.
LEVELS = 256
SEED = 11


@dataclass(frozen=True)
class Fit:
    """What whitening needs of a fit list of vectors of one length: number, sums, eigenpairs, trace and the check's result."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float | None


def quantised(vectors: DataFrame, keep: list[str]) -> DataFrame:
    """keep and x, the entries in LEVELS to one rounded down, of the rows whose vector is there and wholly finite."""
    entries = F.col("embedding").cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(*keep, F.transform(entries, lambda c: F.floor(c * F.lit(float(LEVELS)))).alias("x"))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal-length lists of longs as one array."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def totals(fit: DataFrame, function, kind: str) -> dict[int, object]:
    """Sums by place over the tasks' results: function(batch's vectors) gives a flat array, of the same length in each task."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = function(batch.column("x"))
                total = part if total is None else total + part
        if total is not None:
            values = pa.array(total.tolist(), pa.decimal128(38) if kind == "decimal(38,0)" else pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], ["place", "value"])

    rows = arrow_map(fit.select("x"), run, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value"))
    return {r["place"]: r["value"] for r in rows.collect()}


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """x in a type that holds sums up to `most` times its largest entry."""
    return x if not x.size or int(np.abs(x.astype(np.float64)).max()) * most < 1 << 62 else x.astype(object)


def orthonormal(block: np.ndarray, basis: np.ndarray, width: int, rng) -> np.ndarray:
    """`width` orthonormal directions, orthogonal to the basis, that span the block; random ones replace what breaks down."""
    scale, found = np.linalg.norm(block, axis=0).max(initial=0.0), np.empty((len(basis), 0))
    for _ in range(20):
        held = np.hstack([basis, found])
        for _ in range(2):
            block = block - held @ (held.T @ block)
        if block.size and scale > 0:
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            u = u[:, s > 1e-10 * scale]
            u -= held @ (held.T @ u)
            found = np.hstack([found, np.linalg.qr(u)[0]])[:, :width]
        if found.shape[1] == width:
            return found
        block, scale = rng.standard_normal((len(basis), width - found.shape[1])), 1.0
    raise RuntimeError("no further orthogonal directions found")


def block_lanczos(product, dim: int, k: int, extra: int = EXTRA, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues, unit eigenvectors and residuals of the symmetric matrix behind product(block), and the passes.

    A block has `extra` directions more than k, so an eigenvalue may be k-fold.
    """
    rng, k = np.random.default_rng(seed), min(k, dim)
    basis, images, passes, before = np.empty((dim, 0)), np.empty((dim, 0)), 0, np.inf
    block = orthonormal(rng.standard_normal((dim, min(dim, k + extra))), basis, min(dim, k + extra), rng)
    while True:
        image = product(block)
        basis, images, passes = np.hstack([basis, block]), np.hstack([images, image]), passes + 1
        projected = basis.T @ images
        values, mix = np.linalg.eigh((projected + projected.T) / 2)
        values, mix = values[::-1][:k], mix[:, ::-1][:, :k]
        vectors = basis @ mix
        left = np.linalg.norm(images @ mix - vectors * values, axis=0)
        worst, scale = left.max(initial=0.0), max(np.abs(values).max(initial=0.0), 1e-300)
        if basis.shape[1] == dim or worst <= TOLERANCE * scale or (worst <= STALE * scale and worst > before / 2):
            vectors = vectors / np.linalg.norm(vectors, axis=0)
            top = np.abs(vectors).argmax(axis=0)
            return values, vectors * np.where(vectors[top, range(k)] < 0, -1.0, 1.0), left, passes
        before = worst
        block = orthonormal(image, basis, min(block.shape[1], dim - basis.shape[1]), rng)


def projected(x: np.ndarray, n: int, sums: tuple[int, ...], values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Vectors, centred, on the components, over the root of each one's eigenvalue."""
    return (x - np.array([s / n for s in sums])) @ vectors / np.sqrt(values)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """sum((n * x - S) ** 2) for each vector, as exact integers: n * n * x.x - 2 * n * x.S + S.S."""
    largest = max(map(abs, sums), default=0)
    squares = (exact(x, (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) * len(sums)) ** 2).sum(axis=1)
    wide = exact(x, (largest + 1) * len(sums))
    cross = wide @ np.array(sums, dtype=object if wide.dtype == object or largest >= 1 << 62 else np.int64)
    return n * n * squares.astype(object) - 2 * n * cross.astype(object) + sum(s * s for s in sums)


def fitted(fit: DataFrame, dim: int, k: int) -> Fit:
    """The fit of the distinct vectors in fit(x), all of length dim."""
    sums = totals(fit, lambda x: np.append(exact(matrix(x, dim), len(x)).sum(axis=0).astype(object), len(x)), "decimal(38,0)")
    n, sums = int(sums[dim]), tuple(int(sums[i]) for i in range(dim))
    mean = np.array([s / n for s in sums])

    def product(block: np.ndarray) -> np.ndarray:
        def part(x):
            centred = matrix(x, dim) - mean
            return (centred.T @ (centred @ block)).ravel()

        flat = totals(fit, part, "double")
        return np.array([flat[i] for i in range(block.size)]).reshape(block.shape) / n

    values, vectors, _, _ = block_lanczos(product, dim, k)
    live = int((values > ZERO * max(values[0], 0)).sum()) if len(values) else 0
    on, lead = vectors[:, :live], values[:live]

    def check(x):
        w = projected(matrix(x, dim), n, sums, lead, on)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel(), [float(deviations(matrix(x, dim), n, sums).sum())]])

    flat = totals(fit, check, "double")
    flat = np.array([flat[i] for i in range(len(flat))])
    middle = flat[:live] / n
    covariance = flat[live:-1].reshape(live, live) / n - np.outer(middle, middle)
    return Fit(n, sums, values, vectors, flat[-1] / n / n / n, float(np.abs(covariance - np.eye(live)).max()) if live else None)


def whitened(rows: DataFrame, fit: Fit, dim: int) -> DataFrame:
    """Component rows of rows(vec_id, x) whose vectors have length dim."""
    kept = [c for c in rows.columns if c != "x"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "x")
    k = len(fit.values)
    live = fit.values > ZERO * max(fit.values[0], 0)
    shares = [float(max(v, 0.0) / fit.trace) if fit.trace > 0 else None for v in fit.values]

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            w = np.full((len(x), k), np.nan)
            w[:, live] = projected(x, fit.n, fit.sums, fit.values[live], fit.vectors[:, live])
            at, size = pa.array(np.repeat(np.arange(len(x)), k)), len(x) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in kept]
                + [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, fit.n)), pa.array(deviations(x, fit.n, fit.sums).tolist(), pa.decimal128(38)).take(at),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(shares * len(x), pa.float64()), pa.array([fit.error] * size, pa.float64()),
                ],
                [*kept, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return arrow_map(rows, run, f"{schema}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def lanczos_whitening(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """A row for each component up to k of each sound row of vectors(vec_id, embedding): vec_id, component, n, deviation,
    whitened, explained, identity_error.

    Rows go whose vector is null or holds null or non-finite entries. Entries become whole numbers of 1 / LEVELS, rounded
    down (those beyond a long, its nearest). Each distinct vector counts once in the fit, however many rows hold it, and each row
    gets its own results; repeated rows get equal ones. Ids play no part and may be null; other columns are ignored. Vectors
    of other lengths are a fit of their own, with as many components as they have entries; empty ones have none. A
    component without variance has null in `whitened`, and `explained` and `identity_error` are null where no component
    has any. No vectors give no rows. deviation is decimal(38,0).
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, ["vec_id"])
    distinct = stored(rows.select("x").distinct())
    done = None
    for dim in sorted(r[0] for r in distinct.select(F.size("x")).distinct().collect()):
        if dim:
            same = F.size("x") == dim
            part = whitened(rows.filter(same), fitted(distinct.filter(same), dim, k), dim)
            done = part if done is None else done.unionAll(part)
    discard(distinct)
    if done is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return done


def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation (null beyond a long), whitened, explained, identity_error of every sound vector."""
    out = lanczos_whitening(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
