"""Whitening of embeddings by a block Jacobi-Davidson method.

Entries become whole numbers, so sums per dimension are exact.  The covariance is
never formed: a product with some directions is a pass over all vectors, in which
every task centres its rows ((n x - S) / n, rounded once), multiplies, and adds up.

The largest eigenvalues come from a growing subspace (Rayleigh-Ritz).  Each pair that
has not converged asks for a correction from its projected equation
(I - QQ')(V - theta I)(I - QQ') t = -r, solved roughly by a few steps of MINRES; the
steps of all pairs share their products, so a step is one job.  Pairs whose residual
has reached double precision are locked, and the search ends when all are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from screenspark.llm.batches import map_batches
from screenspark.llm.pivot_dedup import matrix
from screenspark.plans.staging import discard, stage

#: Entries c become floor(SCALE c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries whose whole number would be larger than this count as not finite.
LARGEST = 2**52
#: Low bits that are summed apart, so that sums of longs stay exact.
LOW_BITS = 22
#: Rows of one packed block.
BLOCK_ROWS = 4096
EPS = np.finfo(np.float64).eps


def fitting() -> Column:
    """Vectors that have an entry, only finite ones, and none too large for a whole number."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / SCALE))
    return F.coalesce(good & (F.size("embedding") > 0), F.lit(False))


def whole(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as whole numbers."""
    return np.floor(SCALE * matrix(column).astype(np.float64)).astype(np.int64) + SHIFT


def packed(vectors: DataFrame) -> DataFrame:
    """``rows, x``: blocks of whole numbers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                x = whole(b.column("embedding").slice(at, BLOCK_ROWS))
                yield {"rows": [len(x)], "x": [x.tobytes()]}

    return map_batches(vectors.select("embedding"), run, StructType([StructField("rows", LongType()), StructField("x", BinaryType())]))


def summed(blocks: DataFrame, d: int, fn: Callable[[np.ndarray], np.ndarray], kind=DoubleType) -> np.ndarray:
    """The sum of ``fn`` (an array of fixed size) over all blocks; tasks add up their own, and places are summed apart."""
    schema = StructType([StructField("part", ArrayType(kind()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = None
        for b in batches:
            for x in b.column("x"):
                part = fn(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, d))
                total = part if total is None else total + part
        if total is not None:
            yield {"part": [total]}

    rows = map_batches(blocks.select("x"), run, schema).select(F.posexplode("part").alias("place", "v")).groupBy("place").agg(F.sum("v")).collect()
    out = np.zeros(len(rows), np.int64 if kind is LongType else np.float64)
    for place, v in rows:
        out[place] = v
    return out


class Fit:
    """Exact sums of the fit list; centres rows."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.sums = n, sums
        self.small = n * largest * 2 < 2**62
        self.shift = np.array(sums, np.int64 if self.small else object)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        return x * self.n - self.shift if self.small else x.astype(object) * self.n - self.shift

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2; None beyond a long."""
        y = self.scaled(x)
        if self.small and float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2**62:
            return (y * y).sum(axis=1).tolist()
        exact = [sum(int(v) * int(v) for v in row) for row in y]
        return [v if v < 2**63 else None for v in exact]


def orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthonormal, and orthogonal to ``basis``; what adds nothing is dropped."""
    out = basis
    for v in new.T:
        size = np.linalg.norm(v)
        if not size or not np.isfinite(size):
            continue
        v = v / size
        for _ in range(3):
            v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        if left >= 1e-10:
            out = np.concatenate([out, v[:, None]], axis=1)
    return out[:, basis.shape[1] :]


def minres(product: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, rhs: np.ndarray, project: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    """Rough solutions t of P (V - shift) P t = rhs for every column, by ``steps`` of MINRES; a step takes one product for all.

    Lanczos vectors of a column span its search space; the least residual over it is
    that of a small least-squares problem with the tridiagonal matrix.
    """
    count = rhs.shape[1]
    beta = np.linalg.norm(rhs, axis=0)
    basis = [rhs / np.where(beta > 0, beta, 1)]
    alphas, betas = [], []
    for step in range(steps):
        v = basis[-1]
        w = project(product(v) - v * shifts)
        if step:
            w = w - basis[-2] * betas[-1]
        a = (v * w).sum(axis=0)
        w = w - v * a
        for u in basis:  # full orthogonality, as steps are few
            w = w - u * (u * w).sum(axis=0)
        w = project(w)
        b = np.linalg.norm(w, axis=0)
        alphas.append(a)
        betas.append(b)
        basis.append(w / np.where(b > 0, b, 1))
    out = np.zeros_like(rhs)
    for c in range(count):
        usable = next((s + 1 for s in range(steps) if betas[s][c] <= EPS * max(1.0, abs(alphas[s][c]))), steps)
        t = np.zeros((usable + 1, usable))
        for s in range(usable):
            t[s, s] = alphas[s][c]
            t[s + 1, s] = betas[s][c]
            if s:
                t[s - 1, s] = betas[s - 1][c]
        e = np.zeros(usable + 1)
        e[0] = beta[c]
        y = np.linalg.lstsq(t, e, rcond=None)[0]
        out[:, c] = sum(basis[s][:, c] * y[s] for s in range(usable))
    return out


def largest_eigenpairs(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, inner: int = 3, most: int | None = None, outer: int = 200, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix given by its products.

    A pair is locked once its residual is at most a few roundings of a product
    (4 sqrt(d) eps of the largest eigenvalue).  Without an answer after ``outer``
    rounds an error is raised.
    """
    wanted = min(wanted, d)
    most = min(d, most or max(8 * wanted, 40))
    basis = orthonormal(np.random.default_rng(seed).normal(size=(d, min(d, 2 * wanted))), np.zeros((d, 0)))
    image = product(basis)
    for _ in range(outer):
        h = basis.T @ image
        values, turns = np.linalg.eigh((h + h.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz, ritz_image = basis @ turns[:, :wanted], image @ turns[:, :wanted]
        residual = ritz_image - ritz * values[:wanted]
        size = np.linalg.norm(residual, axis=0)
        open_pairs = np.flatnonzero(size > 4 * math.sqrt(d) * EPS * max(values[0], 0.0))
        if not len(open_pairs) or basis.shape[1] == d:
            signs = np.sign(ritz[np.abs(ritz).argmax(axis=0), np.arange(wanted)])
            return values[:wanted], ritz * np.where(signs < 0, -1.0, 1.0)
        # Locked pairs and the open ones themselves are projected out of every correction.
        project = lambda t, q=ritz: t - q @ (q.T @ t)
        rhs = project(-residual[:, open_pairs])
        fixes = minres(product, values[open_pairs], rhs, project, inner)
        if basis.shape[1] + len(open_pairs) > most and most < d:  # restart from the best of the subspace
            keep = min(2 * wanted, basis.shape[1])
            basis, image = basis @ turns[:, :keep], image @ turns[:, :keep]
        new = orthonormal(fixes, basis)
        if not new.shape[1]:
            new = orthonormal(np.random.default_rng(seed + 1).normal(size=(d, 1)), basis)
        new = new[:, : d - basis.shape[1]]
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, product(new)], axis=1)
    raise ArithmeticError(f"no convergence: residuals {size.tolist()} beside {values[0]}")


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable vector and component.

    ``vectors`` has vec_id and embedding.  Vectors that are null, empty, or hold null
    or non-finite entries (or such beyond LARGEST) are dropped.  Vectors of one length
    are a fit list of their own.  Repeated rows count each, a null id is kept.  A
    component whose eigenvalue is zero (to rounding of the trace) has no whitened
    value and is left out, so equal vectors give no rows, and neither does an empty
    table.  ``deviation`` is null where it is beyond a long.  Other columns are not read.
    """
    good = vectors.select("vec_id", "embedding").filter(fitting())
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = vectors.sparkSession.createDataFrame([], schema)
    lengths = [r[0] for r in good.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    for d in lengths:
        some = whiten_length(good.filter(F.size("embedding") == d), d, components)
        out = some if len(lengths) == 1 else out.unionByName(some)
    return out


def whiten_length(vectors: DataFrame, d: int, components: int) -> DataFrame:
    blocks = stage(packed(vectors), "blocks")
    low = (1 << LOW_BITS) - 1
    n = blocks.agg(F.sum("rows")).first()[0]
    largest = blocks_largest(blocks, d)
    parts = summed(blocks, d, lambda x: np.concatenate([(x >> LOW_BITS).sum(axis=0), (x & low).sum(axis=0)]), LongType)
    fit = Fit(n, [(int(h) << LOW_BITS) + int(v) for h, v in zip(parts[:d], parts[d:], strict=True)], largest)

    def product(directions: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            c = fit.centred(x)
            return (c.T @ (c @ directions)).ravel()

        return summed(blocks, d, of).reshape(d, -1) / n

    trace = float(summed(blocks, d, lambda x: np.array([(fit.centred(x) ** 2).sum()]))[0]) / n
    values, axes = largest_eigenpairs(product, d, components) if trace else (np.zeros(0), np.zeros((d, 0)))
    kept = values > d * EPS * trace
    values, axes = values[kept], axes[:, kept]
    turn = axes / np.sqrt(values)
    k = len(values)
    mean = summed(blocks, d, lambda x: (fit.centred(x) @ turn).sum(axis=0)) / n if k else np.zeros(0)

    def spread(x: np.ndarray) -> np.ndarray:
        w = fit.centred(x) @ turn - mean
        return (w.T @ w).ravel()

    error = float(np.abs(summed(blocks, d, spread).reshape(k, k) / n - np.eye(k)).max()) if k else 0.0
    discard(blocks)
    schema = StructType([StructField("vec_id", LongType()), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), *(StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BLOCK_ROWS):
                b = whole_batch.slice(at, BLOCK_ROWS)
                x = whole(b.column("embedding"))
                m = len(x)
                if m and k:
                    rows = pa.array(np.repeat(np.arange(m), k))
                    yield {
                        "vec_id": b.column("vec_id").take(rows), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": np.full(m * k, n),
                        "deviation": pa.array(fit.deviations(x), pa.int64()).take(rows), "whitened": (fit.centred(x) @ turn).ravel(),
                        "explained": np.tile(values / trace, m), "identity_error": np.full(m * k, error),
                    }

    return map_batches(vectors, run, schema)


def blocks_largest(blocks: DataFrame, d: int) -> int:
    """The largest size of a whole number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for x in b.column("x"):
                yield {"most": [int(np.abs(np.frombuffer(x.as_buffer(), np.int64)).max(initial=0))]}

    return map_batches(blocks.select("x"), run, StructType([StructField("most", LongType())])).agg(F.max("most")).first()[0]
