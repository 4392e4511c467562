"""Whitening of embeddings: shifted CholeskyQR over the distinct centred vectors, then the singular vectors of its triangle.

A pass adds up the Gram matrix of the rows as they stand, on the tasks that read them; the driver takes its Cholesky factor,
and the next pass solves each row against the factors so far. The first factor is shifted, so that it exists for badly
conditioned rows too; the passes that follow repair what the shift and rounding left. The product of the factors is the
triangle R of the rows' QR decomposition, whose singular values and right vectors are those of the rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.frames import map_rows, written

# Fixed values of the lattice on which vectors are compared and summed exactly.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
# Entries from here on have no lattice value that fits a long; such a vector counts as not finite.
LARGEST = 2.0**55
MAX_PASSES = 12
# Singular values below this share of the largest are rounding, not a component.
RANK_SHARE = 1e-12
UNIT = np.finfo(np.float64).eps / 2
LONG = 2**63 - 1


@dataclass
class Whitening:
    """Sums and components of the fit list; ``axes`` has one unit column for each component."""

    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    passes: int
    identity_error: float = 0.0

    @property
    def dimension(self) -> int:
        return len(self.sums)


def lattice_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the vectors without null, NaN or infinite entries, ``x`` in lattice steps."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return rows.where(usable).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(OFFSET).cast("long")).alias("x"))


def common_length(rows: DataFrame) -> int | None:
    """The length of most vectors, the greater of equally frequent ones; None without rows."""
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    found = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else None


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def scaled_deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S without rounding: in longs where they suffice, in Python's whole numbers otherwise."""
    top = max(int(np.abs(x).max(initial=0)), 1)
    if n * top < LONG // 2 and max(map(abs, sums)) < LONG // 2:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, rounded once."""
    deviation = scaled_deviation(x, n, sums)
    return (deviation / n).astype(np.float64)


def solve_right(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The rows Q with Q @ upper = rows, column by column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows, and the sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        n, total = 0, np.zeros(d, dtype=object)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), d)
                n += len(x)
                fits = int(np.abs(x).max()) * len(x) < LONG
                total = total + (x.sum(axis=0).astype(object) if fits else x.astype(object).sum(axis=0))
        if n:
            yield -1, str(n)
            for j in range(d):
                yield j, str(total[j])

    sums = map_rows(fit.select("x"), partial, "slot int, v string").groupBy("slot").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v"))
    found = {r["slot"]: int(r["v"]) for r in sums.collect()}
    return found.get(-1, 0), [found.get(j, 0) for j in range(d)]


def gram(fit: DataFrame, width: int, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of r r^T over the rows ``made`` of the fit list: each task adds up its own, one aggregate adds the tasks'."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        total, seen = np.zeros((width, width)), False
        for b in batches:
            if b.num_rows:
                rows = made(b.column(0))
                total, seen = total + rows.T @ rows, True
        if seen:
            for i in range(width):
                for j in range(i, width):
                    yield i, j, float(total[i, j])

    cells = map_rows(fit.select("x"), partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((width, width))
    for r in cells:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix, shifted on request or where rounding left it without one."""
    d = len(g)
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (n * d + d * (d + 1)) * UNIT * float(np.linalg.eigvalsh(g)[-1])
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def _settled(g: np.ndarray, passes: int) -> bool:
    """The rows are orthonormal, but for directions in which they have nothing."""
    w = np.linalg.eigvalsh(g)
    return passes >= 3 and bool(np.all((np.abs(w - 1) <= 1e-12) | (w < 1e-24)))


def fit_whitening(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors of ``rows`` (``x`` of length ``d``); None where they do not vary."""
    fit = written(rows.select("x").distinct(), "whitening-fit")
    n, sums = exact_sums(fit, d)
    factors: list[np.ndarray] = []
    triangle = np.eye(d)

    def orthogonal(column: pa.Array) -> np.ndarray:
        out = centred(matrix(column, d), n, sums)
        for f in factors:
            out = solve_right(out, f)
        return out

    while n and len(factors) < MAX_PASSES:
        g = gram(fit, d, orthogonal)
        if not factors and not g.any() or _settled(g, len(factors)):
            break
        factor = _factor(g, n, shifted=not factors)
        factors = [*factors, factor]
        triangle = factor @ triangle
    if not factors:
        return None
    _, sizes, axes = np.linalg.svd(triangle)
    real = int((sizes > RANK_SHARE * sizes[0]).sum())
    kept = min(components, real)
    eigenvalues = sizes**2 / n
    model = Whitening(n, sums, axes[:kept].T.copy(), eigenvalues[:kept], eigenvalues[:kept] / eigenvalues.sum(), len(factors))

    def with_one(column: pa.Array) -> np.ndarray:
        z = whiten(matrix(column, d), model)
        return np.hstack([z, np.ones((len(z), 1))])

    moments = gram(fit, kept + 1, with_one) / n
    mean = moments[:kept, kept]
    model.identity_error = float(np.abs(moments[:kept, :kept] - np.outer(mean, mean) - np.eye(kept)).max())
    return model


def whiten(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows of lattice vectors on the components, each of variance one over the fit list."""
    return centred(x, model.n, model.sums) @ model.axes / np.sqrt(model.eigenvalues)


def whitened_rows(rows: DataFrame, model: Whitening) -> DataFrame:
    """One row for each vector and component."""
    d, kept = model.dimension, len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = matrix(b.column("x"), d)
                z, deviation = whiten(x, model), scaled_deviation(x, model.n, model.sums)
                top = int(np.abs(deviation).max())
                squares = (deviation * deviation if top * top * d < LONG else deviation.astype(object) ** 2).sum(axis=1)
                each = pa.array(np.repeat(np.arange(len(x)), kept))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("vec_id").take(each),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * kept, model.n, dtype=np.int64)),
                        pa.array([int(v) if v <= LONG else None for v in squares], pa.int64()).take(each),
                        pa.array(z.reshape(-1)),
                        pa.array(np.tile(model.explained, len(x))),
                        pa.array(np.full(len(x) * kept, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, _result(rows))


def _result(rows: DataFrame) -> str:
    kind = rows.schema["vec_id"].dataType.simpleString()
    return f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The whitened components of each usable vector, fitted on the distinct ones.

    Vectors that are null, empty, or hold a null, NaN, infinite or over-large entry (2^55 and more) are dropped, and so are
    those of another length than most. Repeated rows come back each, but count once in the fit; null identifiers stay null. Components without
    variance are not returned, so a table of equal vectors, or an empty one, gives no rows. ``deviation`` is null
    where it does not fit a long. Other columns do not matter.
    """
    rows = lattice_rows(vectors, id_col, vector_col)
    d = common_length(rows)
    model = None
    if d is not None:
        rows = rows.where(F.size("x") == d)
        model = fit_whitening(rows, d, components)
    return rows.sparkSession.createDataFrame([], _result(rows)) if model is None else whitened_rows(rows, model)
