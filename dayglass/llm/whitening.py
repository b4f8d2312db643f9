"""Embedding whitening: leading components by a block Jacobi-Davidson method.

Vectors become integers x, and their covariance V is never formed. All that is asked of
the data is its product with a few vectors: one pass in which every task centres its rows
exactly (n * x - S, an integer, over n), multiplies, and sends one small matrix. The driver
holds a subspace of a few dozen directions and what V makes of them. Rayleigh-Ritz on it
gives approximate components; each has a correction equation, projected away from all
components found and sought, which a few steps of MINRES solve. The equations advance in
step with each other, so one pass over the data serves a step of all of them. Components
whose residual has reached double precision are locked, leading ones first, until all are.

The dense algebra on the driver is of the size of the subspace, and does without the
linear-algebra library, whose threads may not survive next to forked workers.

Defined results: rows whose vector is null, or has null or non-finite entries, are left
out. Repeated rows count, and are returned, each time; null ids and ties of ids are kept.
Equal eigenvalues leave their components' directions open, but never their span. There
are as many components as dimensions at most, and directions without variance give none,
so a table of equal vectors has no rows in its result, and neither has an empty one.
Vectors of unlike length, and numbers that do not fit into 64 bits (``deviation`` grows
with the square of n), are refused. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from dayglass.llm.common import finite, floored
from dayglass.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROWS = 2_048  # rows whose products are added at a time: short sums round less
_EPS = np.finfo(float).eps

Multiply = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Effort:
    """Bounds of the search; running out of outer steps is an error."""

    inner_steps: int = 4  # of MINRES for each correction
    inner_gain: float = 1e-3  # by which MINRES need not reduce a residual further
    outer_steps: int = 300
    subspace: int = 6  # times the wanted components: directions kept before a restart
    seed: int = 0


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,jk->ik", a, b)


def symmetric_eigen(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and eigenvectors of a small symmetric matrix by Jacobi rotations."""
    a, n = (matrix + matrix.T) / 2, len(matrix)
    turned = np.eye(n)
    for _ in range(sweeps):
        off = np.abs(a - np.diag(np.diag(a)))
        if off.max(initial=0.0) <= _EPS * _EPS * np.abs(a).max(initial=0.0):
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                # negligible beside both of its diagonal entries
                if abs(a[p, q]) <= _EPS * _EPS * (abs(a[p, p]) + abs(a[q, q])):
                    a[p, q] = a[q, p] = 0.0
                    continue
                ratio = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.copysign(1.0, ratio) / (abs(ratio) + np.hypot(1.0, ratio))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                rows = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[q] = rows
                columns = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
                a[:, p], a[:, q] = columns
                a[p, q] = a[q, p] = 0.0
                axes = c * turned[:, p] - s * turned[:, q], s * turned[:, p] + c * turned[:, q]
                turned[:, p], turned[:, q] = axes
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], turned[:, order]


def _away(vectors: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Vectors without their part in an orthonormal basis; twice, so that rounding leaves none."""
    for _ in range(2):
        vectors = vectors - _dot(basis, _dot(basis.T, vectors))
    return vectors


def _new_directions(vectors: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal directions that the vectors add to a basis; those that add nothing are left out."""
    kept = np.empty((len(vectors), 0))
    for v in vectors.T:
        size = np.sqrt((v * v).sum())
        if size == 0:
            continue
        own = _away(v[:, None] / size, np.hstack([basis, kept]))
        rest = np.sqrt((own * own).sum())
        if rest > 1e-10:
            own = _away(own / rest, np.hstack([basis, kept]))
            kept = np.hstack([kept, own / np.sqrt((own * own).sum())])
    return kept


def minres(right: np.ndarray, steps: int, gain: float) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Minimal residual method for a symmetric operator: yields a vector, is sent what the operator makes of it."""
    found = np.zeros_like(right)
    left = first = np.sqrt((right * right).sum())
    if first == 0:
        return found
    v, v_before, beta = right / first, np.zeros_like(right), 0.0
    w, w_before = np.zeros_like(right), np.zeros_like(right)
    c, c_before, s, s_before = 1.0, 1.0, 0.0, 0.0
    for _ in range(steps):
        image = yield v
        alpha = (v * image).sum()
        image = image - alpha * v - beta * v_before
        beta_next = np.sqrt((image * image).sum())
        turned = c * alpha - c_before * s * beta
        size = np.hypot(turned, beta_next)
        if size <= _EPS * abs(alpha) or size == 0:
            break
        w, w_before = (v - s_before * beta * w_before - (s * alpha + c_before * c * beta) * w) / size, w
        c, c_before, s, s_before = turned / size, c, beta_next / size, s
        found = found + c * left * w
        left = -s * left
        if abs(left) <= gain * first or beta_next <= _EPS * size:
            break
        v, v_before, beta = image / beta_next, v, beta_next
    return found


def _corrections(multiply: Multiply, values: np.ndarray, residuals: np.ndarray, fixed: np.ndarray, effort: Effort) -> np.ndarray:
    """Approximate solutions t of P (V - value) P t = -residual for all values, P projecting ``fixed`` away."""
    solvers = [minres(-_away(r[:, None], fixed)[:, 0], effort.inner_steps, effort.inner_gain) for r in residuals.T]
    found: list[np.ndarray | None] = [None] * len(solvers)
    asked: dict[int, np.ndarray] = {}

    def advance(i: int, image: np.ndarray | None) -> None:
        try:
            asked[i] = solvers[i].send(image)
        except StopIteration as done:
            found[i] = done.value
            asked.pop(i, None)

    for i in range(len(solvers)):
        advance(i, None)
    while asked:
        open_ = list(asked)
        vectors = np.column_stack([asked[i] for i in open_])
        images = _away(multiply(vectors) - vectors * values[open_], fixed)
        for i, image in zip(open_, images.T):
            advance(i, image)
    return np.column_stack(found)


def leading_components(multiply: Multiply, size: int, wanted: int, effort: Effort = Effort()) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a positive semidefinite operator, falling, and unit eigenvectors.

    Every residual is at most ``size * eps`` times the largest eigenvalue, measured with
    products of the vectors returned.
    """
    wanted = min(wanted, size)
    draw = np.random.default_rng(effort.seed)
    basis = _new_directions(draw.standard_normal((size, min(size, 2 * wanted))), np.empty((size, 0)))
    images = multiply(basis)
    locked = np.empty((size, 0))
    largest = 0.0
    limit = max(effort.subspace * wanted, 3 * wanted)
    for _ in range(effort.outer_steps):
        values, turn = symmetric_eigen(_dot(basis.T, images))
        basis, images = _dot(basis, turn), _dot(images, turn)
        largest = max(largest, values[0])
        enough = max(size, 32) * _EPS * largest
        sought = min(wanted - locked.shape[1], basis.shape[1])
        residuals = _away(images[:, :sought] - basis[:, :sought] * values[:sought], locked)
        reached = np.sqrt((residuals**2).sum(axis=0)) <= enough
        ready = sought if reached.all() else int(np.argmin(reached))
        locked = np.hstack([locked, basis[:, :ready]])
        basis, images = basis[:, ready:], images[:, ready:]
        if locked.shape[1] == wanted:
            # once more from new products: the stored ones carry the rounding of all steps
            locked = _new_directions(locked, np.empty((size, 0)))
            fresh = multiply(locked)
            values, turn = symmetric_eigen(_dot(locked.T, fresh))
            found, fresh = _dot(locked, turn), _dot(fresh, turn)
            if np.sqrt(((fresh - found * values) ** 2).sum(axis=0)).max() <= enough:
                return values, found
            basis, images, locked = found, fresh, np.empty((size, 0))
            continue
        values, residuals, sought = values[ready:], residuals[:, ready:], sought - ready
        if basis.shape[1] + sought > max(limit, sought + 1):
            basis, images = basis[:, : 2 * wanted], images[:, : 2 * wanted]
        if sought:
            fixed = np.hstack([locked, basis[:, :sought]])
            more = _corrections(multiply, values[:sought], residuals, fixed, effort)
        else:  # all directions so far are locked
            more = draw.standard_normal((size, wanted))
        more = _new_directions(more, np.hstack([locked, basis]))
        if not more.shape[1] and locked.shape[1] + basis.shape[1] < size:
            more = _new_directions(draw.standard_normal((size, 1)), np.hstack([locked, basis]))
        if more.shape[1]:
            basis, images = np.hstack([basis, more]), np.hstack([images, multiply(more)])
        else:  # the whole space is spanned: only rounding is left to mend
            images = multiply(basis)
    raise RuntimeError(f"components not found within {effort.outer_steps} steps")


def integer_vectors(vectors: DataFrame, scale: int, shift: int, id_col: str, vec_col: str) -> DataFrame:
    """Rows (``_id``, ``_x``) of the usable vectors."""
    return vectors.where(finite(F.col(vec_col))).select(
        F.col(id_col).alias("_id"), floored(F.col(vec_col), scale, shift).alias("_x")
    )


def _centred(batch: pa.RecordBatch, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S for the rows of a batch, exactly."""
    x = batch.column(batch.schema.get_field_index("_x")).flatten().to_numpy()
    return n * x.reshape(-1, len(sums)) - sums


def products(rows: DataFrame, n: int, sums: np.ndarray) -> Multiply:
    """The covariance as an operator: each call is one pass over the rows."""
    size = len(sums)
    vectors_only = rows.select("_x")

    def multiply(vectors: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(vectors.shape)
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    c = _centred(batch.slice(at, _ROWS), n, sums) / n
                    total += c.T @ (c @ vectors)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])

        parts = vectors_only.mapInArrow(run, "place long, value double")
        # as many rows as the vectors have entries
        got = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(vectors.size)
        out[[r["place"] for r in got]] = [r["value"] for r in got]
        return out.reshape(size, -1) / n

    return multiply


def _projected(rows: DataFrame, n: int, sums: np.ndarray, axes: np.ndarray) -> DataFrame:
    """Rows (``_id``, ``deviation``, ``_whitened``)."""
    kind = StructType([rows.schema["_id"], StructField("deviation", LongType()), StructField("_whitened", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = _centred(batch, n, sums)
            if (exact.astype(float) ** 2).sum(axis=1).max(initial=0.0) >= 2.0**62:
                raise OverflowError("a deviation may not fit into 64 bits")
            z = (exact / n) @ axes
            lists = pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], pa.array(z.ravel()))
            own = batch.column(batch.schema.get_field_index("_id"))
            yield pa.RecordBatch.from_arrays([own, pa.array((exact * exact).sum(axis=1)), lists], names=kind.names)

    return rows.mapInArrow(run, kind)


def whiten(
    vectors: DataFrame,
    components: int = 8,
    scale: int = 1024,
    shift: int = 100_000,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    effort: Effort = Effort(),
) -> DataFrame:
    """All usable rows on the leading components of all of them.

    Id, ``n``, ``deviation`` (sum over dimensions of (n * x - S) ** 2), ``whitened`` (array,
    components by falling eigenvalue), ``explained`` (array) and ``identity_error``.
    """
    spark = vectors.sparkSession
    rows = materialise(integer_vectors(vectors, scale, shift, id_col, vec_col), "whitening-rows")
    size = F.size("_x")
    largest = F.max(F.array_max(F.transform("_x", lambda c: F.greatest(c, -c))))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("d"), F.max(size).alias("d_max"), largest.alias("x")).first()
    shape = StructType(
        [
            StructField(id_col, vectors.schema[id_col].dataType), StructField("n", LongType()), StructField("deviation", LongType()),
            StructField("whitened", ArrayType(DoubleType())), StructField("explained", ArrayType(DoubleType())),
            StructField("identity_error", DoubleType()),
        ]
    )
    if not seen["d"] and not seen["d_max"]:
        return spark.createDataFrame([], shape)
    if seen["d"] != seen["d_max"]:
        raise ValueError("vectors of unlike length")
    n = seen["n"]
    if n * seen["x"] >= 1 << 61:
        raise OverflowError("sums may not fit into 64 bits")
    # one row for each dimension
    added = rows.select(F.posexplode("_x")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    sums = np.zeros(seen["d"], dtype=np.int64)
    for r in added:
        sums[r["pos"]] = r["s"]
    values, axes = leading_components(products(rows, n, sums), len(sums), components, effort)
    kept = values > len(sums) * _EPS * max(values[0], 0.0)
    values, axes = values[kept], axes[:, kept]
    if not len(values):
        return spark.createDataFrame([], shape)
    found = materialise(_projected(rows, n, sums, axes / np.sqrt(values)), "whitening-rows-projected")
    count = len(values)
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    told = found.agg(
        F.sum(F.col("deviation").cast("double")).alias("deviation"),
        *[F.sum(F.col("_whitened")[i]).alias(f"m{i}") for i in range(count)],
        *[F.sum(F.col("_whitened")[i] * F.col("_whitened")[j]).alias(f"s{i}_{j}") for i, j in pairs],
    ).first()
    trace = told["deviation"] / n / n / n
    error = max(abs(told[f"s{i}_{j}"] / n - told[f"m{i}"] / n * (told[f"m{j}"] / n) - (i == j)) for i, j in pairs)
    return found.select(
        F.col("_id").alias(id_col),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("_whitened").alias("whitened"),
        F.array(*[F.lit(float(v / trace)) for v in values]).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )


def by_component(whitened: DataFrame) -> DataFrame:
    """A row for each vector and ``component``, numbered from 1."""
    others = [c for c in whitened.columns if c not in ("whitened", "explained")]
    long = whitened.select(*others, F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_of"))
    return long.select(
        *others, (F.col("_at") + 1).alias("component"), F.col("_of.whitened").alias("whitened"), F.col("_of.explained").alias("explained")
    )
