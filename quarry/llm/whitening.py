"""Embedding whitening: the leading principal components by matrix-free block Lanczos.

Entries become integers, x = floor(256 c). The fit list is each distinct x vector once; it is written
to the shared folder, and every product with the covariance V is one pass over it: tasks centre
their vectors, multiply them with a block of at most ``BLOCK`` vectors and send one matrix of
dimension x block; Spark adds these up. V itself is never formed.

The basis is orthogonalised in full, twice for each block. A column that vanishes there (breakdown)
is replaced by a seeded random one, orthogonal to the basis, until the basis spans the whole space.
The products with the basis are kept beside it, so residuals of the Ritz pairs are those of the
real matrix rather than a recurrence's; the search ends when the wanted ones fall below
``TOLERANCE`` of the largest eigenvalue, or all dimensions are spanned. At ``BASIS`` columns it
restarts from the leading Ritz vectors. The driver holds two matrices of dimension x ``BASIS``.

Counts, sums and deviations are exact integers of any size; the trace of V comes from deviations.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; so are
those of another length than most rows have (of lengths equally common, the longer stays), and
empty vectors. Equal vectors fit once and are all returned; rows with a null or repeated id are rows.
Components without variance (an eigenvalue of at most the rounding error of the largest) do not
exist, so there are fewer rows for each vector, and none if all vectors are equal. A deviation
beyond 64 bits is null in ``deviation`` and whole in ``deviation_text``. A product of 256 beyond 64
bits stays at the largest long. An empty table gives an empty result. Other columns are ignored,
whatever their names. Signs: the largest entry of a component, the first of equals, is positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import lean, small_batches, table, written

COMPONENTS = 4
SCALE = 256
BLOCK, BASIS = 8, 128
#: Residual of a component, as a share of the largest eigenvalue.
TOLERANCE = 2e-14
#: Vectors of a product at a time.
ROWS = 4096
SEED = 20
_WORD = 1 << 60


def quantised(vector: Column) -> Column:
    """floor(256 c) of each entry, as longs; null if the vector is null or has a null or non-finite entry."""
    unfit = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~unfit, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def usable(docs: DataFrame, vector: str) -> DataFrame:
    """The rows with a usable vector, as x beside their columns: those of the commonest length."""
    rows = docs.withColumn(X, quantised(F.col(vector))).filter(F.size(X) > 0)
    length = rows.groupBy(F.size(X).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).select("d").first()
    return rows.filter(F.size(X) == (length.d if length else -1))


X = "quarry x"


def matrix(column: pa.Array) -> np.ndarray:
    d = len(column[0])
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass(frozen=True)
class Moments:
    """Number of vectors, exact sums of each dimension, exact sum of deviations."""

    n: int
    sums: tuple[int, ...]
    deviations: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def trace(self) -> float:
        return self.deviations / self.n**3


def _halves(values: list[int]) -> tuple[list[Decimal], list[Decimal]]:
    """Integers of any size as high and low parts, which Spark adds up exactly."""
    return [Decimal(v // _WORD) for v in values], [Decimal(v % _WORD) for v in values]


def _added(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> dict[int, int]:
    parts = rows.mapInArrow(lean(run), "at int, high decimal(38,0), low decimal(38,0)")
    return {r["at"]: int(r["high"]) * _WORD + int(r["low"]) for r in parts.groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}


def _decimals(values: list[int]) -> pa.RecordBatch:
    high, low = _halves(values)
    kind = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(high, kind), pa.array(low, kind)], ["at", "high", "low"])


def exact_sums(x: np.ndarray) -> list[int]:
    if np.abs(x.astype("f8")).max() * len(x) < 2**62:
        return [int(v) for v in x.sum(0)]
    return [int(v) for v in x.astype(object).sum(0)]


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S: integers, of Python where 64 bits could overflow."""
    largest = max(np.abs(x.astype("f8")).max() * n, max(abs(s) for s in sums))
    if largest < 2**61:
        return x * n - np.array(sums, "i8")
    return x.astype(object) * n - np.array(sums, object)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    gap = centred(x, n, sums)
    if gap.dtype == object or (gap.astype("f8") ** 2).sum(1).max() >= 2**62:
        gap = gap.astype(object)
    return [int(v) for v in (gap * gap).sum(1)]


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, total = 0, None
    for batch in batches:
        if batch.num_rows:
            own = exact_sums(matrix(batch.column(0)))
            total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
            count += batch.num_rows
    if total is not None:
        yield _decimals([count, *total])


def _sum_deviations(n: int, sums: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _decimals([sum(sum(deviations(matrix(b.column(0)), n, sums)) for b in batches if b.num_rows)])

    return run


def moments(fit: DataFrame) -> Moments | None:
    """Of the fit list (one column, x); None if it is empty."""
    got = _added(fit, _sum_up)
    if not got:
        return None
    n, sums = got[0], tuple(got[k] for k in range(1, len(got)))
    return Moments(n, sums, _added(fit, _sum_deviations(n, sums))[0])


def _product(n: int, sums: tuple[int, ...], block: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block.shape)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                z = centred(matrix(batch.column(0).slice(a, ROWS)), n, sums).astype("f8") / n
                total += z.T @ (z @ block)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "v"])

    return run


def covariance_times(fit: DataFrame, known: Moments) -> Callable[[np.ndarray], np.ndarray]:
    """The product of V with a block of vectors, as a pass over ``fit``."""

    def times(block: np.ndarray) -> np.ndarray:
        parts = fit.mapInArrow(lean(_product(known.n, known.sums, block)), "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
        out = np.zeros(block.size)
        for r in parts.collect():
            out[r["at"]] = r["v"]
        return out.reshape(block.shape) / known.n

    return times


def _fresh(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The columns of ``block`` made orthonormal to ``basis`` and each other; those that vanish are replaced at random, while there is room."""
    out = basis
    for k in range(block.shape[1]):
        v = block[:, k]
        for _ in range(8):
            if out.shape[1] >= out.shape[0]:
                return out[:, basis.shape[1] :]
            size = np.linalg.norm(v)
            if size > 0:
                v = v / size
                for _ in range(2):
                    v = v - out @ (out.T @ v)
                left = np.linalg.norm(v)
                if left > 1e-8:
                    v = v / left
                    v = v - out @ (out.T @ v)
                    out = np.column_stack([out, v / np.linalg.norm(v)])
                    break
            v = rng.standard_normal(len(v))
    return out[:, basis.shape[1] :]


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, most: int = BASIS, tolerance: float = TOLERANCE, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors in columns."""
    rng = np.random.default_rng(SEED)
    wanted, block = min(wanted, d), min(block, d)
    most = max(most, wanted + 2 * block)
    basis = images = np.zeros((d, 0))
    step = _fresh(rng.standard_normal((d, block)), basis, rng)
    best, stalled = np.inf, 0
    for _ in range(rounds):
        basis, images = np.column_stack([basis, step]), np.column_stack([images, times(step)])
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        ritz, image = basis @ vectors[:, :wanted], images @ vectors[:, :wanted]
        residual = image - ritz * values[:wanted]
        worst = np.linalg.norm(residual, axis=0).max()
        # Near the tolerance only noise may be left: six rounds without any gain end it too.
        stalled = stalled + 1 if worst >= 0.95 * best else 0
        best = min(best, worst)
        scale = max(abs(values[0]), np.finfo("f8").tiny)
        if worst <= tolerance * scale or basis.shape[1] >= d or (stalled >= 6 and best <= 10 * tolerance * scale):
            break
        step = _fresh(images[:, -step.shape[1] :], basis, rng)
        if basis.shape[1] + block > most:
            kept = vectors[:, : wanted + block]
            basis, images = basis @ kept, images @ kept
    return values[:wanted], ritz


@dataclass(frozen=True)
class Whitening:
    moments: Moments
    values: np.ndarray
    #: Unit eigenvectors in columns, each divided by the root of its value.
    scaled: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (centred(x, self.moments.n, self.moments.sums).astype("f8") / self.moments.n) @ self.scaled


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From the fit list (one column, x); None if it is empty."""
    known = moments(fit)
    if known is None:
        return None
    d = len(known.sums)
    values, vectors = block_lanczos(covariance_times(fit, known), d, components)
    real = values > d * np.finfo("f8").eps * max(values[0], 0)
    values, vectors = values[real], vectors[:, real]
    top = np.argmax(np.abs(vectors) > np.abs(vectors).max(0) * (1 - 1e-9), axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)
    return Whitening(known, values, vectors / np.sqrt(values))


def _outer(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        total = np.zeros((k + 1, k))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                w = model.apply(matrix(batch.column(0).slice(a, ROWS)))
                total += np.vstack([w.T @ w, w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "v"])

    return run


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    out = np.zeros((k + 1) * k)
    for r in fit.mapInArrow(lean(_outer(model)), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    out = out.reshape(k + 1, k) / model.moments.n
    return float(np.abs(out[:k] - np.outer(out[k], out[k]) - np.eye(k)).max())


def _rows(model: Whitening, error: float):
    k = len(model.values)
    explained = model.values / model.moments.trace if k else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = matrix(batch.column(1))
            exact = deviations(x, model.moments.n, model.moments.sums)
            each = np.repeat(np.arange(len(x)), k)
            ids = batch.column(0).take(pa.array(each))
            fits = pa.array([v if v < 2**63 else None for v in exact], pa.int64()).take(pa.array(each))
            n = len(each)
            columns = [
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(x))), pa.array(np.full(n, model.moments.n, "i8")), fits, pa.array(model.apply(x).ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(n, error)), pa.array([str(v) for v in exact]).take(pa.array(each)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"])

    return run


def whitened(docs: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id_column``, component, n, deviation, whitened, explained, identity_error, deviation_text: for each usable row and component."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_column).alias("id"), F.col(vector).alias("v"))
    rows = usable(plain, "v").select("id", F.col(X).alias("x"))
    fit = written(rows.select("x").distinct(), "whitening-fit")
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
    model = fitted(fit, components)
    if model is None:
        model = Whitening(Moments(0, (), 0), np.zeros(0), np.zeros((0, 0)))
    return rows.mapInArrow(lean(_rows(model, identity_error(fit, model))), schema).withColumnRenamed("id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
