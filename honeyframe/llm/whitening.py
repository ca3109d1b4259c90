"""Embeddings whitened by their leading principal components (Jacobi-Davidson).

The covariance is never formed. A product of it with a few columns is one job: every
block of vectors is centred, multiplied with the columns and back, and the sums of
all tasks are added by an aggregate. Only ``dimension x columns`` numbers reach the
driver, whatever the number of vectors.

``leading_pairs`` keeps a search space, takes Ritz pairs from it, and widens it by
corrections ``t`` of the pairs that are not accurate yet, which solve

    (I - U U') (A - theta I) (I - U U') t = -(A u - theta u)

for the Ritz vectors ``U``. The equations of all these pairs are solved side by side
by MINRES, so a step of all of them is one product. Pairs whose residual is at
rounding level are locked: they stay in the space and get no corrections.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from honeyframe.llm.common import Written

BLOCK = 4096
#: Entries are usable below this size; the deviation of larger ones fits no long.
LARGEST = float(1 << 44)
_EPS = np.finfo(float).eps

_ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double"


# -- eigenpairs --------------------------------------------------------------------


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Columns that widen ``basis`` by ``new``; what lies in it is dropped."""
    out = np.zeros((len(basis), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        if size == 0:
            continue
        column = column / size
        for _ in range(3):
            column = column - basis @ (basis.T @ column) - out @ (out.T @ column)
        size = np.linalg.norm(column)
        if size > 1e-10:
            out = np.column_stack([out, column / size])
    return out


def minres(product, rhs: np.ndarray, shifts: np.ndarray, inside, tolerance: float, steps: int) -> np.ndarray:
    """Least-residual solutions of ``inside (A - shift) inside x = rhs`` for each
    column in its Krylov space; ``inside`` projects. Ends at ``tolerance`` for all
    columns, after ``steps`` steps, or when the spaces are used up."""
    columns = range(rhs.shape[1])
    start = np.linalg.norm(rhs, axis=0)
    basis = [rhs / np.maximum(start, 1e-300)]
    alpha, beta, answer = [], [], np.zeros_like(rhs)
    for k in range(1, steps + 1):
        v = basis[-1]
        w = inside(product(v) - v * shifts)
        alpha.append((v * w).sum(axis=0))
        for _ in range(2):  # the spaces are small: kept orthogonal in full
            for b in basis:
                w = w - b * (b * w).sum(axis=0)
        beta.append(np.linalg.norm(w, axis=0))
        worst = 0.0
        for c in columns:
            t = np.zeros((k + 1, k))
            for i in range(k):
                t[i, i], t[i + 1, i] = alpha[i][c], beta[i][c]
                if i:
                    t[i - 1, i] = beta[i - 1][c]
            e = np.zeros(k + 1)
            e[0] = start[c]
            y = np.linalg.lstsq(t, e, rcond=None)[0]
            answer[:, c] = sum(basis[i][:, c] * y[i] for i in range(k))
            worst = max(worst, np.linalg.norm(e - t @ y) / max(start[c], 1e-300))
        size = max(np.abs(alpha).max(), np.abs(beta).max(), 1e-300)
        if worst <= tolerance or beta[-1].max() <= 1e-12 * size:
            break
        basis.append(np.where(beta[-1] > 1e-12 * size, w / np.maximum(beta[-1], 1e-300), 0.0))
    return answer


def leading_pairs(product, dim: int, count: int, tolerance: float = 0.1, steps: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues (falling) of a symmetric positive
    operator, unit eigenvectors as columns, and the residuals' norms.

    Ends when all residuals are at rounding level, or below ``1e-12`` of the
    largest eigenvalue with no gain by a half in a round, or when the space is whole.
    """
    count = min(count, dim)
    width, room = min(dim, count + 4), min(dim, 4 * count + 16)
    space = np.linalg.qr(np.random.default_rng(0).normal(size=(dim, width)))[0]
    image = product(space)
    before = np.inf
    while True:
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        u, au = space @ turn, image @ turn
        rest = au[:, :count] - u[:, :count] * theta[:count]
        size = np.linalg.norm(rest, axis=0)
        scale = max(theta[0], 1e-300)
        locked = size <= 4 * _EPS * np.sqrt(dim) * scale
        if locked.all() or space.shape[1] == dim or (size.max() <= 1e-12 * scale and size.max() > before / 2):
            return theta[:count], u[:, :count], size
        before = size.max()
        wanted = u[:, :count]

        def inside(x):
            return x - wanted @ (wanted.T @ x)

        fix = minres(product, -inside(rest[:, ~locked]), theta[:count][~locked], inside, tolerance, min(steps, dim - count))
        if space.shape[1] + fix.shape[1] > room:  # a shorter space, of the best Ritz vectors
            keep = max(count + 4, room - fix.shape[1]) if room < dim else space.shape[1]
            space, image = u[:, :keep], au[:, :keep]
        more = _orthonormal(fix, space)
        if not more.shape[1]:
            more = _orthonormal(np.random.default_rng(space.shape[1]).normal(size=(dim, 1)), space)
        more = more[:, : dim - space.shape[1]]
        space, image = np.column_stack([space, more]), np.column_stack([image, product(more)])


# -- vectors in blocks ----------------------------------------------------------------


def _blocks(batches):
    ids, rows = [], []

    def block():
        data = np.array(rows, np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array([ids], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary()),
        ], names=["ids", "data"])

    for b in batches:
        flat, at = b.column(1).flatten().to_numpy(zero_copy_only=False), 0
        for i, size in zip(b.column(0).to_pylist(), b.column(1).value_lengths().to_pylist()):
            ids.append(i)
            rows.append(flat[at : at + size])
            at += size
            if len(ids) == BLOCK:
                yield block()
                ids, rows = [], []
    if ids:
        yield block()


def _each(batches, dim: int):
    for b in batches:
        for ids, data in zip(b.column(0), b.column(1)):
            yield ids.values, np.frombuffer(data.as_py(), np.int64).reshape(-1, dim)


def _sums(dim: int):
    def run(batches):
        for _, x in _each(batches, dim):
            wide = x if np.abs(x).max() < 1 << 25 else x.astype(object)  # squares of a block fit a long, or not
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, len(x))),
                pa.array([str(v) for v in wide.sum(axis=0)]), pa.array([str(v) for v in (wide * wide).sum(axis=0)]),
            ], names=["i", "n", "s", "q"])

    return run


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: whole numbers as longs, or as objects where they may not fit."""
    if n * max(int(np.abs(x).max()), 1) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


class Sum:
    """Compensated sum of arrays."""

    def __init__(self):
        self.high, self.low = None, None

    def add(self, x: np.ndarray) -> None:
        if self.high is None:
            self.high, self.low = x, np.zeros_like(x)
            return
        total = self.high + x
        self.low = self.low + np.where(np.abs(self.high) >= np.abs(x), (self.high - total) + x, (x - total) + self.high)
        self.high = total


def _moments(dim: int, n: int, sums: list[int], columns, back: bool):
    """Sums of a task over its vectors: centred ones times their projections on
    ``columns``, or (not ``back``) projections times projections, divided by n."""

    def run(batches):
        total = Sum()
        for _, x in _each(batches, dim):
            centred = deviations(x, n, sums).astype(float) / n
            projected = centred @ columns.value
            total.add((centred if back else projected).T @ projected / n)
        if total.high is not None:
            high, low = total.high.ravel(), total.low.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(high), pa.array(low)], names=["k", "high", "low"])

    return run


def _whitened(dim: int, n: int, sums: list[int], columns, explained: list[float]):
    def run(batches):
        count = len(explained)
        for ids, x in _each(batches, dim):
            exact = deviations(x, n, sums)
            wide = exact if int(np.abs(exact).max()) < 1 << 28 and dim < 1 << 6 else exact.astype(object)
            squares = [int(v) for v in (wide * wide).sum(axis=1)]
            rows = exact.astype(float) / n @ columns.value
            at = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n)),
                pa.array([v if v < 1 << 63 else None for v in squares], pa.int64()).take(pa.array(at)), pa.array(rows.ravel()), pa.array(np.tile(explained, len(x))),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return run


class Covariance:
    """The covariance of usable vectors as an operator.

    ``blocks`` is the written table of the vectors as whole numbers; ``n``, ``sums``
    and ``trace`` are exact up to one rounding.
    """

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str):
        self.spark = vectors.sparkSession
        v = F.col(vector_col).cast("array<double>")
        usable = F.size(v) > 0
        usable &= F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)))
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, v).alias("v")).where("v is not null")
        common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        self.dim = common["d"] if common else 0
        self.n, self.trace = 0, 0.0
        if not self.dim:
            return
        x = F.transform("v", lambda c: F.floor(F.lit(64.0) * c).cast("long") + F.lit(1_000_000).cast("long"))
        self.blocks = Written(self.spark).write(rows.where(F.size("v") == self.dim).select("vec_id", x.alias("x")).mapInArrow(_blocks, "ids array<long>, data binary"))
        found = (
            self.blocks.mapInArrow(_sums(self.dim), "i int, n long, s string, q string").groupBy("i")
            .agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "sq")).orderBy("i").collect()
        )
        self.n, self.sums = found[0]["n"], [int(r["s"]) for r in found]
        self.trace = sum(self.n * int(r["q"]) - int(r["s"]) ** 2 for r in found) / self.n**2

    def _total(self, columns: np.ndarray, back: bool) -> np.ndarray:
        shared = self.spark.sparkContext.broadcast(columns)  # dimension x columns numbers
        parts = self.blocks.mapInArrow(_moments(self.dim, self.n, self.sums, shared, back), "k long, high double, low double")
        out = np.zeros((self.dim if back else columns.shape[1]) * columns.shape[1])
        for r in parts.groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
            out[r["k"]] = r["high"] + r["low"]
        shared.unpersist()
        return out.reshape(-1, columns.shape[1])

    def product(self, columns: np.ndarray) -> np.ndarray:
        return self._total(columns, True)

    def projected(self, columns: np.ndarray) -> np.ndarray:
        """Covariance of the projections on ``columns``, from their values."""
        return self._total(columns, False)


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row
    for each usable vector and component.

    Vectors that are null, empty or hold null or non-finite entries are dropped, as are
    those with entries of ``LARGEST`` or more, and those whose length is not
    the most common one (of equally common ones, the greater). Entries ``c`` become
    ``floor(64 c) + 1000000``. Components are numbered from 1 by falling eigenvalue;
    ones without variance (at rounding level) are left out, so equal vectors, one vector
    or an empty table give an empty result. Equal eigenvalues have any base of their
    space, the same for all rows. Repeated rows count and are returned each; a null id
    stays null; a deviation that fits no long is null; other columns are not read.
    """
    spark = vectors.sparkSession
    cov = Covariance(vectors, id_col, vector_col)
    none = spark.createDataFrame([], f"{_ROWS}, identity_error double")
    if cov.trace <= 0:
        return none
    values, axes, _ = leading_pairs(cov.product, cov.dim, components)
    keep = values > 64 * cov.dim * _EPS * values[0]
    values, axes = values[keep], axes[:, keep]
    scaled = axes / np.sqrt(values)
    error = float(np.abs(cov.projected(scaled) - np.eye(len(values))).max())
    shared = spark.sparkContext.broadcast(scaled)
    explained = [float(v / cov.trace) for v in values]
    out = cov.blocks.mapInArrow(_whitened(cov.dim, cov.n, cov.sums, shared, explained), _ROWS)
    return out.withColumn("identity_error", F.lit(error))
