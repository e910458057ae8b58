"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X of all distinct vectors are never multiplied into a covariance matrix.  Each
step of the bidiagonalisation is one pass over the stored rows: a task makes its rows of Xv and at
once their part of the transposed product Xᵀu.

    α_j u_j = X v_j - β_(j-1) u_(j-1)          β_j v_(j+1) = Xᵀ u_j - α_j v_j

Left vectors are as long as the table, so none is kept: u_j is X w_j for a short vector w_j.  Both
sides are orthogonalised in full on short vectors: the product of Xq with an earlier u_i is that of
q with Xᵀu_i, which step i has brought.  The singular values of the small bidiagonal matrix are the deviations, and its right singular
vectors turn the Lanczos vectors into the components.  If a step finds nothing new (an invariant
subspace), another start vector from the row space continues the basis, so that equal eigenvalues
are all found.  By default the basis grows to the rank of the rows.

Entries are quantised to integers first (see ``quantised``).  Sums are exact, and rows are centred
as integers before the one division, so a large common offset costs no digits.

What grows with the data stays in tasks: the driver sees a few numbers for each dimension.  Rows
are stored once, in blocks of ``BLOCK_BYTES``, and a lost executor costs a re-read.

Defined results: vectors that are null, empty or hold null or non-finite entries are left out, and
so are those of another length than the most common one (ties: the longer).  Entries beyond
``MOST`` count as ``MOST``.  Rows may repeat, also their ids, which may be null: each has its result.
Components end at the rank of the rows (relative deviation 1e-7), so a table with one distinct
vector has none and gives no row, like an empty table.  A ``deviation`` beyond a long is null.
Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakframe.llm.storage import stored

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
MOST = float(1 << 46)
BLOCK_BYTES = 1 << 21
NOTHING = 1e-7  # of the largest deviation: what is smaller is no direction of the rows


@dataclass(frozen=True)
class Whitening:
    """``vectors`` (dimension, component) and ``deviations`` by falling deviation.  Centre of
    dimension i is ``base[i] + rest[i] / n``, with 0 <= rest < n."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float
    steps: int


def quantised(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id`` and ``x``: floor(64 c) + 1000000 of each entry c, as long."""
    vector = F.col(vec_col).cast("array<double>")
    finite = ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).where(finite).select(F.col(id_col).alias("id"), vector.alias("v"))
    common = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    bounded = lambda c: F.least(F.greatest(c, F.lit(-MOST)), F.lit(MOST))
    x = F.transform("v", lambda c: F.floor(bounded(c) * SCALE).cast("bigint") + OFFSET)
    return good.where(F.size("v") == (common["size"] if common else 0)).select("id", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _blocks(distinct: DataFrame) -> DataFrame:
    """The rows as binary matrices of about ``BLOCK_BYTES``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            size = max(1, BLOCK_BYTES // max(1, 8 * x.shape[1]))
            for at in range(0, len(x), size):
                part = np.ascontiguousarray(x[at:at + size], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary())], names=["block"])

    return distinct.mapInArrow(pack, "block binary")


def _summed(blocks: DataFrame, dimension: int, of: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """Sum of ``of(rows)``, an array of ``size`` numbers, over all blocks.  A task adds up its blocks
    and sends ``size`` rows; those are added by key, not by the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.float64 if kind == "double" else np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += of(np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dimension))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "part"])

    part = F.col("part") if kind == "double" else F.col("part").cast("decimal(38,0)")
    found = blocks.mapInArrow(partial, f"at int, part {kind}").groupBy("at").agg(F.sum(part).alias("part")).collect()
    out = [0] * size
    for row in found:
        out[row["at"]] = row["part"] if kind == "double" else int(row["part"])
    return np.array(out, np.float64 if kind == "double" else object)


def _low_high(x: np.ndarray) -> np.ndarray:
    """Column sums in two halves, so that a task's sums fit a long, and the number of rows."""
    low = x & 0xFFFFFFFF
    return np.concatenate([low.sum(0), (x >> 32).sum(0), [len(x)]])


def fit(distinct: DataFrame, components: int = COMPONENTS, steps: int | None = None, seed: int = 11) -> Whitening | None:
    """Whitening of the vectors ``x`` (each distinct one once); None without rows.

    ``steps`` bounds the basis, for vectors of very many dimensions: the leading components come
    first, the last ones wanted are then less exact.
    """
    first = distinct.first()
    if first is None:
        return None
    d = len(first["x"])
    blocks = stored(_blocks(distinct.select("x")), "whitening-blocks")
    sums = _summed(blocks, d, _low_high, 2 * d + 1, "bigint")
    n, total = int(sums[-1]), [int(low) + (int(high) << 32) for low, high in zip(sums[:d], sums[d:2 * d])]
    base = np.array([s // n for s in total], np.int64)
    rest = np.array([s % n for s in total], np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - base) - rest / n

    def normal(q: np.ndarray) -> tuple[float, np.ndarray]:
        """|Xq|² and Xᵀ(Xq) in one pass."""

        def of(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            u = y @ q
            return np.concatenate([[u @ u], y.T @ u])

        sums = _summed(blocks, d, of, d + 1)
        return float(sums[0]), sums[1:]

    random = np.random.default_rng(seed)
    right, left, products = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v, w and Xᵀu by step
    alphas: list[float] = []
    betas: list[float] = []  # betas[j] joins step j and j + 1; 0 where a new start was needed
    most = min(d, n - 1, steps or d)
    scale = 0.0

    def orthogonal(r: np.ndarray) -> np.ndarray:
        for _ in range(2):
            r = r - right @ (right.T @ r)
        return r

    def new_start() -> np.ndarray | None:
        """A vector of the row space that is not in the basis yet."""
        z = normal(orthogonal(random.standard_normal(d)))[1]
        length, r = np.linalg.norm(z), orthogonal(z)
        small = max(NOTHING * NOTHING * scale * scale, 1e-12 * length)
        return r / np.linalg.norm(r) if np.linalg.norm(r) > small else None

    v = new_start() if most > 0 else None
    while v is not None and len(alphas) < most:
        q = v - betas[-1] * left[:, -1] if betas else v
        for _ in range(2):
            q = q - left @ (products.T @ q)
        square, z = normal(q)
        alpha = float(np.sqrt(square))
        scale = max(scale, alpha)
        if alpha <= NOTHING * scale:
            break  # what is left has no length in the rows
        right, left = np.column_stack([right, v]), np.column_stack([left, q / alpha])
        products = np.column_stack([products, z / alpha])
        alphas.append(alpha)
        r = orthogonal(z / alpha - alpha * v)
        beta = float(np.linalg.norm(r))
        scale = max(scale, beta)
        if len(alphas) == most:
            break
        if beta > 1e-12 * scale:
            v = r / beta
            v = orthogonal(v)
            v /= np.linalg.norm(v)
            betas.append(beta)
        else:
            v = new_start()
            betas.append(0.0)
    k = len(alphas)
    small_matrix = np.diag(alphas) + np.diag(betas[:k - 1], 1) if k else np.zeros((0, 0))
    _, values, turned = np.linalg.svd(small_matrix) if k else (None, np.zeros(0), np.zeros((0, 0)))
    kept = min(components, int((values > NOTHING * values[0]).sum())) if k else 0
    vectors, deviations = (right @ turned.T)[:, :kept], values[:kept] / np.sqrt(n)

    def of(x: np.ndarray) -> np.ndarray:
        y = centred(x)
        white = (y @ vectors) / deviations
        return np.concatenate([[(y * y).sum()], (white.T @ white).ravel()])

    sums = _summed(blocks, d, of, 1 + kept * kept)
    trace, identity = sums[0] / n, sums[1:].reshape(kept, kept) / n - np.eye(kept)
    explained = deviations ** 2 / trace if kept else np.zeros(0)
    return Whitening(n, base, rest, vectors, deviations, explained, float(np.abs(identity).max()) if kept else 0.0, k)


def deviation(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n x - S)², exact."""
    off = x - model.base
    widest = int(np.abs(off).max(initial=0)) + 1
    if (widest * model.n) ** 2 * x.shape[1] < 1 << 63:
        return ((model.n * off - model.rest) ** 2).sum(1).tolist()
    exact = ((model.n * off.astype(object) - model.rest.astype(object)) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, steps: int | None = None) -> DataFrame:
    """One row for each vector and component: ``id_col``, ``component``, ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``."""
    whole = quantised(rows, id_col, vec_col)
    model = fit(whole.select("x").distinct(), components, steps)
    schema = f"`{id_col}` {dict(rows.dtypes)[id_col]}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    k = len(model.deviations)
    size = max(1, BLOCK_BYTES // (8 * len(model.base)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, size):
                part = batch.slice(at, size)
                x = _matrix(part.column(1))
                y = (x - model.base) - model.rest / model.n
                rows_of = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(rows_of)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows_of), model.n, np.int64)),
                    pa.array(deviation(x, model), pa.int64()).take(pa.array(rows_of)),
                    pa.array(((y @ model.vectors) / model.deviations).ravel()),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(len(rows_of), model.identity_error)),
                ], names=names)

    return whole.mapInArrow(project, schema)
