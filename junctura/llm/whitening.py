"""Operator 13: whitening of embeddings by the singular values and directions of their centred matrix.

The covariance is never formed. Tasks reduce their centred rows block by block to a triangular factor (QR), factors are
stacked and reduced again in groups until a few are left, and the last one, ``R``, has the dimension's square whatever the
number of rows. Householder reflections from both sides make it bidiagonal, the qd algorithm with shifts finds its singular
values to high relative accuracy, and twisted factorisations give the direction of each.

Components are whole numbers, so their sums are exact; rows are centred by the whole part of the mean first, which is exact
too, then by the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.kernels import release_memory
from junctura.llm.scratch import materialize

#: Factors that one task stacks, and that the driver reduces at the end; rows handled at a time.
FAN_IN, ROWS = 32, 4096
EPS = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)


# --- rows --------------------------------------------------------------------------------------------------------------


def whole_rows(vectors: pa.Array, length: int, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors of that length without null or non-finite entries, and floor(scale * entry) + shift."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == length)
    flat = vectors.take(pa.array(at)).flatten()
    entries = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(at), length)
    usable = np.isfinite(entries).all(axis=1)
    x = np.floor(scale * entries[usable])
    if x.size and np.abs(x).max() >= 2.0**62:
        raise OverflowError(f"an entry times {scale} has no place in 64 bits")
    return at[usable], x.astype(np.int64) + shift


def column_sums(rows: DataFrame, scale: int, shift: int) -> DataFrame:
    """``length, dim, n, total``: the vectors of each length and their exact sums, for each task and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                vectors = batch.column(1).slice(k, ROWS)
                for length in np.unique(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)):
                    if length > 0:
                        _, x = whole_rows(vectors, int(length), scale, shift)
                        # In two halves, neither of which overflows.
                        total = [int(h) * (1 << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]
                        held = sums.setdefault(int(length), [0, [0] * int(length)])
                        held[0] += len(x)
                        held[1] = [a + b for a, b in zip(held[1], total, strict=True)]
        out = [(length, d, n, Decimal(t)) for length, (n, totals) in sums.items() if n for d, t in enumerate(totals)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["length", "dim", "n", "total"])

    return rows.mapInArrow(run, "length int, dim int, n long, total decimal(38,0)").groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))


def exact_squares(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Of each row, the sum of (n * entry - column sum) squared; an error where 64 bits don't hold it."""
    most = max((abs(n * int(m) - s) for m in (x.max(initial=0), x.min(initial=0)) for s in sums), default=0)
    if len(sums) * most**2 < 1 << 62 and n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) < 1 << 62:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(1)
    out = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    if max(out, default=0) >= 1 << 63:
        raise OverflowError("a deviation has no place in 64 bits")
    return np.array(out, dtype=np.int64)


# --- reduction of many small matrices ----------------------------------------------------------------------------------


def triangle(blocks: np.ndarray) -> np.ndarray:
    """The triangular factor of stacked rows."""
    return np.linalg.qr(blocks, mode="r")


def reduced(parts: DataFrame, columns: int, combine: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """One matrix from those that ``parts`` (``part long, matrix binary``) holds, by stacking and combining.

    FAN_IN of them meet in a task, round after round, until the driver gets at most FAN_IN. ``parts`` is written first, so
    that the rounds read it and do not make it anew.
    """

    def meet(table: pa.Table) -> pa.Table:
        ordered = sorted(zip(table.column("part").to_pylist(), table.column("matrix").to_pylist(), strict=True))
        stacked = np.concatenate([np.frombuffer(m).reshape(-1, columns) for _, m in ordered])
        return pa.table({"part": pa.array([ordered[0][0]], pa.int64()), "matrix": pa.array([combine(stacked).tobytes()], pa.binary())})

    parts = materialize(parts, "matrices")
    left = parts.count()
    while left > FAN_IN:
        groups = -(-left // FAN_IN)
        met = parts.groupBy(F.pmod("part", F.lit(groups)).alias("group")).applyInArrow(meet, "part long, matrix binary")
        parts = materialize(met.withColumn("part", F.pmod("part", F.lit(groups))), "matrices")
        left = min(groups, left - 1)
    found = sorted((r["part"], bytes(r["matrix"])) for r in parts.collect())
    stacked = [np.frombuffer(m).reshape(-1, columns) for _, m in found]
    return combine(np.concatenate(stacked)) if stacked else np.zeros((0, columns))


# --- singular values and directions ------------------------------------------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """``v, tau, beta``: I - tau v v^T takes x to beta times the first unit vector."""
    v, tail = x.astype(float), float(np.linalg.norm(x[1:]))
    if tail == 0:
        return v, 0.0, float(x[0])
    beta = -np.copysign(np.hypot(x[0], tail), x[0])
    tau = (beta - x[0]) / beta
    v = v / (x[0] - beta)
    v[0] = 1.0
    return v, tau, float(beta)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``diagonal, above, right``: U^T r right is upper bidiagonal with these entries, for a square r."""
    a, n = np.array(r, dtype=float), r.shape[1]
    diagonal, above, right = np.zeros(n), np.zeros(max(0, n - 1)), np.eye(n)
    for k in range(n):
        v, tau, diagonal[k] = _reflector(a[k:, k])
        a[k:, k:] -= tau * np.outer(v, v @ a[k:, k:])
        if k + 1 < n:
            v, tau, above[k] = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= tau * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= tau * np.outer(right[:, k + 1 :] @ v, v)
    return diagonal, above, right


def _qd_pass(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd transform; the last list holds the auxiliary d, whose minimum is below 0 where the shift is too large."""
    d, new_q, new_e, ds = q[0] - shift, [], [], []
    for k in range(len(e)):
        ds.append(d)
        total = d + e[k]
        new_q.append(total)
        ratio = q[k + 1] / total if total > 0 else 0.0
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    ds.append(d)
    return [*new_q, d], new_e, ds


def qd_values(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The eigenvalues of B^T B, falling, for a bidiagonal B whose squared entries are q and e, all above 0."""
    segments, out = [(list(map(float, q)), list(map(float, e)), 0.0)], []
    while segments:
        qs, es, done = segments.pop()  # done: what shifts have taken off
        if qs[0] < qs[-1]:  # graded the other way: the flipped matrix has the same values
            qs, es = qs[::-1], es[::-1]
        for _ in range(60 * len(qs)):
            cut = next((k for k in range(len(es) - 1, -1, -1) if es[k] <= EPS**2 * (done + qs[k + 1]) or qs[k + 1] * es[k] <= (EPS * done) ** 2), None)
            if cut is not None:
                segments.append((qs[cut + 1 :], es[cut + 1 :], done))
                qs, es = qs[: cut + 1], es[:cut]
                continue
            if len(qs) == 1:
                out.append(done + qs[0])
                break
            # 1 / (sum of 1/d) of a pass without shift is a lower bound of the least value left, which shifts may not pass.
            qs, es, ds = _qd_pass(qs, es, 0.0)
            shift = (1 - 4 * EPS * len(qs)) / sum(1 / d for d in ds) if min(ds) > TINY else 0.0
            while shift > EPS / 4 * done:
                new_q, new_e, ds = _qd_pass(qs, es, shift)
                if min(ds) >= 0:
                    qs, es, done = new_q, new_e, done + shift
                    break
                shift /= 2
        else:
            raise ArithmeticError("qd passes did not settle")
    return np.sort(np.array(out))[::-1]


def twisted(q: np.ndarray, e: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """A vector z for an approximate eigenvalue of B^T B by its twisted factorisation, and the value's correction.

    The factorisation from above and the one from below meet where the joint pivot is least.
    """
    n = len(q)
    ell = np.sqrt(e / q[:-1])
    s, p = np.zeros(n), np.zeros(n)
    up, down = np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1))
    s[0], p[-1] = -value, q[-1] - value
    for k in range(n - 1):
        pivot = s[k] + q[k]
        pivot = pivot if abs(pivot) > TINY / EPS else TINY / EPS
        up[k] = q[k] * ell[k] / pivot
        s[k + 1] = up[k] * ell[k] * s[k] - value
    for k in range(n - 2, -1, -1):
        pivot = q[k] * ell[k] ** 2 + p[k + 1]
        pivot = pivot if abs(pivot) > TINY / EPS else TINY / EPS
        down[k] = ell[k] * q[k] / pivot
        p[k] = p[k + 1] * (q[k] / pivot) - value
    gamma = s + p + value
    at = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -up[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -down[k] * z[k]
    norm2 = float(z @ z)
    return z / np.sqrt(norm2), float(gamma[at]) / norm2


def block_directions(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of B^T B for one bidiagonal block without zeros."""
    values = qd_values(q, e)
    vectors = np.zeros((len(q), len(q)))
    diagonal = q + np.append(0, e)
    beside = np.sqrt(q[:-1] * e)
    rng = np.random.default_rng(0)
    for k, value in enumerate(values):
        z, correction = twisted(q, e, value)
        for _ in range(2):
            if abs(correction) <= 2 * EPS * value:
                break
            better, again = twisted(q, e, value + correction)
            if abs(again) >= abs(correction):
                break
            value, z, correction = value + correction, better, again
        # Values too close for a factorisation to tell their vectors apart share a subspace: the rest of it is taken.
        basis = vectors[:, :k][:, np.abs(values[:k] - value) <= 1e-7 * value]
        if basis.shape[1]:
            overlap = float(np.abs(basis.T @ z).max())
            for _ in range(8 if overlap > 1e-6 else 0):
                z = _outside(basis, z)
                if z is not None:
                    z = _outside(basis, _solve_shifted(diagonal, beside, value * (1 + 4 * EPS), z))
                if z is not None and np.abs(diagonal * z + np.append(0, beside * z[:-1]) + np.append(beside * z[1:], 0) - value * z).max() < 1e-12 * values[0]:
                    break
                z = rng.normal(size=len(q)) if z is None else z
            z = _outside(basis, z) if overlap > 1e-15 else z
        vectors[:, k] = z
    return values, vectors


def _outside(basis: np.ndarray, z: np.ndarray) -> np.ndarray | None:
    """The unit vector along what of z is at right angles to the basis; None if that is next to nothing."""
    size = np.linalg.norm(z)
    z = z - basis @ (basis.T @ z)
    z = z - basis @ (basis.T @ z)
    return None if np.linalg.norm(z) < 1e-3 * size else z / np.linalg.norm(z)


def _solve_shifted(diagonal: np.ndarray, beside: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """A step of inverse iteration on the tridiagonal matrix of a block."""
    full = np.diag(diagonal - value) + np.diag(beside, 1) + np.diag(beside, -1)
    try:
        found = np.linalg.solve(full, right)
    except np.linalg.LinAlgError:  # singular to the last bit
        found = np.linalg.solve(full + EPS * value * np.eye(len(full)), right)
    return found / np.linalg.norm(found)


def principal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of r, falling, and its right singular vectors as columns."""
    n = r.shape[1]
    square = np.zeros((n, n))
    square[: min(n, len(r))] = r[:n]
    scale = float(np.abs(square).max(initial=0.0))
    if scale == 0:
        return np.zeros(n), np.eye(n)
    diagonal, above, right = bidiagonal(square / scale)
    # What lies below the rounding of the reduction is as good as zero: the matrix parts there, and pivots are kept above it.
    least = 4 * EPS * float(max(np.abs(diagonal).max(), np.abs(above).max(initial=0)))
    diagonal = np.where(np.abs(diagonal) < least / 64, least / 64, diagonal)
    signs = np.cumprod(np.append(1.0, np.where(diagonal[:-1] * above < 0, -1.0, 1.0)))
    values, vectors = np.zeros(n), np.zeros((n, n))
    cuts = [0, *(np.flatnonzero(np.abs(above) <= least) + 1).tolist(), n]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        values[i:j], vectors[i:j, i:j] = block_directions(diagonal[i:j] ** 2, above[i : j - 1] ** 2)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale**2, (right @ (signs[:, None] * vectors))[:, order]


# --- the operator ------------------------------------------------------------------------------------------------------


def whiten(
    table: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector and component.

    Entries become x = floor(scale * entry) + shift. Components are the unit eigenvectors of the covariance (divisor n),
    by falling eigenvalue e; ``whitened`` is a centred vector's coordinate over sqrt(e), ``explained`` e over the sum of
    all, ``deviation`` the sum of (n x - column sum) squared, ``identity_error`` the largest entry by which the covariance
    of the whitened vectors, taken over the data, departs from the identity.

    * vectors that are null, empty or hold null or non-finite entries take no part, nor do those that lack entries or have
      more than the others: the length that most vectors have counts, of equally frequent ones the greater;
    * components whose singular value is below 1e-12 of the greatest (constant or dependent entries) can't be whitened and
      are left out, so equal vectors alone, and a single one, give no rows; an empty table gives none either;
    * equal eigenvalues share a subspace, of which any orthonormal basis is taken, the same one for all rows;
    * null and repeated ids are passed on, repeated rows count as often as they stand there, other columns aren't read;
    * an entry or a deviation that 64 bits don't hold is an error.
    """
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sums = materialize(column_sums(rows, scale, shift), "column-sums")
    first = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if first is None:
        return table.sparkSession.createDataFrame([], schema)
    length, n = first["length"], first["n"]
    totals = [int(r["total"]) for r in sums.where(F.col("length") == length).orderBy("dim").collect()]  # one a dimension
    means = [(2 * t + n) // (2 * n) for t in totals]  # the nearest whole numbers
    whole, rest = np.array(means, dtype=np.int64), np.array([(t - n * m) / n for t, m in zip(totals, means, strict=True)])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(float) - rest

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, length))
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                _, x = whole_rows(batch.column(1).slice(k, ROWS), length, scale, shift)
                held = triangle(np.concatenate([held, centred(x)]))
        yield _matrix(held)

    values, vectors = principal(reduced(rows.mapInArrow(factors, "part long, matrix binary"), length, triangle))
    kept = int((values[:components] > values[0] * 1e-24).sum())
    if not kept:
        return table.sparkSession.createDataFrame([], schema)
    directions = vectors[:, :kept] / np.sqrt(values[:kept] / n)
    explained = values[:kept] / values.sum()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept, kept))
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                w = centred(whole_rows(batch.column(1).slice(k, ROWS), length, scale, shift)[1]) @ directions
                total += w.T @ w
        yield _matrix(total)

    def added(stacked: np.ndarray) -> np.ndarray:
        return stacked.reshape(-1, kept, kept).sum(0)

    covariance = reduced(rows.mapInArrow(products, "part long, matrix binary"), kept, added) / n
    error = float(np.abs(covariance - np.eye(kept)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                at, x = whole_rows(part.column(1), length, scale, shift)
                w = centred(x) @ directions
                row = np.repeat(np.arange(len(at)), kept)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(at[row])), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(at))), pa.array(np.full(len(row), n)),
                    pa.array(exact_squares(x, n, totals)[row]), pa.array(w.ravel()), pa.array(np.tile(explained, len(at))), pa.array(np.full(len(row), error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        release_memory()

    return rows.mapInArrow(project, schema)


def _matrix(matrix: np.ndarray) -> pa.RecordBatch:
    """A task's matrix under the number of its partition."""
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([matrix.tobytes()], pa.binary())], names=["part", "matrix"])


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
