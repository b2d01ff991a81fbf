"""PCA whitening of embeddings by Jacobi-Davidson, without a covariance matrix.

Entries become integers, so sums are exact and rows are centred before anything is multiplied: with S = n*q + r, a centred
entry is (x - q) - r/n, which rounds once. The covariance is only ever applied: a pass over the rows adds up
centred' (centred W) for a block W of a few columns, a partial sum a task. The driver holds vectors and matrices of
dimensions x some dozens, never rows.

Jacobi-Davidson keeps a subspace. Its Ritz pairs of greatest value are improved by corrections t that solve, for all
targets at once, (I - PP')(V - theta)(I - PP') t = -r, P being the locked vectors and the target; a few steps of MINRES
do, one pass each. A pair is locked when its residual, from a product made anew, is at double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT = 1024, 100000  # fixed values: x = floor(1024 * c) + 100000
LIMIT = 1 << 40
EPS = float(np.finfo(float).eps)


def blocks(embeddings: DataFrame, column: str = "embedding", entries: int = 1 << 17) -> DataFrame:
    """(dims, rows, ids, x): usable vectors as integers, up to `entries` of them in one block's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            flat, ends = lists.values.cast(pa.float64()), lists.offsets.to_numpy()
            missing = flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
            bad = np.concatenate(([0], np.cumsum(missing | ~np.isfinite(values))))
            dims = np.diff(ends)
            good = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]]) & (dims > 0)
            for d in np.unique(dims[good]).tolist():
                at = np.flatnonzero(good & (dims == d))
                step = max(1, entries // d)
                for lo in range(0, len(at), step):
                    some = at[lo : lo + step]
                    x = np.floor(SCALE * values[ends[some][:, None] + np.arange(d)])
                    x = np.clip(x, -LIMIT, LIMIT).astype(np.int64) + SHIFT
                    x = x.astype(np.int32) if np.abs(x).max() < 1 << 31 else x
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d], pa.int64()), pa.array([len(some)], pa.int64()), pa.array([ids.take(pa.array(some)).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())],
                        names=["dims", "rows", "ids", "x"],
                    )

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), column).mapInArrow(run, "dims long, rows long, ids array<long>, x binary")


def _matrix(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * rows * dims else np.int64).reshape(rows, dims)


class Centre:
    """Counts and exact sums of the rows, and centred blocks."""

    def __init__(self, n: int, dims: int, sums: list[int], squares: list[int], most: int) -> None:
        self.n, self.dims, self.most = n, dims, most
        self.q = np.array([s // n for s in sums], np.int64)
        self.r = np.array([s % n for s in sums], np.int64)
        self.trace = float(sum(Fraction(n * q - s * s, n * n) for s, q in zip(sums, squares, strict=True)))

    def block(self, data: bytes, rows: int) -> np.ndarray:
        return (_matrix(data, rows, self.dims) - self.q) - self.r / self.n

    def deviations(self, data: bytes, rows: int) -> list[int] | np.ndarray:
        """Sum of (n * x - S)^2 of each row, exact."""
        x = _matrix(data, rows, self.dims) - self.q
        if self.dims * (self.n * (self.most + 1)) ** 2 >= 1 << 63:
            x = x.astype(object)
        return ((self.n * x - self.r) ** 2).sum(axis=1)


def measure(table: DataFrame) -> Centre | None:
    """Sums over the blocks of the commonest number of dimensions, the greater of two equally common; None without rows."""
    first = table.groupBy("dims").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if first is None:
        return None
    dims, n = first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares, low, high = [0] * dims, [0] * dims, None, None
        for batch in batches:
            for rows, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = _matrix(data.as_py(), rows, dims).astype(np.int64)
                sums = [a + b for a, b in zip(sums, x.sum(axis=0).tolist(), strict=True)]
                small = max(abs(int(x.min())), abs(int(x.max()))) ** 2 * rows < 1 << 63
                squares = [a + int(b) for a, b in zip(squares, ((x if small else x.astype(object)) ** 2).sum(axis=0), strict=True)]
                low, high = x.min() if low is None else min(low, x.min()), x.max() if high is None else max(high, x.max())
        if low is not None:
            exact = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int64()), pa.array(sums, exact), pa.array(squares, exact), pa.array([int(low)] * dims), pa.array([int(high)] * dims)], names=["i", "s", "q", "low", "high"])

    parts = table.where(F.col("dims") == dims).select("rows", "x").mapInArrow(run, "i long, s decimal(38,0), q decimal(38,0), low long, high long")
    rows = parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    rows.sort(key=lambda x: x.i)
    return Centre(n, dims, [int(x.s) for x in rows], [int(x.q) for x in rows], max(x.high for x in rows) - min(x.low for x in rows))


def summed(table: DataFrame, centre: Centre, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of part(centred block), a matrix of `shape`, over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for rows, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += part(centre.block(data.as_py(), rows))
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int64()), *(pa.array(total[:, k]) for k in range(shape[1]))], names=["i", *(f"v{k}" for k in range(shape[1]))])

    schema = "i long, " + ", ".join(f"v{k} double" for k in range(shape[1]))
    rows = table.where(F.col("dims") == centre.dims).select("rows", "x").mapInArrow(run, schema)
    found = rows.groupBy("i").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(shape[1]))).collect()
    return np.array([r[1:] for r in sorted(found)])


def _orthonormal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of t's columns without what lies in the bases given; columns that vanish are left out."""
    for _ in range(2):
        for basis in against:
            t = t - basis @ (basis.T @ t)
        kept = []
        for k in range(t.shape[1]):
            v, before = t[:, k], np.linalg.norm(t[:, k])
            for _ in range(2):
                for u in kept:
                    v = v - u * (u @ v)
            after = np.linalg.norm(v)
            if after > 1e-8 * before and before > 0:
                kept.append(v / after)
        t = np.stack(kept, axis=1) if kept else t[:, :0]
    return t


def corrections(apply: Callable[[np.ndarray], np.ndarray], locked: np.ndarray, x: np.ndarray, theta: np.ndarray, r: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """Solves the projected correction equation of every column by MINRES from zero, all columns in one product a step."""

    def project(w: np.ndarray) -> np.ndarray:
        w = w - locked @ (locked.T @ w)
        return w - x * (x * w).sum(axis=0)

    k = x.shape[1]
    v, t = project(-r), np.zeros_like(x)
    beta = np.linalg.norm(v, axis=0)
    start, safe = beta.copy(), lambda b: np.where(b > 0, b, 1.0)
    v = v / safe(beta)
    before, w1, w2 = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    eta, cs, sn, delta_, eps_ = beta.copy(), np.full(k, -1.0), np.zeros(k), np.zeros(k), np.zeros(k)
    last = np.zeros(k)
    live = beta > 0
    for _ in range(steps):
        if not live.any():
            break
        av = project(apply(v) - v * theta)
        alpha = (v * av).sum(axis=0)
        nxt = project(av - alpha * v - last * before)
        following = np.linalg.norm(nxt, axis=0)
        # the rotation before this one on the new column of the tridiagonal, then a new one
        delta = cs * delta_ + sn * alpha
        gamma = sn * delta_ - cs * alpha
        eps_next, delta_next = sn * following, -cs * following
        rho = np.hypot(gamma, following)
        cs, sn = gamma / safe(rho), following / safe(rho)
        w = np.where(live, (v - delta * w2 - eps_ * w1) / safe(rho), 0)
        t += np.where(live, cs * eta, 0) * w
        eta = sn * eta
        w1, w2, eps_, delta_ = w2, w, eps_next, delta_next
        live = live & (np.abs(eta) > tol * start) & (following > EPS * np.abs(theta).max()) & (rho > 0)
        before, v, last = v, nxt / safe(following), following
    return t


def eigenpairs(apply: Callable[[np.ndarray], np.ndarray], dims: int, k: int, scale: float, seed: int = 5, spare: int = 2, inner: int = 3, room: int = 128, tol: float = 64 * EPS, turns: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest eigenvalues, their unit eigenvectors and residuals, of the symmetric operator `apply` of blocks.

    scale is the operator's trace. The subspace grows to `room` columns, then starts again from its best ones. Raises ArithmeticError if residuals don't reach tol * the greatest eigenvalue.
    """
    rng = np.random.default_rng(seed)
    none = np.zeros((dims, 0))
    locked, values, residuals = none, [], []
    q = _orthonormal(rng.standard_normal((dims, min(dims, k + spare))))
    aq = apply(q)
    for turn in range(turns):
        theta, s = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        order = np.argsort(-theta)
        theta, x, ax = theta[order], q @ s[:, order], aq @ s[:, order]
        q, aq = x, ax
        want = k - len(values)
        top = max([*values[:1], theta[0], scale * EPS])
        away = np.linalg.norm(ax[:, :want] - x[:, :want] * theta[:want], axis=0)
        ready = 0
        while ready < min(want, len(away)) and away[ready] <= tol * top:
            ready += 1
        if ready:
            # proved on a product made anew, of a basis that is orthonormal to the last digit
            fresh = _orthonormal(x[:, :ready], locked)
            af = apply(fresh)
            theta_f, s = np.linalg.eigh((fresh.T @ af + af.T @ fresh) / 2)
            fresh, af, theta_f = fresh @ s[:, ::-1], af @ s[:, ::-1], theta_f[::-1]
            away = np.linalg.norm(af - fresh * theta_f, axis=0)
            held = 0
            while held < ready and away[held] <= tol * top:
                held += 1
            locked = np.concatenate([locked, fresh[:, :held]], axis=1)
            values += theta_f[:held].tolist()
            residuals += away[:held].tolist()
            q = np.concatenate([fresh[:, held:], x[:, ready:]], axis=1)
            aq = np.concatenate([af[:, held:], ax[:, ready:]], axis=1)
            if len(values) == k:
                by = np.argsort(-np.array(values), kind="stable")
                return np.array(values)[by], locked[:, by], np.array(residuals)[by]
            theta, s = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2) if q.shape[1] else (np.zeros(0), np.zeros((0, 0)))
            q, aq, theta = q @ s[:, ::-1], aq @ s[:, ::-1], theta[::-1]
            want = k - len(values)
        if q.shape[1] + want > max(room, 2 * k) and q.shape[1] > want + spare:
            keep = min(want + spare, q.shape[1])
            q, aq, theta = q[:, :keep], aq[:, :keep], theta[:keep]
        x, targets = q[:, :want], theta[:want]
        r = aq[:, :want] - x * targets
        t = corrections(apply, locked, x, targets, r, inner, 2.0 ** -(turn + 2)) if x.shape[1] else none
        t = _orthonormal(np.concatenate([t, rng.standard_normal((dims, 1))], axis=1), locked, q)[:, : max(0, dims - locked.shape[1] - q.shape[1])]
        if t.shape[1]:
            q, aq = np.concatenate([q, t], axis=1), np.concatenate([aq, apply(t)], axis=1)
        else:
            q = _orthonormal(q, locked)
            aq = apply(q)
    raise ArithmeticError("residuals have not reached double precision")


def whiten(embeddings: DataFrame, k: int = 8, column: str = "embedding", **solver) -> DataFrame:
    """vec_id, component (1 to k), n, deviation (decimal), whitened, explained, identity_error and residual of every usable
    vector.

    Vectors that are null, empty or hold null or non-finite entries are left out, and those of another length than the
    commonest (of equally common ones the longest). An entry c is x = floor(1024 * c) + 100000, c within 2^30 either way
    (beyond, it is taken as that). Components are unit eigenvectors of x's covariance by falling eigenvalue e; where equal
    eigenvalues leave a choice, any. Those without variance (e below 1e-13 of the trace) aren't returned, so equal vectors,
    or one, give no rows. residual is |V u - e u| / e1. Rows that repeat are rows of their own, a null vec_id stays null.
    An empty table gives no rows. Other columns are ignored.
    """
    table = written(blocks(embeddings, column), "blocks", merge=False)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, residual double"
    centre = measure(table)
    if centre is None or centre.trace == 0:
        return embeddings.sparkSession.createDataFrame([], schema)
    n = centre.n
    apply = lambda w: summed(table, centre, lambda c: c.T @ (c @ w), w.shape) / n
    values, vectors, residuals = eigenpairs(apply, centre.dims, min(k, centre.dims), centre.trace, **solver)
    real = values > 1e-13 * centre.trace
    values, residuals, loading = values[real], residuals[real] / values[0], vectors[:, real] / np.sqrt(values[real])
    k = len(values)

    def moments(c: np.ndarray) -> np.ndarray:
        y = c @ loading
        return np.concatenate([y.T @ y, y.sum(axis=0)[None]])

    m = summed(table, centre, moments, (k + 1, k)) / n
    error = float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = data.as_py()
                at = pa.array(np.repeat(np.arange(rows), k))
                y = centre.block(data, rows) @ loading
                deviation = pa.array([int(v) for v in centre.deviations(data, rows)], pa.decimal128(38, 0))
                tile = lambda v: pa.array(np.tile(v, rows))
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(at), tile(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(rows * k, n)), deviation.take(at), pa.array(y.reshape(-1)), tile(values / centre.trace), pa.array(np.full(rows * k, error)), tile(residuals)],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"],
                )

    return table.where(F.col("dims") == centre.dims).select("rows", "ids", "x").mapInArrow(run, schema)
