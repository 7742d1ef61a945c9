"""Embedding whitening by Jacobi-Davidson on the covariance, which is never formed.

Vectors become integers x = floor(scale * c) + shift. With S their exact sums, a product of the covariance with a block of vectors is
one pass over the rows: every task adds up (x - S/n)^T ((x - S/n) block) / n and the sums of the tasks meet in a groupBy. On
the driver are only matrices of the dimension times a few blocks.

1. Rayleigh-Ritz on the subspace gives Ritz pairs and residuals. Pairs whose residual has reached double precision are locked, leading ones first.
2. For the others the correction equation (I - QQ')(V - theta I)(I - QQ') t = -r, with Q the locked and current Ritz vectors, is solved by
   a few steps of MINRES, in step for the whole block, so a step is one pass over the rows.
3. The corrections enlarge the subspace, which restarts from its best Ritz vectors when it is full, until all wanted pairs are locked.

Edge cases: rows without an id take part and keep their null id; null vectors and vectors with null or non-finite entries are dropped, as are those whose
integers would leave 53 bits and those of another length than most (ties: the shorter); repeated rows count again; components without variance (with
an eigenvalue below ``NOTHING`` of the trace, thus all with one row or equal rows) are left out, since they can't be scaled to one; a deviation beyond 63
bits is null; an empty table gives no rows; extra columns are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.sizing import cut_lineage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
SPARE = 8  # Ritz vectors beyond the wanted ones
INNER = 6  # MINRES steps for one correction
GROW = 4  # corrections before a restart
PRECISION = 100 * np.finfo(np.float64).eps  # residual over the largest eigenvalue
NOTHING = 1e-12
OUTER = 200
ROWS = 8192  # rows of one matrix product


def integers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x, the integers of the vectors that take part, as doubles (exact below 2^53)."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fits = F.forall("v", lambda c: F.coalesce((F.abs(c) < 2.0**52 / scale) & ~F.isnan(c), F.lit(False)))
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fits)
    rows = cut_lineage(rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("double") + shift).alias("x")))
    most = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("x") == (most["n"] if most else 0))


def _matrices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)


def _summed(rows: DataFrame, task, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tasks of a matrix that ``task`` makes of an iterator of row blocks; None adds nothing."""
    def run(batches):
        found = task(x for _, x in _matrices(batches))
        if found is not None:
            place = np.arange(found.size)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(found.ravel().astype(np.float64))], ["place", "value"])

    total = rows.select("x").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape[0] * shape[1])
    out[total["place"].to_numpy()] = total["value"].to_numpy()
    return out.reshape(shape)


@dataclass
class Fit:
    """n rows with integer sums, the mean, the trace of the covariance; components (dimension, k) and their eigenvalues, falling."""

    n: int
    sums: list
    mean: np.ndarray
    trace: float
    vectors: np.ndarray
    values: np.ndarray


def moments(rows: DataFrame) -> tuple[int, list, float]:
    """Rows, exact sums per dimension and the trace of the covariance."""
    def add(batches):
        n, total = 0, None
        for _, x in _matrices(batches):
            n += len(x)
            # Sums of the high and low halves of the integers are exact.
            high = np.floor(x / 2.0**26)
            pair = np.stack([high, x - high * 2.0**26]).astype(np.int64).sum(1)
            total = pair if total is None else total + pair
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(total.shape[1])), pa.array(total[0]), pa.array(total[1]), pa.array(np.full(total.shape[1], n))],
                ["place", "high", "low", "n"])

    found = rows.select("x").mapInArrow(add, "place long, high long, low long, n long").groupBy("place").agg(
        *(F.sum(c).alias(c) for c in ("high", "low", "n"))).orderBy("place").collect()
    if not found:
        return 0, [], 0.0
    n, sums = found[0]["n"], [r["high"] * 2**26 + r["low"] for r in found]
    mean = _mean(n, sums)

    def spread(blocks):
        parts = [((x - mean) ** 2).sum(0) for x in blocks]
        return np.sum(parts, axis=0)[None] if parts else None

    return n, sums, float(_summed(rows, spread, (1, len(sums))).sum() / n)


def _mean(n: int, sums: list) -> np.ndarray:
    return np.array([s / n for s in sums], np.float64)


def product(rows: DataFrame, n: int, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The covariance times a block of vectors, centred before multiplying."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, block))

    def run(blocks):
        mean, block = shared.value
        total = None
        for x in blocks:
            centred = x - mean
            part = centred.T @ (centred @ block)
            total = part if total is None else total + part
        return total

    return _summed(rows, run, block.shape) / n


def orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the space of ``against``."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        if against is not None:
            block = block - against @ (against.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10]
    return block


def minres(apply, right: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for a symmetric operator on each column of ``right`` at once, from zero, ``steps`` applications."""
    beta = np.linalg.norm(right, axis=0)
    safe = np.where(beta > 0, beta, 1)
    v, before = right / safe, np.zeros_like(right)
    w, w_old, out = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    cs, cs_old, sn, sn_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    eta, size = beta.copy(), np.zeros_like(beta)
    live = beta > 0
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - size * before
        new = np.linalg.norm(p, axis=0)
        # Givens rotations of the last column of the tridiagonal matrix.
        d = cs * alpha - cs_old * sn * size
        r1 = np.hypot(d, new)
        r2 = sn * alpha + cs_old * cs * size
        r3 = sn_old * size
        live = live & (r1 > 1e-14 * np.abs(alpha).max(initial=1e-300))
        r1 = np.where(live, r1, 1)
        cs_old, cs, sn_old, sn = cs, d / r1, sn, new / r1
        w, w_old = (v - r3 * w_old - r2 * w) / r1, w
        out = out + np.where(live, cs * eta, 0) * w
        eta = -sn * eta
        live = live & (new > 1e-14 * (np.abs(alpha) + size))
        before, v, size = v, np.where(live, p / np.where(live, new, 1), 0), new
        if not live.any():
            break
    return out


def jacobi_davidson(multiply, dimension: int, wanted: int, trace: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and unit eigenvectors of the symmetric operator ``multiply`` on blocks of vectors."""
    wanted = min(wanted, dimension)
    width = min(dimension, wanted + SPARE)
    basis = orthonormal(np.random.default_rng(seed).normal(size=(dimension, width)))
    image = multiply(basis)
    smallest = np.inf
    for _ in range(OUTER):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, images = basis @ turn[:, :width], image @ turn[:, :width]
        rest = images - ritz * values[:width]
        size = np.linalg.norm(rest[:, :wanted], axis=0)
        whole = basis.shape[1] == dimension
        open_ = np.nonzero(size > PRECISION * max(abs(values[0]), 1e-300))[0]
        if not len(open_) or trace <= 0:
            break
        if whole:
            # Nothing can be added: once more from the Ritz vectors themselves, until rounding is all that is left.
            if size.max() >= smallest / 2:
                break
            smallest = size.max()
            basis = orthonormal(basis @ turn)
            image = multiply(basis)
            continue
        if basis.shape[1] + len(open_) > width * (1 + GROW):
            basis, image = ritz, images
        theta, against = values[open_], ritz[:, :wanted]

        def corrected(t):
            t = t - against @ (against.T @ t)
            t = multiply(t) - t * theta
            return t - against @ (against.T @ t)

        right = -rest[:, open_]
        right = right - against @ (against.T @ right)
        more = orthonormal(minres(corrected, right, INNER), basis)
        if not more.shape[1]:
            more = orthonormal(np.random.default_rng(seed + basis.shape[1]).normal(size=(dimension, 1)), basis)
        more = more[:, :dimension - basis.shape[1]]
        basis, image = np.hstack([basis, more]), np.hstack([image, multiply(more)])
    return values[:wanted], ritz[:, :wanted]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The whitening of ``rows`` (as of ``integers``); None without rows."""
    n, sums, trace = moments(rows)
    if not n:
        return None
    mean = _mean(n, sums)
    if trace > 0:
        values, vectors = jacobi_davidson(lambda block: product(rows, n, mean, block), len(sums), components, trace)
        some = values > NOTHING * trace
        values, vectors = values[some], vectors[:, some]
    else:
        values, vectors = np.zeros(0), np.zeros((len(sums), 0))
    return Fit(n, sums, mean, trace, vectors, values)


def identity_error(rows: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast((model.mean, model.vectors / np.sqrt(model.values)))

    def middle(blocks):
        mean, factors = shared.value
        parts = [((x - mean) @ factors).sum(0) for x in blocks]
        return np.sum(parts, axis=0)[None] if parts else None

    centre = _summed(rows, middle, (1, k))[0] / model.n

    def square(blocks):
        mean, factors = shared.value
        total = None
        for x in blocks:
            white = (x - mean) @ factors - centre
            part = white.T @ white
            total = part if total is None else total + part
        return total

    return float(np.abs(_summed(rows, square, (k, k)) / model.n - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exact; null beyond 63 bits."""
    whole, total = x.astype(np.int64), np.array(sums, dtype=object)
    if max(n * int(np.abs(whole).max(initial=0)), int(np.abs(total).max())) < 2**61:
        gap = n * whole - total.astype(np.int64)
        if int(np.abs(gap).max(initial=0)) ** 2 * x.shape[1] < 2**63:
            return pa.array((gap * gap).sum(1))
    found = ((n * whole.astype(object) - total) ** 2).sum(1)
    return pa.array([int(f) if f < 2**63 else None for f in found], pa.int64())


def apply(rows: DataFrame, model: Fit | None, error: float = 0.0) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for every row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast((model, model.vectors / np.sqrt(model.values)))

    def run(batches):
        own, factors = shared.value
        explained = own.values / own.trace if own.trace else own.values
        for batch, x in _matrices(batches):
            each = np.repeat(np.arange(len(x)), k)
            white = (x - own.mean) @ factors
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(each), own.n)), _deviations(x, own.n, own.sums).take(pa.array(each)), pa.array(white.ravel()),
                 pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def whiten(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every row that takes part, projected on the leading components of all of them and scaled to variance one."""
    rows = integers(df, vec_id, vector)
    model = fit(rows, components)
    error = identity_error(rows, model) if model is not None and len(model.values) else 0.0
    return apply(rows, model, error)
