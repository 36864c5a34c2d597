"""Embedding whitening by Chebyshev-filtered subspace iteration over distributed passes of the centred product XᵀXQ."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Scratch, read_table, small

SCALE, SHIFT = 64, 1_000_000       # an entry c becomes floor(SCALE c) + SHIFT
LIMIT = float(1 << 50)             # entries of this size or more, and non-finite ones, exclude a vector
COMPONENTS = 16
SLOTS = 64                         # partial products that reach the driver at most, whatever the number of tasks
TOLERANCE = 1e-13                  # residual of an accepted eigenpair, relative to the largest eigenvalue
FLOOR = 1e-11                      # ... at which one that no longer falls is accepted too
RANK = 1e-12                       # eigenvalues below this share of the largest one count as zero
GROWTH, MOST_DEGREE = 1e9, 12      # amplification of the largest wanted direction by one filter, and its degree
PROBE = 1e-6                       # excess of a fresh direction over the last accepted eigenvalue that reopens the search
LANCZOS, MOST_ROUNDS = 8, 60


def fixed_point(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vectors`` with ``x`` (long array) and without the rows whose vector is null, empty, or holds a null or an entry that
    is not finite or 2^50 and more. Of vectors of several lengths, those of the most frequent length stay (the longer at a tie)."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) >= LIMIT))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    return (vectors.drop("x").where(v.isNotNull() & (F.size(v) > 0)).where(~bad).withColumn("x", x))


def of_one_length(vectors: DataFrame) -> tuple[DataFrame, int]:
    sizes = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes.d if sizes else 0
    return vectors.where(F.size("x") == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Centre:
    """The number of vectors and the exact sums of their entries."""
    n: int
    sums: list

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly (Python integers where 64 bits are too few)."""
        near = [s // self.n for s in self.sums]
        y = x - np.array(near, np.int64)
        rest = [s - self.n * c for s, c in zip(self.sums, near)]
        if self.n * (int(np.abs(y).max(initial=0)) + 1) >= 1 << 62:
            return y.astype(object) * self.n - np.array(rest, object)
        return y * self.n - np.array(rest, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, exactly."""
        z = self.scaled(x)
        if z.dtype != object and float(np.abs(z).max(initial=0)) ** 2 * z.shape[1] < 2.0 ** 62:
            return (z * z).sum(1).tolist()
        return [sum(int(c) * int(c) for c in row) for row in z]


def centre_of(fit: DataFrame, d: int) -> Centre:
    """Count and sums over the fit list: d + 1 rows a task, summed in Spark as decimals."""
    def run(batches):
        n, total = 0, [0] * d
        for batch in small(batches, 8192):
            x = matrix(batch["x"], d)
            n += len(x)
            low, high = x & ((1 << 30) - 1), x >> 30
            total = [t + int(a) + (int(b) << 30) for t, a, b in zip(total, low.sum(0), high.sum(0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int64()), pa.array(
                [Decimal(n), *map(Decimal, total)], pa.decimal128(38, 0))], names=["dim", "total"])

    got = fit.select("x").mapInArrow(run, "dim long, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total"))
    by = {r.dim: int(r.total) for r in got.collect()}
    return Centre(by.get(-1, 0), [by.get(i, 0) for i in range(d)])


def summed(fit: DataFrame, d: int, centre: Centre, product, shape: tuple[int, int]) -> np.ndarray:
    """Sum of ``product(Z)`` over blocks Z of centred vectors: one partial matrix a task, at most ``SLOTS`` at the driver.

    Partial sums are added in the order of their tasks, so a repeated task changes nothing.
    """
    def run(batches):
        total = np.zeros(shape)
        for batch in small(batches, 8192):
            total += product(centre.centred(matrix(batch["x"], d)))
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task % SLOTS], pa.int64()), pa.array([task], pa.int64()),
                                          pa.array([total.tobytes()], pa.binary())], names=["slot", "task", "part"])

    def add(part):
        part = part.sort_by("task")
        total = np.zeros(shape)
        for own in part["part"]:
            total += np.frombuffer(own.as_py()).reshape(shape)
        return pa.table({"slot": part["slot"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    parts = fit.select("x").mapInArrow(run, "slot long, task long, part binary")
    got = parts.groupBy("slot").applyInArrow(add, "slot long, part binary").toArrow().sort_by("slot")
    return np.sum([np.frombuffer(p.as_py()).reshape(shape) for p in got["part"]], 0) if got.num_rows else np.zeros(shape)


@dataclass
class Whitening:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance of the fit list; ``passes`` over the data."""
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int


class Covariance:
    """V Q = XᵀXQ / n by one pass over the written fit list."""

    def __init__(self, fit: DataFrame, d: int, centre: Centre):
        self.fit, self.d, self.centre, self.passes = fit, d, centre, 0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        self.passes += 1
        return summed(self.fit, self.d, self.centre, lambda z: z.T @ (z @ q), q.shape) / self.centre.n


def lower_end(v: Covariance, rng) -> float:
    """An estimate of the smallest eigenvalue from a few Lanczos steps, lowered by the last step's residual."""
    q = [_unit(rng.standard_normal(v.d))]
    diagonal, side = [], []
    for _ in range(min(LANCZOS, v.d)):
        w = v(q[-1][:, None])[:, 0]
        diagonal.append(float(q[-1] @ w))
        for _ in range(2):
            w = w - np.stack(q, 1) @ (np.stack(q, 1).T @ w)
        side.append(float(np.linalg.norm(w)))
        if side[-1] <= 1e-12 * max(diagonal):
            break
        q.append(w / side[-1])
    k = len(diagonal)
    t = np.diag(diagonal) + np.diag(side[:k - 1], 1) + np.diag(side[:k - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - side[-1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x)


def orthogonal(x: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of ``x`` without its part in ``against``."""
    for _ in range(2):
        x = np.linalg.qr(x - against @ (against.T @ x))[0]
    return x


def chebyshev(v: Covariance, x: np.ndarray, low: float, high: float, top: float, degree: int, locked: np.ndarray) -> np.ndarray:
    """The scaled Chebyshev polynomial of V that stays small on [low, high] and grows above it, applied to ``x``."""
    half, mid = (high - low) / 2, (high + low) / 2
    free = lambda y: y - locked @ (locked.T @ y)
    first = sigma = half / (top - mid)
    y = free(v(x) - mid * x) * (sigma / half)
    for _ in range(1, degree):
        after = 1 / (2 / first - sigma)
        x, y = y, free(v(y) - mid * y) * (2 * after / half) - sigma * after * x
        sigma = after
    return y


def degree_for(top: float, low: float, high: float) -> int:
    """As many steps as amplify the direction of ``top`` by ``GROWTH``, ``MOST_DEGREE`` at most."""
    return int(np.clip(np.log(GROWTH) / np.arccosh((2 * top - high - low) / (high - low)), 1, MOST_DEGREE))


def subspace_iteration(v: Covariance, k: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their eigenvectors.

    Each round filters the block (wanted directions and as many guards), makes it orthonormal (QR) and diagonalises V in it
    (Rayleigh-Ritz). Converged leading pairs are locked and projected out of the block. When k pairs have small residuals,
    a fresh random block beside them is filtered in the same way: if one of its Ritz values exceeds the last accepted
    eigenvalue, a direction was missed and the search goes on with that block; otherwise the result is certified.
    """
    rng = np.random.default_rng(seed)
    width = min(v.d, 2 * k)
    locked, values = np.zeros((v.d, 0)), np.zeros(0)
    x, low, certified, before = orthogonal(rng.standard_normal((v.d, width)), locked), None, width == v.d, np.inf
    for _ in range(MOST_ROUNDS):
        y = v(x)
        theta, u = np.linalg.eigh((x.T @ y + y.T @ x) / 2)
        order = np.argsort(-theta)
        theta, x, y = theta[order], x @ u[:, order], y @ u[:, order]
        largest = max([*values, *theta, 0.0])
        if largest <= 0:
            return np.zeros(0), np.zeros((v.d, 0))
        if len(values) == k:                               # the block was the probe
            if theta[0] <= values.min() * (1 + PROBE) + RANK * largest:
                certified = True
                break
            keep = values > theta[0]
            x = orthogonal(np.concatenate([x, locked[:, ~keep]], 1), locked[:, keep])
            locked, values, before = locked[:, keep], values[keep], np.inf
            continue
        residual = np.linalg.norm(y - x * theta, axis=0) / largest
        least = TOLERANCE if residual[0] < before / 2 else FLOOR
        done = 0
        while done < len(theta) and len(values) + done < k and residual[done] <= least:
            done += 1
        before = residual[done] if done < len(theta) else np.inf
        locked, values = np.concatenate([locked, x[:, :done]], 1), np.concatenate([values, theta[:done]])
        x, theta = x[:, done:], theta[done:]
        if len(values) == k:
            if certified or v.d == k:
                certified = True
                break
            x, top = orthogonal(rng.standard_normal((v.d, min(k, v.d - k))), locked), values.min()
        else:
            top = theta[0]
        low = lower_end(v, rng) if low is None else low
        high = max(float(theta[-1]) if len(theta) else values.min(), 1e-9 * largest)
        floor = min(low, 0.9 * high)
        if top > high * (1 + 1e-12):
            x = orthogonal(chebyshev(v, x, floor, high, top, degree_for(top, floor, high), locked), locked)
    if not certified:
        raise RuntimeError("subspace iteration did not converge")
    order = np.argsort(-values)
    return values[order], locked[:, order]


def fit_whitening(vectors: DataFrame, d: int, scratch: Scratch, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct ``x`` of ``vectors`` (each once), or None if there is none.

    The distinct vectors are written once and read by every pass; a pass sends a d x (2 components) matrix to the driver.
    Components whose eigenvalue is zero (fewer distinct vectors than dimensions, constant dimensions) are left out.
    """
    fit = scratch.write(vectors.select("x").distinct(), "fit")
    centre = centre_of(fit, d)
    if not centre.n:
        return None
    v = Covariance(fit, d, centre)
    values, q = subspace_iteration(v, min(components, d))
    keep = values > RANK * values.max(initial=0)
    values, q = values[keep], q[:, keep]
    k = len(values)
    if not k:
        return None
    w = q / np.sqrt(values)

    def check(z):
        y = z @ w
        return np.concatenate([y.T @ y, np.full((1, k), float((z * z).sum()))])

    got = summed(fit, d, centre, check, (k + 1, k)) / centre.n
    return Whitening(centre, values, q, values / got[k, 0], float(np.abs(got[:k] - np.eye(k)).max()), v.passes + 1)


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``vectors`` (with ``x``) and ``deviation`` (decimal), ``whitened`` (array of doubles, one per component)."""
    d, w, centre = len(model.vectors), model.vectors / np.sqrt(model.values), model.centre
    names = vectors.columns
    at = names.index("x")

    def run(batches):
        for batch in small(batches, 8192):
            x = matrix(batch.column(at), d)
            far = pa.array([Decimal(t) for t in centre.deviation(x)], pa.decimal128(38, 0))
            flat = (centre.centred(x) @ w).ravel()
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, far, pa.ListArray.from_arrays(offsets, pa.array(flat))],
                                             names=[*batch.schema.names, "deviation", "whitened"])

    rows = vectors.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([*rows.schema.fields, T.StructField("deviation", T.DecimalType(38, 0)),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema).toDF(*names, "deviation", "whitened")


def whitened_rows(embeddings: DataFrame, scratch: Scratch, components: int = COMPONENTS) -> DataFrame:
    """One row per kept vector and component: the contract's columns.

    Nulls: a vector that is null, empty, or holds a null or non-finite entry is dropped; a null ``vec_id`` is kept. Repeated
    rows give repeated results, but count once in the fit. An empty table, or one distinct vector, has no component and
    gives no row. A ``deviation`` beyond a long is null. Vectors may be of any length, one at a time for the whole table (see
    ``fixed_point``). Other columns are not read, whatever their names.
    """
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    kept, d = of_one_length(fixed_point(embeddings.select("vec_id", "embedding")).select("vec_id", "x"))
    model = fit_whitening(kept, d, scratch, components) if d else None
    if model is None:
        return embeddings.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*[F.lit(float(e)) for e in model.explained])
    rows = whiten(kept, model)
    return (rows.select("vec_id", F.lit(model.centre.n).cast("long").alias("n"), F.expr("try_cast(deviation as long)").alias("deviation"),
                        F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                    F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(read_table(spark, sf_dir, "embeddings"), Scratch(spark, "whiten"))
