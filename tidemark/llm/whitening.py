"""Whitening of embeddings by a one-sided Jacobi SVD.

Blocks of centred rows are compressed to triangular factors, task by task and then in a tree (TSQR). Plane rotations make
the columns of the last factor R orthogonal: their norms are the standard deviations, to full relative accuracy as no
covariance matrix is squared up, and the rotations together are the components. Only R, of dimensions squared, and sums
by dimension come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import Scratch, Sealed

#: Rows of a block that one factorisation takes, factors that a node of the tree takes, sweeps of rotations at most.
BLOCK, FAN_IN, SWEEPS = 4096, 32, 60
_LOW = (1 << 32) - 1


@dataclass
class Model:
    """n: vectors that were fitted; sums by dimension; sd and components (a row each) by falling variance; trace of the
    covariance. identity_error: the largest entry of the whitened vectors' covariance minus the identity."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    sd: np.ndarray = field(default_factory=lambda: np.zeros(0))
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def explained(self) -> list[float]:
        return [float(s * s / self.trace) if self.trace else 0.0 for s in self.sd]


def valid(vector: Column) -> Column:
    """The vector is not null, and none of its entries is null, infinite or not a number."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))


def integers(vector: Column, scale: int = 256) -> Column:
    """Each entry as floor(scale * entry); what is beyond a long is the nearest long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for b in batches:
        flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
        for at in range(0, b.num_rows, BLOCK):
            yield flat[at * dims : (at + BLOCK) * dims].reshape(-1, dims)


def _sums(fit: DataFrame, dims: int) -> list[int]:
    """Exact sums by dimension: high and low halves are added up apart, so that no sum overflows."""

    def run(batches):
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for m in _matrices(batches, dims):
            high, low = high + (m >> 32).sum(0), low + (m & _LOW).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(high), pa.array(low)], names=["dim", "high", "low"])

    rows = fit.mapInArrow(run, "dim long, high long, low long").groupBy("dim").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return [(r["high"] << 32) + r["low"] for r in sorted(rows)]


def _factor(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), mode="r")


def _triangular(fit: DataFrame, mean: np.ndarray, scratch: Scratch) -> np.ndarray:
    """R of the centred rows' factorisation."""
    dims = len(mean)

    def leaf(batches):
        r = None
        for m in _matrices(batches, dims):
            r = _factor(([] if r is None else [r]) + [m.astype(np.float64) - mean])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["r"])

    def node(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [_factor([x.reshape(-1, dims) for x in group["r"]]).ravel()]})

    level, n = scratch.store(fit.mapInArrow(leaf, "r array<double>"), "factors-0"), 0
    while (count := level.count()) > FAN_IN:
        n += 1
        groups = -(-count // FAN_IN)
        # Numbered by place, so that no node gets more than a few times FAN_IN factors.
        numbered = level.withColumn("g", F.monotonically_increasing_id())
        numbered = numbered.withColumn("g", F.pmod(F.xxhash64("g"), F.lit(groups)))
        level = scratch.store(numbered.groupBy("g").applyInPandas(node, "r array<double>"), f"factors-{n}")
    return _factor([np.array(r["r"]).reshape(-1, dims) for r in level.collect()])


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d columns in rounds of disjoint pairs, as in a round-robin tournament."""
    ring = list(range(d + d % 2))
    out = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[:half - 1 : -1], strict=True) if max(a, b) < d]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as rows), by falling value: plane rotations of the columns of r until all
    pairs are orthogonal to the precision of doubles."""
    d = r.shape[1]
    u, v = np.vstack([r, np.zeros((max(0, d - r.shape[0]), d))]), np.eye(d)
    rounds = _rounds(d)
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in rounds:
            a, b = u[:, p], u[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(aa) * np.sqrt(bb)
            turn = np.abs(ab) > 1e-15 * size
            if not turn.any():
                continue
            worst = max(worst, float((np.abs(ab[turn]) / size[turn]).max()))
            zeta = (bb[turn] - aa[turn]) / (2 * ab[turn])
            t = np.zeros(len(p))
            t[turn] = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            u[:, p], u[:, q] = c * a - s * b, s * a + c * b
            a, b = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * a - s * b, s * a + c * b
        if worst < 1e-14:
            break
    norms = np.sqrt((u * u).sum(0))
    order = np.argsort(-norms, kind="stable")
    v = v[:, order].T
    return norms[order], v * np.where(v[np.arange(d), np.abs(v).argmax(1)] < 0, -1.0, 1.0)[:, None]


def _project(m: np.ndarray, model: Model, k: int) -> np.ndarray:
    sd = model.sd[:k]
    least = model.sd[0] * 1e-13 if len(model.sd) else 0.0
    scaled = (model.components[:k] / np.where(sd > least, sd, np.inf)[:, None]).T
    return (m.astype(np.float64) - model.mean) @ scaled


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 4, scale: int = 256) -> Model:
    """The model of the different integer vectors, each counted once, that valid rows have.

    Rows whose vector is shorter than the longest are left out. Without a valid row n is 0. Copies are dropped before the
    shuffle. identity_error is over the components that have a variance, `components` at most.
    """
    s = Sealed(vectors, vector_col)
    x = s.df.where(valid(s[vector_col])).select(integers(s[vector_col], scale).alias("x"))
    with Scratch(vectors.sparkSession, "whitening") as scratch:
        once = scratch.store(x.distinct(), "fit")
        dims = once.agg(F.max(F.size("x"))).first()[0]
        if not dims:
            return Model()
        once = once.where(F.size("x") == dims)
        model = Model(n=once.count(), sums=_sums(once, dims))
        norms, model.components = jacobi(_triangular(once, model.mean, scratch))
        model.sd = norms / np.sqrt(model.n)
        model.trace = float((model.sd**2).sum())
        k = int((model.sd[:components] > model.sd[0] * 1e-13).sum())
        if k:
            names = [f"w{i}" for i in range(k)]

            def run(batches):
                for m in _matrices(batches, dims):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _project(m, model, k).T], names=names)

            w = once.mapInArrow(run, ", ".join(f"{n} double" for n in names))
            pairs = [(i, j) for i in range(k) for j in range(i, k)]
            cov = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
            model.identity_error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return model


def _deviations(m: np.ndarray, model: Model) -> pa.Array:
    """The sum over dimensions of (n * x - sum)^2, exact; null beyond a long."""
    most = model.n * int(max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0))))) + max(map(abs, model.sums))
    if m.shape[1] * most * most < 1 << 63:
        return pa.array(((m * model.n - np.array(model.sums)) ** 2).sum(1))
    exact = [sum((model.n * int(a) - s) ** 2 for a, s in zip(row, model.sums, strict=True)) for row in m]
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def whiten(vectors: DataFrame, model: Model, vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """The rows with a valid vector of the model's dimensions, plus deviation and whitened (array<double>: the centred
    integer vector on each component, over its standard deviation; 0 where a component has no variance), which replace
    columns of these names. Repeated rows and null ids stay."""
    s = Sealed(vectors, vector_col)
    df = s.df.where(valid(s[vector_col])).withColumn("x__", integers(s[vector_col], scale)).where(F.size("x__") == len(model.sums))
    names = [s.inner[n] for n in s.names]
    out = StructType([s.df.schema[n] for n in names] + [StructField("deviation__", LongType()), StructField("whitened__", ArrayType(DoubleType()))])
    k, dims = min(components, len(model.sums)), len(model.sums)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column("x__").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            offsets = pa.array(np.arange(0, (len(m) + 1) * k, k, dtype=np.int32))
            w = pa.ListArray.from_arrays(offsets, pa.array(_project(m, model, k).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [_deviations(m, model), w], names=out.names)

    return s.open(df.mapInArrow(run, out), deviation=F.col("deviation__"), whitened=F.col("whitened__"))
