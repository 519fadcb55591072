"""Embedding whitening (operator 11): leading components by a randomised range finder, then rows of unit covariance.

Entries become whole numbers, and the fit list is each distinct vector once, checkpointed. A pass over its rows multiplies the covariance
V (rows centred first) with a block Q of d x l; tasks add up d x l numbers each, which are added in a tree. The first block is random, with
some columns more than components are asked for, and each pass's product, made orthonormal, is the next block. After each pass
Rayleigh-Ritz gives components and residuals |V u - e u|. Where passes no longer bring these under RESIDUAL, the block is expanded to the
full dimension, for which Rayleigh-Ritz is exact. Nothing but blocks and sums, whose size is that of the dimension, reaches the driver.

Results for odd input: vectors that are null or hold null, NaN or infinite entries are left out; entries past 2**46 count as 2**46;
shorter vectors count as ending with zeros; repeated rows and null vec_ids are kept; directions with less than FLAT of the largest variance give no
component, so one distinct vector, or none, gives no rows; a deviation beyond 64 bits is null; further columns are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

SCALE, SHIFT = 64, 1_000_000
#: The largest scaled entry.
MOST = float(1 << 52)
COMPONENTS = 16
OVERSAMPLING = 10
PASSES = 8
#: Residual at which a component counts as found, and the variance under which a direction counts as flat, as shares of the largest variance.
RESIDUAL = 1e-13
FLAT = 1e-10
SEED = 11


@dataclass
class Whitening:
    """n distinct vectors with sums S = n * whole + rest; vectors: d x k unit components; values: their variances; trace: all variance."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    full: bool

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean: whole numbers are subtracted first, so nothing is lost to the shift."""
        return centred(x, self.n, self.whole, self.rest)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n * x - S)**2 of each row, exact."""
        near = x - self.whole
        if (float(np.abs(near).max(initial=0)) + 1) * self.n * np.sqrt(x.shape[1] + 1) < 2**31:
            z = near * self.n - self.rest
            return (z * z).sum(axis=1).tolist()
        z = near.astype(object) * self.n - self.rest.astype(object)
        return [int(v) for v in (z * z).sum(axis=1)]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def centred(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - whole).astype(np.float64) - rest / n


def scaled(vector: Column | str) -> Column:
    """Whole numbers of a vector, null if it has entries without a finite value."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    broken = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(MOST)), F.lit(-MOST))).cast("long") + SHIFT)
    return F.when(~broken, whole)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of an Arrow list column; shorter ones are filled with what zeros become."""
    lengths = np.asarray(pc.list_value_length(column)).astype(np.int64)
    flat = np.asarray(column.flatten(), dtype=np.int64)
    if (lengths == d).all():
        return flat.reshape(-1, d)
    out = np.full((len(lengths), d), SHIFT, dtype=np.int64)
    out[np.arange(d) < lengths[:, None]] = flat
    return out


def summed(fit: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of part(rows) over all batches of rows; None if there are none. Each task adds up its own, and the tasks' sums are added in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(matrix(batch.column(0), d))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["sum"])

    add = lambda a, b: b if a is None else a if b is None else a + b
    return fit.select("x").mapInArrow(run, "sum binary").rdd.map(lambda r: pickle.loads(r["sum"])).treeAggregate(None, add, add, depth=3)


def counted_sums(x: np.ndarray) -> np.ndarray:
    """The number of rows and the sums of their entries, as Python's whole numbers."""
    small = float(np.abs(x).max(initial=0)) * len(x) < 2**62
    return np.array([len(x), *(x.sum(axis=0).tolist() if small else x.astype(object).sum(axis=0))], dtype=object)


def rayleigh_ritz(block: np.ndarray, product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Variances and components from an orthonormal block and V times it, and the largest residual as a share of the largest variance."""
    small = block.T @ product
    values, turns = np.linalg.eigh((small + small.T) / 2)
    values, turns = values[::-1][:k], turns[:, ::-1][:, :k]
    vectors = block @ turns
    error = np.linalg.norm(product @ turns - vectors * values, axis=0).max(initial=0.0)
    return values, vectors, float(error / values[0]) if len(values) and values[0] > 0 else 0.0


def fit_whitening(fit: DataFrame, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = SEED) -> Whitening | None:
    """The whitening of a table of distinct vectors (x: array of long), which is read several times; None if nothing varies."""
    d = fit.agg(F.max(F.size("x"))).first()[0]
    sums = summed(fit, d, counted_sums) if d else None
    if sums is None:
        return None
    n = int(sums[0])
    whole = np.array([int(s) // n for s in sums[1:]], dtype=np.int64)
    rest = np.array([int(s) - n * int(w) for s, w in zip(sums[1:], whole, strict=True)], dtype=np.int64)

    def product(block: np.ndarray | None) -> tuple[np.ndarray, float]:
        """V times a block (None: V itself), and V's trace."""

        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, whole, rest)
            return np.append((c.T @ (c if block is None else c @ block)).ravel(), (c * c).sum())

        total = summed(fit, d, part) / n
        return total[:-1].reshape(d, -1), float(total[-1])

    width, full = components + oversampling, True
    if width < d:
        block = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
        before = np.inf
        for _ in range(1 + passes):
            found, trace = product(block)
            values, vectors, error = rayleigh_ritz(block, found, components)
            full = error > RESIDUAL
            if not full or trace == 0 or error > before / 4:  # found, or further passes gain too little
                break
            before, block = error, np.linalg.qr(found)[0]
    if full:
        found, trace = product(None)
        values, vectors, _ = rayleigh_ritz(np.eye(d), found, components)
    kept = values > max(FLAT * values[0], 0.0)
    if not kept.any():
        return None
    model = Whitening(n, whole, rest, vectors[:, kept], values[kept], trace, 0.0, full)
    k = int(kept.sum())

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.whiten(x)
        return np.append((w.T @ w).ravel(), w.sum(axis=0))

    total = summed(fit, d, moments) / n
    covariance = total[: k * k].reshape(k, k) - np.outer(total[k * k :], total[k * k :])
    model.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return model


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(key, deviation, whitened: array of double) of all rows with finite vectors, and the whitening."""
    rows = vectors.select(F.col(key).alias("key"), scaled(vector).alias("x")).filter("x IS NOT NULL")
    fit = checkpointed(rows.select("x").distinct())
    model = fit_whitening(fit, components)
    kind = dict(rows.dtypes)["key"]
    schema = f"{key} {kind}, deviation long, whitened array<double>"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    d = len(model.whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), d)
            w = model.whiten(x)
            offsets = pa.array(np.arange(0, w.size + 1, max(w.shape[1], 1), dtype=np.int32))
            deviation = pa.array([v if v < 2**63 else None for v in model.deviation(x)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=[key, "deviation", "whitened"])

    return rows.mapInArrow(run, schema), model


def op11_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitened(table(spark, sf_dir, "embeddings"))
    shares = [] if model is None else (model.values / model.trace).tolist()
    explained = F.array(*[F.lit(s) for s in shares]).cast("array<double>")
    each = rows.select("vec_id", F.posexplode("whitened").alias("at", "whitened"), "deviation")
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
