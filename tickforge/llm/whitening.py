"""Whitening of vectors by an exact covariance.

Each entry becomes an integer. A task splits its integers into limbs of 16 bits and multiplies limb matrices by float64
BLAS: a product of two limbs is under 2**32 and at most SLICE rows are added, so every float64 sum is under 2**53
and exact. The products are put together as integers of many digits; digits are added over all tasks by Spark, entry by
entry. A column of ones among the vectors gives the sums and the number of vectors by the same products. The driver gets
D * (D + 1) / 2 entries for D dimensions, whatever the number of vectors, forms n * G - S * S' in Python's integers, and
decomposes it. So centring loses no digits, however large the mean is beside the deviations.

A task's memory is about 60 * D * D bytes and one slice of rows.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .worker import begin

COMPONENTS = 8
#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024.0, 100_000
LIMB, SLICE = 16, 8192
#: Digits of 32 bits of an entry of the sum of products; the last one has the sign.
DIGITS = 6
_MOST = float(1 << 62)
_SUMS = "i int, j int, " + ", ".join(f"d{k} long" for k in range(DIGITS))


def vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Integers of the vectors that count, and which rows those are."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.list_flatten(column), np.nan).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        c = flat.reshape(-1, dims)
    else:
        c = np.zeros((len(lengths), dims))
        starts = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(len(lengths)), lengths)
        c[row, np.arange(len(flat)) - starts[row]] = flat
    good = np.isfinite(c).all(axis=1) & column.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c[good] * SCALE), -_MOST, _MOST - 1024).astype(np.int64) + SHIFT, good


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of limb[k] << 16 k; all limbs but the last are in [0, 2**16), that one is at least -2**15 and under 2**15."""
    top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    n = -(-(top.bit_length() + 1) // LIMB)
    return [(x >> (LIMB * k) & 0xFFFF if k < n - 1 else x >> (LIMB * k)).astype(np.float64) for k in range(n)]


class Products:
    """X' X of integer matrices with a column of ones, as digits of 16 bits."""

    def __init__(self, dims: int):
        self.digits = np.zeros((2 * DIGITS, dims + 1, dims + 1), np.int64)

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), SLICE):
            part = limbs(np.hstack([x[at:at + SLICE], np.ones((len(x[at:at + SLICE]), 1), np.int64)]))
            for k, a in enumerate(part):
                for m in range(k, len(part)):
                    g = (a.T @ part[m]).astype(np.int64)
                    self.digits[k + m] += g if m == k else g + g.T
            for k in range(2 * DIGITS - 1):
                carry = self.digits[k] >> LIMB
                self.digits[k] -= carry << LIMB
                self.digits[k + 1] += carry

    def batch(self) -> pa.RecordBatch:
        i, j = np.triu_indices(self.digits.shape[1])
        wide = [(self.digits[2 * k] + (self.digits[2 * k + 1] << LIMB))[i, j] for k in range(DIGITS)]
        return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, wide)], names=[c.split()[0] for c in _SUMS.split(", ")])


class Whitening:
    """n, sums and covariance of integer vectors, and the projection on the first components; part of each task's closure, of D * components numbers."""

    def __init__(self, dims: int, sums: list[tuple], components: int):
        g = np.zeros((dims + 1, dims + 1), object)
        for i, j, *d in sums:
            g[i, j] = g[j, i] = sum(v << (32 * k) for k, v in enumerate(d))
        self.dims, self.n, self.s = dims, g[dims, dims], [int(v) for v in g[dims, :dims]]
        s = np.array(self.s, object)
        spread = g[:dims, :dims] * self.n - np.outer(s, s)
        self.trace = float(sum(spread[k, k] for k in range(dims)) / self.n**2)
        value, unit = np.linalg.eigh((spread / self.n**2).astype(np.float64))
        k = min(components, dims)
        self.value, unit = value[::-1][:k], unit[:, ::-1][:, :k]
        unit = unit * np.where(np.take_along_axis(unit, np.abs(unit).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
        self.alive = self.value > dims * np.finfo(float).eps * max(self.trace, 0.0)
        self.project = unit / np.sqrt(np.where(self.alive, self.value, np.inf))
        self.explained = np.clip(self.value / self.trace, 0.0, 1.0) if self.trace > 0 else np.zeros(k)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they fit."""
        most = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(map(abs, self.s)) if x.size else 0
        if most < 1 << 62:
            return x * np.int64(self.n) - np.array(self.s, np.int64)
        return x.astype(object) * self.n - np.array(self.s, object)

    @staticmethod
    def squares(y: np.ndarray) -> list[int]:
        """Exact sums of squares of the rows of y."""
        if y.dtype == object:
            return [sum(v * v for v in row) for row in y.tolist()]
        part = [y & 0xFFFFFF, y >> 24 & 0xFFFFFF, y >> 48]
        out = [0] * len(y)
        for a in range(3):
            for b in range(a, 3):
                for k, v in enumerate((part[a] * part[b]).sum(axis=1).tolist()):
                    out[k] += v << (24 * (a + b) + (a != b))
        return out


def fit_whitening(embeddings: DataFrame, components: int = COMPONENTS, *, vec_col: str = "embedding") -> Whitening | None:
    """The whitening of all vectors that are whole; None if there are none."""
    narrow = embeddings.select(F.col(vec_col).alias("embedding"))
    dims = narrow.agg(F.max(F.size(F.col("embedding")))).first()[0]
    if dims is None or dims < 1:
        return None

    def run(batches):
        begin("whitening")
        total, any_rows = Products(dims), False
        for batch in batches:
            x, _ = vectors(batch.column(0), dims)
            any_rows |= len(x) > 0
            total.add(x)
        if any_rows:
            yield total.batch()

    sums = narrow.mapInArrow(run, _SUMS).groupBy("i", "j").agg(*(F.sum(f"d{k}") for k in range(DIGITS))).collect()
    return Whitening(dims, sums, components) if sums else None


def whiten(embeddings: DataFrame, model: Whitening, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Columns id_col, deviation decimal(38, 0) and whitened array<double> of the rows whose vector is whole."""
    kind = embeddings.schema[id_col].dataType.simpleString()

    def run(batches):
        begin("whitening")
        for batch in batches:
            x, good = vectors(batch.column(1), model.dims)
            y = model.deviations(x)
            w = y.astype(np.float64) / float(model.n) @ model.project
            squares = [Decimal(v) if v < 10**38 else None for v in model.squares(y)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(squares, pa.decimal128(38, 0)), flat], names=["id", "deviation", "whitened"])

    out = embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding")).mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")
    return out.select(F.col("id").alias(id_col), "deviation", "whitened")


def identity_error(white: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity, over components that are not null."""
    alive = np.flatnonzero(model.alive).tolist()
    pairs = [(a, b) for k, a in enumerate(alive) for b in alive[k:]]
    if not pairs:
        return 0.0
    got = white.agg(*(F.covar_pop(F.col("whitened")[a], F.col("whitened")[b]) for a, b in pairs)).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(got, pairs))


def whitened_components(embeddings: DataFrame, components: int = COMPONENTS, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row per whole vector and component: id_col, component, n, deviation, whitened, explained, identity_error, deviation_exact.

    Rows go whose vector is null or holds null, infinite or not-a-number entries. A vector with fewer entries than the longest
    has zeros in the rest; entries of 2**62 and more count as 2**62. There are as many components as dimensions, at
    most `components`. deviation is null where it is too large for a long (sums of squares grow with the square of n);
    deviation_exact has 38 digits. A component without variance (fewer different vectors than components, or one
    vector) has whitened 0 and no part in identity_error. Of equal eigenvalues any unit vectors are taken, the same for
    all rows; the largest entry of each is positive. Rows with null or repeated ids count as others do, repeated rows as
    often as they are there; other columns, whatever their names, are ignored. An empty table gives no rows.
    """
    model = fit_whitening(embeddings, components, vec_col=vec_col)
    kind = embeddings.schema[id_col].dataType.simpleString()
    if model is None:
        return embeddings.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    white = Scratch(embeddings.sparkSession, "whitening").table(whiten(embeddings, model, id_col=id_col, vec_col=vec_col), "rows")
    error = identity_error(white, model)
    rows = white.select(F.col(id_col).alias(id_col), F.col("deviation").alias("deviation_exact"), F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*(F.lit(float(v)) for v in model.explained))
    return rows.select(id_col, (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation_exact AS bigint)").alias("deviation"),
                       "whitened", explained[F.col("place")].alias("explained"), F.lit(float(error)).alias("identity_error"), "deviation_exact")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings."""
    return whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
