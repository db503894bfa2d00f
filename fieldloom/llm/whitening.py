"""Embedding whitening: covariances from exact squares of dimensions and of sums of two (polarisation), then eigh."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

SPLIT = 10**18  #: partial sums are pairs (high, low) of this base, so that no decimal of Spark overflows
SUMS = "width int, i int, j int, rows bigint, high decimal(38,0), low decimal(38,0)"


BEYOND = 2.0**61  #: a number that the grid would take this far, beyond what long sums hold, counts as broken


def grid(docs: DataFrame, vector_col: str, scale: int, offset: int, name: str = "x") -> DataFrame:
    """Rows whose vector is there, not empty and all of finite numbers, with name: floor(scale * entry) + offset, as long."""
    fine = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < BEYOND))
    rows = docs.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).filter(fine)
    return rows.withColumn(name, F.transform(vector_col, lambda c: F.floor(c.cast("double") * scale).cast("bigint") + offset))


def squares(u: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """The exact sums of u ** 2 along an axis, as (high, low) of SPLIT, for 64-bit u of less than 2 ** 62, or Python's integers."""
    if u.dtype == object:
        total = np.asarray((u * u).sum(axis), object)
        return total // SPLIT, total % SPLIT
    top = int(np.abs(u).max(initial=0))
    if top * top * max(1, u.shape[axis]) < 2**62:
        total = np.square(u).sum(axis, dtype=np.int64)
        return total // SPLIT, total % SPLIT
    a, b = u >> 31, u & (2**31 - 1)
    out = 0
    for part, shift in ((a * a, 62), (a * b, 32), (b * b, 0)):  # each below 2 ** 62; halves of it add up without loss
        high, low = (part >> 31).sum(axis, dtype=np.int64), (part & (2**31 - 1)).sum(axis, dtype=np.int64)
        out = out + ((high.astype(object) << 31) + low.astype(object)) * (1 << shift)
    out = np.asarray(out, object)
    return out // SPLIT, out % SPLIT


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _blocks(batches, column: int, rows: int):
    """(batch, matrix) of at most so many rows, all of one width."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
        for width in np.unique(sizes):
            own = batch.filter(pa.array(sizes == width)) if (sizes != width).any() else batch
            for at in range(0, own.num_rows, rows):
                part = own.slice(at, rows)
                yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, int(width))


class Total:
    """Sums of several blocks, kept as Python's integers."""

    def __init__(self):
        self.rows, self.sums = 0, 0

    def add(self, rows: int, high, low):
        self.rows += rows
        self.sums = self.sums + np.asarray(high, object) * SPLIT + np.asarray(low, object)

    def batch(self, width: int, i, j) -> pa.RecordBatch:
        n = len(i)
        fixed = [pa.array(np.full(n, width, np.int32)), pa.array(np.asarray(i, np.int32)), pa.array(np.asarray(j, np.int32)), pa.array(np.full(n, self.rows, np.int64))]
        return pa.RecordBatch.from_arrays([*fixed, _decimals(self.sums // SPLIT), _decimals(self.sums % SPLIT)], names=["width", "i", "j", "rows", "high", "low"])


def _first_sums(batches):
    """For each width the number of vectors and the sum of each dimension."""
    totals: dict[int, Total] = {}
    for part, x in _blocks(batches, 0, 1 << 12):
        high, low = (x >> 31).sum(0, dtype=np.int64), (x & (2**31 - 1)).sum(0, dtype=np.int64)
        total = (high.astype(object) << 31) + low.astype(object)
        totals.setdefault(x.shape[1], Total()).add(len(x), total // SPLIT, total % SPLIT)
    for width, total in totals.items():
        yield total.batch(width, range(width), range(width))


def centred(x: np.ndarray, n: int, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """n * x - S, S being n * base + rest: the products stay as small as the deviations are. 64-bit integers, or Python's where these could overflow."""
    off = x - base
    wide = n * (int(np.abs(off).max(initial=0)) + 1) >= 2**60  # sums of two have to fit as well
    return n * off.astype(object) - rest if wide else n * off - rest


def _second_sums(batches, n: int, base: np.ndarray, rest: np.ndarray):
    """The sum of squares of every centred dimension (i, i) and of every sum of two (i, j)."""
    width = len(base)
    i, j = np.triu_indices(width)
    total = Total()
    for _, x in _blocks(batches, 0, 1 << 10):
        if x.shape[1] != width:
            continue
        y = centred(x, n, base, rest)
        found = [squares(y, 0), *[squares(y[:, k : k + 1] + y[:, k + 1 :], 0) for k in range(width - 1)]]
        high, low = np.zeros(len(i), object), np.zeros(len(i), object)
        high[i == j], low[i == j] = found[0]
        at = 0
        for k, (h, v) in enumerate(found[1:]):
            at = k * width - k * (k - 1) // 2 + 1  # the place of (k, k + 1)
            high[at : at + width - k - 1], low[at : at + width - k - 1] = h, v
        total.add(len(x), high, low)
    if total.rows:
        yield total.batch(width, i, j)


def summed(parts: DataFrame) -> dict[tuple[int, int, int], tuple[int, int]]:
    """(width, i, j) to (rows, exact sum): as many entries as pairs of dimensions, whatever the number of vectors."""
    rows = parts.groupBy("width", "i", "j").agg(*[F.sum(c).alias(c) for c in ("rows", "high", "low")]).collect()
    return {(r.width, r.i, r.j): (r["rows"], int(r.high) * SPLIT + int(r.low)) for r in rows}


@dataclass
class Whitening:
    """What whiten() needs of the fit list: n distinct vectors with sums S, and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray  #: all eigenvalues, falling
    vectors: np.ndarray  #: unit eigenvectors as columns, in that order
    identity_error: float | None = None

    def base(self) -> tuple[np.ndarray, np.ndarray]:
        low = [s // self.n for s in self.sums]
        return np.array(low, np.int64), np.array([s - self.n * b for s, b in zip(self.sums, low)], np.int64)

    def used(self, k: int) -> int:
        """How many of the first k components have a variance that is not rounding."""
        least = len(self.values) * np.finfo(float).eps * max(self.values[0], 0.0) if len(self.values) else 0.0
        return int((self.values[:k] > least).sum())

    def project(self, y: np.ndarray, k: int) -> np.ndarray:
        """Whitened coordinates of centred vectors y = n * x - S."""
        k = self.used(k)
        return (y.astype(float) / self.n) @ self.vectors[:, :k] / np.sqrt(self.values[:k])


def covariance(squares_of: dict[tuple[int, int], int], width: int, n: int) -> np.ndarray:
    """V from the sums of squares Q of n * x - S: cov(i, j) = (Q(i + j) - Q(i) - Q(j)) / 2 / n ** 3, an exact quotient that is rounded once."""
    v = np.empty((width, width))
    for i in range(width):
        v[i, i] = squares_of[i, i] / n**3
        for j in range(i + 1, width):
            v[i, j] = v[j, i] = (squares_of[i, j] - squares_of[i, i] - squares_of[j, j]) / (2 * n**3)
    return v


def _whitened_sums(batches, fit: Whitening, k: int):
    """Sums and products of whitened coordinates: (i, -1) a sum, (i, j) a product."""
    base, rest = fit.base()
    k = fit.used(k)
    total, rows = np.zeros((k, k + 1)), 0
    for _, x in _blocks(batches, 0, 1 << 12):
        if x.shape[1] == len(base):
            w = fit.project(centred(x, fit.n, base, rest), k)
            total += np.concatenate([w.T @ w, w.sum(0)[:, None]], 1)
            rows += len(w)
    if rows:
        i, j = (m.ravel() for m in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), rows, np.int64)), pa.array(total.ravel())], names=["i", "j", "rows", "total"])


def fit_whitening(vectors: DataFrame, k: int = 16) -> Whitening | None:
    """The whitening of a table of distinct vectors (x: array of long), None without any; vectors of another length than the commonest (ties: the longest) are left out.

    Two passes sum integers only: n and S, then the squares of n * x - S for every dimension and every sum of two. Tasks send a row for
    each pair of dimensions, and the driver gets their totals: both depend on the width alone. A third pass measures the covariance of the whitened list."""
    first = summed(vectors.select("x").mapInArrow(_first_sums, SUMS))
    if not first:
        return None
    n, width = max((rows, w) for (w, _, _), (rows, _) in first.items())
    fit = Whitening(n, [first[width, i, i][1] for i in range(width)], np.zeros(width), np.eye(width))
    base, rest = fit.base()
    second = summed(vectors.select("x").mapInArrow(lambda it: _second_sums(it, n, base, rest), SUMS))
    values, basis = np.linalg.eigh(covariance({(i, j): q for (_, i, j), (_, q) in second.items()}, width, n))
    fit.values, fit.vectors = values[::-1].copy(), basis[:, ::-1].copy()
    parts = vectors.select("x").mapInArrow(lambda it: _whitened_sums(it, fit, k), "i int, j int, rows bigint, total double")
    k = fit.used(k)
    got = {(r.i, r.j): r.total / r["rows"] for r in parts.groupBy("i", "j").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")).collect()}
    if k:
        fit.identity_error = max(abs(got[i, j] - got[i, k] * got[j, k] - (i == j)) for i in range(k) for j in range(k))
    return fit


def _apply(batches, fit: Whitening, k: int):
    base, rest = fit.base()
    used, k = fit.used(k), min(k, len(base))
    for batch, x in _blocks(batches, 1, 1 << 11):
        if x.shape[1] != len(base):
            continue
        y = centred(x, fit.n, base, rest)
        high, low = squares(y, 1)
        deviation = _decimals(np.asarray(high, object) * SPLIT + np.asarray(low, object))
        w = np.zeros((len(x), k))
        w[:, :used] = fit.project(y, k)
        missing = np.broadcast_to(np.arange(k) >= used, w.shape).ravel()
        row = pa.array(np.repeat(np.arange(len(x)), k))
        component = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), component, deviation.take(row), pa.array(w.ravel(), mask=missing)], names=["id", "component", "deviation", "whitened"])


def whiten(table: DataFrame, k: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for each row with a sound vector and each of the first k components.

    Vectors are put on a grid of integers (see grid) and the fit list holds each vector of it once, so that copies weigh nothing. deviation is
    the exact sum of (n * x - S) ** 2 (decimal); explained is the component's share of the variance; identity_error is the largest
    entry of the fit list's whitened covariance off the identity. A component without variance has null in whitened. Rows with a
    null, an empty, a broken vector, or one of another length than the commonest, give no row; repeated rows and ids stay.
    An empty table gives an empty result. The fit list is a table in the shared folder for three passes and goes after them."""
    spark = table.sparkSession
    rows = grid(table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v", scale, offset).select("id", "x")
    distinct = written(rows.select("x").distinct(), "whitening-fit")
    fit = fit_whitening(distinct, k)
    drop_written(distinct)
    kind = dict(table.dtypes)[id_col]
    if fit is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    held = spark.sparkContext.broadcast(fit)  # width ** 2 numbers
    out = rows.mapInArrow(lambda it: _apply(it, held.value, k), f"id {kind}, component int, deviation decimal(38,0), whitened double")
    trace = float(fit.values.sum())
    shares = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in fit.values[:k]])
    error = F.lit(fit.identity_error).cast("double")
    return out.select(F.col("id").alias(id_col), "component", F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("component")).alias("explained"), error.alias("identity_error"))
