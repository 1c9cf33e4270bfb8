"""Embedding whitening by spectrum slicing.

Entries become whole numbers x = floor(1024 c) + 100,000. One pass gives the vectors' count
and exact sums, a second the covariance, centred before multiplying; both are sums over
tasks, one row per task and dimension, that meet by dimension. Only this matrix, whose
size is checked, reaches the driver. There, for each leading eigenvalue:

- The number of eigenvalues below a shift is the number of negative pivots of the shifted
  covariance's LDL' factors (symmetric pivoting in blocks of one or two), so a bisection of
  shifts slices the spectrum until an interval holds the wanted eigenvalue alone.
- Rayleigh quotient iteration converges cubically from there; a quotient that leaves the
  interval, or takes a vector already found, sends it back to slicing.
- Counts on both sides of the value found certify its number. Equal eigenvalues, which no
  count can part, share an interval as wide as rounding, and their vectors are made orthogonal.

A third pass projects all vectors and measures how far their covariance is from the identity.

Defined cases: rows without a vector, with an empty one, or with null or non-finite entries,
or entries beyond 2**40, are dropped. Vectors are of the most frequent length (the longest of
those equally frequent); a row of another length is dropped, and a warning counts them. Repeated
rows and null ids each count. A component without variance (fewer distinct vectors than
components, dimensions that repeat others) explains 0, its whitened value is null, and the
identity error leaves it out. Empty input gives empty output. Other columns are ignored.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .linear import summed

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: The covariance is a matrix of at most this many rows.
MOST_DIMENSIONS = 4_096
EPS = np.finfo(float).eps


def vectors(df: DataFrame, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(id, x) of the rows whose vector is whole."""
    value = lambda c: c.cast("double")
    whole = F.forall(vector_col, lambda c: F.coalesce(F.abs(value(c)) <= float(1 << 40), F.lit(False)))
    x = F.transform(vector_col, lambda c: F.floor(value(c) * SCALE) + OFFSET)
    return df.where(F.col(vector_col).isNotNull() & whole & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), x.alias("x"))


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The vectors of a batch."""
    return np.array(batch.column("x").flatten(), np.int64).reshape(-1, d)


def exact_sums(fit: DataFrame, d: int) -> list[int]:
    """S: the vectors' sums per dimension."""

    def run(batches):
        total = np.zeros(d, object)
        for batch in slices(batches, 4096):  # 2**12 entries of 2**50 fit a long
            total += matrix(batch, d).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(Decimal, map(int, total)), pa.decimal128(38, 0))], ["i", "s"])

    parts = fit.select("x").mapInArrow(run, "i int, s decimal(38,0)")
    return [int(r["s"]) for r in parts.groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("i").collect()]


def covariance(fit: DataFrame, d: int, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The vectors' covariance with divisor n; their means are whole + rest / n."""

    def run(batches):
        total = np.zeros((d, d))
        for batch in slices(batches, 4096):
            centred = (matrix(batch, d) - whole) - rest / n
            total += centred.T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([v.tobytes() for v in total], pa.binary())], ["i", "values"])

    found = summed(fit.select("x").mapInArrow(run, "i int, values binary"), d) / n
    return (found + found.T) / 2


def count_below(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of symmetric a below a shift: the negative pivots of LDL' of a - shift I."""
    s = a - shift * np.eye(len(a))
    tiny = EPS * max(np.abs(a).max(), abs(shift), np.finfo(float).tiny)
    n, at, below = len(s), 0, 0
    alpha = (1 + np.sqrt(17)) / 8  # bounds the growth of the factors

    def swap(i, j):
        if i != j:
            s[[i, j]] = s[[j, i]]
            s[:, [i, j]] = s[:, [j, i]]

    while at < n:
        column = np.abs(s[at + 1 :, at])
        most = column.max(initial=0.0)
        pair = False
        if most > tiny and abs(s[at, at]) < alpha * most:
            r = at + 1 + int(column.argmax())
            beyond = np.abs(s[at:, r])
            beyond[r - at] = 0.0
            if abs(s[at, at]) * beyond.max() < alpha * most**2:
                if abs(s[r, r]) >= alpha * beyond.max():
                    swap(at, r)
                else:
                    swap(at + 1, r)
                    pair = True
        width = 2 if pair else 1
        pivot, rows = s[at : at + width, at : at + width], s[at + width :, at : at + width]
        if pair:
            below += 1  # such a block has one eigenvalue of either sign
        else:
            if abs(pivot[0, 0]) < tiny:
                pivot[0, 0] = tiny
            below += bool(pivot[0, 0] < 0)
        s[at + width :, at + width :] -= rows @ np.linalg.solve(pivot, rows.T)
        at += width
    return below


@dataclass
class Spectrum:
    """Leading eigenvalues, falling, and their unit eigenvectors as columns."""

    values: np.ndarray
    vectors: np.ndarray


def sliced(a: np.ndarray, components: int) -> Spectrum:
    """The leading eigenpairs of symmetric a, each isolated and certified by counts."""
    d = len(a)
    radius = np.abs(a).sum(axis=1).max()
    if not radius:
        return Spectrum(np.zeros(min(components, d)), np.eye(d, min(components, d)))
    near = 8 * d * EPS * radius  # closer eigenvalues are equal to rounding
    counts: dict[float, int] = {-radius - near: 0, radius + near: d}

    def below(shift):
        if shift not in counts:
            counts[shift] = count_below(a, shift)
        return counts[shift]

    values, found = [], np.empty((d, 0))
    for k in range(1, min(components, d) + 1):
        wanted = d - k  # eigenvalues below the k-th largest
        lo = max(s for s, n in counts.items() if n <= wanted)
        hi = min(s for s, n in counts.items() if n > wanted)
        lo, hi, start = min(lo, hi), max(lo, hi), 0
        while True:
            while hi - lo > near and below(hi) - below(lo) > 1:
                middle = (lo + hi) / 2
                lo, hi = (middle, hi) if below(middle) <= wanted else (lo, middle)
            value, vector = rayleigh(a, (lo + hi) / 2, found, near, start)
            certain = below(value - near) <= wanted < below(value + near)
            if certain and (lo - near <= value <= hi + near):
                break
            if hi - lo <= near:
                start += 1  # equal eigenvalues: another start, orthogonal to those found
                if start > d:
                    raise ArithmeticError(f"eigenvalue {k} is not certified between {lo} and {hi}")
                continue
            middle = (lo + hi) / 2
            lo, hi = (middle, hi) if below(middle) <= wanted else (lo, middle)
        values.append(value)
        found = np.column_stack((found, vector))
    return Spectrum(np.array(values), found)


def rayleigh(a: np.ndarray, shift: float, found: np.ndarray, near: float, start: int = 0, rounds: int = 30) -> tuple[float, np.ndarray]:
    """An eigenpair near a shift, orthogonal to those found: inverse iteration first, then Rayleigh quotients as shifts."""
    d = len(a)
    apart = lambda v: v - found @ (found.T @ v)
    vector = apart(apart(np.random.default_rng(start).standard_normal(d)))
    vector /= np.linalg.norm(vector)
    value = shift
    for step in range(rounds):
        try:
            vector = np.linalg.solve(a - value * np.eye(d), vector)
        except np.linalg.LinAlgError:
            vector = np.linalg.solve(a - (value + near) * np.eye(d), vector)
        vector = apart(apart(vector / np.linalg.norm(vector)))
        vector /= np.linalg.norm(vector)
        quotient = vector @ a @ vector
        if np.linalg.norm(a @ vector - quotient * vector) <= near:
            return float(quotient), vector
        value = shift if step == 0 else quotient
    return float(vector @ a @ vector), vector


def deviations(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> list[int]:
    """Exact sums over dimensions of (n x - S)**2, S = n whole + rest."""
    off = x - whole
    if len(whole) * (n * (int(np.abs(off).max(initial=0)) + 1)) ** 2 < 1 << 63:
        return ((n * off - rest) ** 2).sum(axis=1).tolist()
    return ((n * off.astype(object) - rest.astype(object)) ** 2).sum(axis=1).tolist()


def whitened(df: DataFrame, components: int = COMPONENTS, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every whole vector and leading component.

    deviation is exact, as a decimal: the sum over dimensions of (n x - S) squared.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    every = vectors(df, id_col, vector_col)
    lengths = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    if not lengths:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d, n = lengths[0]
    if len(lengths) > 1:
        warnings.warn(f"vectors of another length than {d} are dropped: {every.where(F.size('x') != d).count()} rows", stacklevel=2)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; the covariance of at most {MOST_DIMENSIONS} fits the driver")
    fit = every.where(F.size("x") == d)
    sums = np.array(exact_sums(fit, d), object)
    whole, rest = (sums // n).astype(np.int64), (sums % n).astype(np.int64)
    v = covariance(fit, d, n, whole, rest)
    spectrum = sliced(v, components)
    trace, k = np.trace(v), len(spectrum.values)
    flat = spectrum.values <= 8 * d * EPS * max(trace, np.finfo(float).tiny)
    scale = np.divide(1.0, np.sqrt(np.maximum(spectrum.values, 0)), out=np.zeros(k), where=~flat)
    axes, explained = spectrum.vectors * scale, np.where(flat, 0.0, spectrum.values / (trace or 1.0))

    def projected(x):
        return ((x - whole) - rest / n) @ axes

    def measure(batches):
        total = np.zeros((k, k + 1))
        for batch in slices(batches, 4096):
            w = projected(matrix(batch, d))
            total += np.column_stack((w.T @ w, w.sum(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "values"])

    moments = summed(fit.select("x").mapInArrow(measure, "i int, values binary"), k + 1) / n
    error = np.abs(moments[:, :k] - np.outer(moments[:, k], moments[:, k]) - np.eye(k))[~flat][:, ~flat].max(initial=0.0)

    def run(batches):
        for batch in slices(batches, 2048):
            x = matrix(batch, d)
            off = [Decimal(t) for t in deviations(x, whole, rest, n)]
            w = projected(x)
            values = pa.array(w.ravel(), mask=np.tile(flat, len(x)))
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(rows), n), pa.int64()),
                    pa.array(off, pa.decimal128(38, 0)).take(pa.array(rows)), values, pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return fit.mapInArrow(run, schema).withColumnRenamed("id", id_col)
