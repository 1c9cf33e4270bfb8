"""Linear scorers over hashed sparse features: fitted on a bounded sample, or on all rows by sums over tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: Sums of a task meet others' in parts of so many.
PART = 1024
BLOCK_ROWS = 4096


class Rows:
    """Sparse rows: feature numbers and values, one after another, and where each row starts."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        sizes = np.array([len(i) for i, _ in rows], np.int64)
        self.n = len(rows)
        self.index = np.concatenate([i for i, _ in rows]) if rows else np.empty(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.empty(0)
        self.row = np.repeat(np.arange(self.n), sizes)

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Rows x weights (features, classes)."""
        return np.stack([np.bincount(self.row, self.value * w[self.index], self.n) for w in weights.T], axis=1)

    def back(self, grad: np.ndarray, features: int) -> np.ndarray:
        """Transposed rows x grad (rows, classes)."""
        return np.stack([np.bincount(self.index, self.value * g[self.row], features) for g in grad.T], axis=1)


class Adam:
    def __init__(self, shape, rate):
        self.m, self.v, self.rate, self.t = np.zeros(shape), np.zeros(shape), rate, 0

    def step(self, grad):
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.99 * self.v + 0.01 * grad**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-9)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(rows: Rows, target: np.ndarray, features: int, rounds=120, rate=0.1, decay=1e-4):
    """(weights, bias) of a softmax scorer for soft targets (rows, classes), by full-batch Adam."""
    classes = target.shape[1]
    weights, bias = np.zeros((features, classes)), np.log(target.mean(axis=0) + 1e-6)
    by_weight, by_bias = Adam(weights.shape, rate), Adam(bias.shape, rate)
    for _ in range(rounds):
        error = (softmax(rows.times(weights) + bias) - target) / max(1, rows.n)
        weights -= by_weight.step(rows.back(error, features) + decay * weights)
        bias -= by_bias.step(error.sum(axis=0))
    return weights, bias


def summed(parts: DataFrame, width: int) -> np.ndarray:
    """Rows (i, values binary) summed by i, in order of i: first within tasks, then where equal i meet."""

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in slices(batches, 256):
            for i, values in zip(batch.column("i").to_pylist(), batch.column("values").to_pylist(), strict=True):
                held = np.frombuffer(values, float)
                totals[i] = totals[i] + held if i in totals else held
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], ["i", "values"])

    schema = "i int, values binary"
    rows = parts.mapInArrow(add, schema).repartition("i").mapInArrow(add, schema).collect()
    out = np.zeros((len(rows), width))
    for r in rows:
        out[r["i"]] = np.frombuffer(r["values"], float)
    return out


def sparse(batch: pa.RecordBatch) -> Rows:
    """The rows of a batch with columns index (int32) and value (float32), as bytes."""
    index, value = batch.column("index").to_pylist(), batch.column("value").to_pylist()
    out = Rows([])
    sizes = np.fromiter(map(len, index), np.int64, len(index)) // 4
    out.n, out.row = len(index), np.repeat(np.arange(len(index)), sizes)
    out.index, out.value = np.frombuffer(b"".join(index), "<i4").astype(np.int64), np.frombuffer(b"".join(value), "<f4").astype(float)
    return out


def logistic_sums(rows: DataFrame, x: np.ndarray, targets: dict[bytes, float] | None = None) -> np.ndarray:
    """(rows, summed losses, their gradient by x) over all rows of a table; x: weights, then the bias.

    rows has index and value, and key: targets gives its wanted probability (None: 0 for all).
    """
    n_parts = -(-(len(x) + 2) // PART)

    def run(batches):
        total = np.zeros(n_parts * PART)
        for batch in slices(batches):
            held = sparse(batch)
            target = np.array([targets[bytes(k)] for k in batch.column("key").to_pylist()]) if targets else 0.0
            g = np.bincount(held.row, held.value * x[held.index], held.n) + x[-1]
            error = 1 / (1 + np.exp(-np.clip(g, -40, 40))) - target
            total[:2] += held.n, (np.logaddexp(0, g) - target * g).sum()
            total[2 : len(x) + 1] += np.bincount(held.index, held.value * error[held.row], len(x) - 1)
            total[len(x) + 1] += error.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(n_parts), pa.int32()), pa.array([v.tobytes() for v in total.reshape(n_parts, PART)], pa.binary())], ["i", "values"])

    columns = ["index", "value"] + ["key"] * bool(targets)
    return summed(rows.select(*columns).mapInArrow(run, "i int, values binary"), PART).ravel()[: len(x) + 2]


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (index, value) in blocks of BLOCK_ROWS, one row each: what a fit reads at every step."""

    def run(batches):
        for batch in slices(batches, BLOCK_ROWS):
            index, value = batch.column("index").to_pylist(), batch.column("value").to_pylist()
            sizes = np.fromiter(map(len, index), "<i4", len(index)) // 4
            row = [sizes.astype("<i4").tobytes(), b"".join(index), b"".join(value)]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in row], ["sizes", "index", "value"])

    return written(rows.select("index", "value").mapInArrow(run, "sizes binary, index binary, value binary"), "blocks")


def unlabelled_sums(held: DataFrame, x: np.ndarray) -> np.ndarray:
    """As logistic_sums with targets of 0, over blocks."""
    n_parts = -(-(len(x) + 2) // PART)

    def run(batches):
        total = np.zeros(n_parts * PART)
        for batch in slices(batches, 16):
            for sizes, index, value in zip(*(batch.column(c).to_pylist() for c in ("sizes", "index", "value")), strict=True):
                n = len(sizes) // 4
                row = np.repeat(np.arange(n), np.frombuffer(sizes, "<i4"))
                at, by = np.frombuffer(index, "<i4"), np.frombuffer(value, "<f4")
                g = np.bincount(row, by * x[at], n) + x[-1]
                error = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
                total[:2] += n, np.logaddexp(0, g).sum()
                total[2 : len(x) + 1] += np.bincount(at, by * error[row], len(x) - 1)
                total[len(x) + 1] += error.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(n_parts), pa.int32()), pa.array([v.tobytes() for v in total.reshape(n_parts, PART)], pa.binary())], ["i", "values"])

    return summed(held.mapInArrow(run, "i int, values binary"), PART).ravel()[: len(x) + 2]


def lbfgs(objective: Callable, x: np.ndarray, rounds: int, near: float, memory: int = 10) -> np.ndarray:
    """x that minimises an objective, which returns (value, gradient): limited-memory BFGS with halved steps.

    Ends when the gradient is below `near`, when no step lowers the value, or after `rounds` steps.
    """
    value, gradient = objective(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(gradient).max() <= near:
            break
        direction, held = -gradient, []
        for s, y in reversed(steps):
            held.append(s @ direction / (s @ y))
            direction = direction - held[-1] * y
        if steps:
            s, y = steps[-1]
            direction = direction * (s @ y) / (y @ y)
        else:
            direction = direction / max(1.0, np.abs(direction).max())
        for (s, y), a in zip(steps, reversed(held), strict=True):
            direction = direction + (a - y @ direction / (s @ y)) * s
        slope, size = gradient @ direction, 1.0
        if slope >= 0:
            direction, slope, steps = -gradient, -(gradient @ gradient), []
        while True:
            new_value, new_gradient = objective(x + size * direction)
            if new_value <= value + 1e-4 * size * slope or size < 1e-3:
                break
            size /= 2 if size > 0.2 else 4
        if new_value >= value:
            break
        s, y = size * direction, new_gradient - gradient
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            steps = [*steps, (s, y)][-memory:]
        x, value, gradient = x + size * direction, new_value, new_gradient
    return x


def smallest_hashes(df: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """The at most `bound` distinct keys of df with the smallest hashes: the same sample on any partitioning."""
    return df.select(F.col(key).alias("key")).where("key is not null").distinct().orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(bound)


def sampled(docs: DataFrame, keys: DataFrame, id_col: str, bound: int, text_col="text") -> DataFrame:
    """Distinct rows by id and text, at most `bound` by smallest hash, of docs whose id is among a bounded sample of keys."""
    met = docs.withColumn("_digest", F.xxhash64(text_col)).join(F.broadcast(keys.select("key")), F.col(id_col) == F.col("key"), "left_semi")
    rows = met.select(F.col(id_col).alias("_id"), F.col("_digest").alias("_at")).distinct().orderBy(F.xxhash64("_id", "_at"), "_id", "_at").limit(bound)
    return met.join(F.broadcast(rows), (F.col(id_col) == F.col("_id")) & (F.col("_digest") == F.col("_at")), "left_semi").dropDuplicates([id_col, "_digest"]).drop("_digest")
