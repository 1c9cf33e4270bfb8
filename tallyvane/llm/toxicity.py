"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P, a bounded sample of labelled rows) and all documents that may
be learnt from (U). With class prior pi and logistic losses l+ and l-, a linear scorer minimises

    pi E_P[l+] + | E_U[l-] - pi E_P[l-] |

the non-negative estimate of the risk that labelled negatives would give; where the
second part turns negative its gradient is reversed, which keeps the scorer from
memorising P. pi is the share of toxic rows among the labelled rows that may be learnt
from. Features are hashed words and word beginnings, kept if they are clearly more frequent in
P; their document frequencies are counted over all learnable documents, in P by distinct texts.
The chosen features of all documents are written once, and those of U in blocks; a step of
the fit is one pass of sums over the blocks, and scores are read off the rows.

Defined cases: a null or empty text has no features and scores by the bias alone. Null ids
are scored and not learnt from. Repeated rows each count and stay repeated. Without any
positive example every score is 0. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, crc32_mod, slices, written
from .linear import Rows, blocks, lbfgs, sampled, smallest_hashes, sparse, unlabelled_sums

#: Positive labelled documents fitted on, at most (by smallest hash of the id).
POSITIVES = 4_000
#: Steps of the fit, the gradient at which it ends, and the weight of the squared weights.
ROUNDS, NEAR, DECAY = 25, 1e-4, 1e-5
BITS = 20
MIN_POSITIVES = 5  # distinct texts
MIN_Z = 4.0
CACHE_WORDS = 200_000
#: Positive labelled ids whose documents' features are counted, at most (by smallest hash; 16 MB when broadcast).
POSITIVE_IDS = 1_000_000
BEGINNINGS = (5, 6, 7, 8)
SEED = 1010


def beginnings(word: bytes):
    """The beginnings of a word of at most so many bytes each, cut between characters."""
    last = 0
    for length in BEGINNINGS:
        if len(word) < length:
            return
        if length < len(word):
            while word[length] & 0xC0 == 0x80:
                length -= 1
        if length > last:
            yield word[:length]
            last = length


class _Numbers(dict):
    """Word to the feature numbers of itself and its beginnings (flags: those flagged); starts anew beyond CACHE_WORDS."""

    def __init__(self, flags: np.ndarray | None = None):
        self.flags = flags

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        bare = word.strip(b".,;:!?\"'()[]*#$%&|")
        found = (xxhash.xxh3_64_intdigest(key) & ((1 << BITS) - 1) for key in (bare, *(b"^" + x for x in beginnings(bare))))
        self[word] = found = tuple(found if self.flags is None else (n for n in found if self.flags[n]))
        return found


_NUMBERS = _Numbers()
_HELD: dict[bytes, _Numbers] = {}


def numbers_among(chosen: np.ndarray) -> _Numbers:
    """The worker's cache for these features; workers are reused, so it outlives a task."""
    key = xxhash.xxh3_128_digest(chosen.tobytes())
    if key not in _HELD:
        _HELD.clear()
        flags = np.zeros(1 << BITS, bool)
        flags[chosen] = True
        _HELD[key] = _Numbers(flags)
    return _HELD[key]


def present(text: bytes, numbers: _Numbers = _NUMBERS) -> np.ndarray:
    """The distinct feature numbers of a text, in any order."""
    found = set().union(*map(numbers.__getitem__, set(text.translate(TO_LOWER).split())))
    return np.fromiter(found, np.int64, len(found))


def features(text: bytes, numbers: _Numbers = _NUMBERS) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, values): hashed words and word beginnings, by the logarithm of their counts."""
    counts: dict[int, int] = {}
    for word, n in Counter(text.translate(TO_LOWER).split()).items():
        for number in numbers[word]:
            counts[number] = counts.get(number, 0) + n
    index = np.fromiter(counts.keys(), np.int64, len(counts))
    order = np.argsort(index)
    return index[order], np.log1p(np.fromiter(counts.values(), np.float64, len(counts))[order])


def frequencies(docs: list[tuple]) -> tuple[np.ndarray, int]:
    """(documents with each feature, documents)."""
    return np.bincount(np.concatenate([i for i, _ in docs]) if docs else np.empty(0, np.int64), minlength=1 << BITS), len(docs)


def typical(of_p: tuple[np.ndarray, int], of_u: tuple[np.ndarray, int]) -> np.ndarray:
    """Features clearly more frequent in P, from the frequencies in P and U."""
    (df_p, n_p), (df_u, n_u) = of_p, of_u
    share_p, share_u = df_p / n_p, (df_u + 1) / (n_u + 2)
    z = (share_p - share_u) / np.sqrt(share_u * (1 - share_u) / n_p + 1e-12)
    return np.flatnonzero((df_p >= MIN_POSITIVES) & (z > MIN_Z))


def nnpu(positive: Rows, unlabelled, prior: float, features: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights, then the bias, that minimise the risk; unlabelled(x) gives (rows, summed losses, gradient) of U at x."""
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -40, 40)))

    def back(error):
        return np.append(np.bincount(positive.index, positive.value * error[positive.row], features), error.sum())

    def objective(x):
        n, loss, *gradient = unlabelled(x)
        g = np.bincount(positive.row, positive.value * x[positive.index], positive.n) + x[-1]
        share, weights = prior / positive.n, np.append(x[:-1], 0.0)
        rest = loss / n - share * np.logaddexp(0, g).sum()
        sign = 1.0 if rest >= 0 else -1.0
        value = share * np.logaddexp(0, -g).sum() + abs(rest) + DECAY / 2 * (weights @ weights)
        return value, back(share * (sigmoid(g) - 1)) + sign * (np.array(gradient) / n - back(share * sigmoid(g))) + DECAY * weights

    return lbfgs(objective, np.append(np.zeros(features), np.log(prior / (1 - prior))), rounds, NEAR)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def described(source: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(id, index, value) of rows (id, text): their chosen features, numbered in order."""

    def run(batches):
        numbers = numbers_among(chosen)  # others weigh nothing
        for batch in slices(batches):
            out = [features(t, numbers) for t in batch.column("text").to_pylist()]
            columns = [np.searchsorted(chosen, i).astype("<i4").tobytes() for i, _ in out], [v.astype("<f4").tobytes() for _, v in out]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.binary()) for c in columns)], ["id", "index", "value"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, index binary, value binary")


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic"):
    """(described rows of docs, feature numbers, weights and bias) learnt from rows that are not held out, or None without positives."""
    source = _texts(docs, id_col, text_col)
    learnable = crc32_mod(id_col, 5) != 0
    known = labels.where(learnable & F.col(label_col).isNotNull())
    prior = known.agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    if not prior:
        return None

    def counted(rows: DataFrame, among: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """Frequencies over all rows (among: of these features only), as at most 2**BITS numbers."""

        def count(batches):
            df, n = np.zeros(1 << BITS, np.int64), 0
            numbers = _NUMBERS if among is None else numbers_among(among)
            for batch in slices(batches):
                for text in batch.column("text").to_pylist():
                    df[present(text, numbers)] += 1
                    n += 1
            at = np.flatnonzero(df) if among is None else among
            yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at), pa.int64()), pa.array(np.append(n, df[at]), pa.int64())], ["feature", "n"])

        sums = rows.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(f"feature = -1 or n >= {MIN_POSITIVES}").toArrow()
        df, at, n = np.zeros(1 << BITS, np.int64), sums["feature"].to_numpy(), sums["n"].to_numpy()
        df[at[at >= 0]] = n[at >= 0]
        return df, int(n[at < 0].sum())

    toxic = known.where(F.col(label_col) == 1)
    taught = source.where(crc32_mod("id", 5) != 0).where("id is not null")
    ids = F.broadcast(smallest_hashes(toxic, id_col, POSITIVE_IDS, SEED + 1))
    of_p = counted(taught.join(ids, F.col("id") == F.col("key"), "left_semi").dropDuplicates(["text"]))
    if not of_p[1]:
        return None
    chosen = typical(of_p, counted(taught, np.flatnonzero(of_p[0])))
    rows = written(described(source, chosen), "described")
    own = sampled(source, smallest_hashes(toxic, id_col, POSITIVES, SEED), "id", POSITIVES)
    positive = described(own, chosen).select("index", "value").toArrow()
    held = sparse(positive.combine_chunks().to_batches()[0]) if positive.num_rows else Rows([])
    if not held.n:
        return None
    unlabelled = blocks(rows.where((crc32_mod("id", 5) != 0) & F.col("id").isNotNull()))
    return rows, chosen, nnpu(held, lambda x: unlabelled_sums(unlabelled, x), min(prior, 0.5), len(chosen))


def toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """id, held_out, score, predicted for every row."""
    model = fit(docs, labels, id_col, text_col, label_col)
    held = crc32_mod(id_col, 5) == 0
    if model is None:
        return docs.select(F.col(id_col), held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    rows, _, x = model
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            found = sparse(batch)
            g = np.bincount(found.row, found.value * x[found.index], found.n) + x[-1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(g, -40, 40))), pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {id_type}, score double").select(
        F.col("id").alias(id_col), (crc32_mod("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
