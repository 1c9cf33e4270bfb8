"""Quality classifier from weak labels.

Overlapping heuristic labellers vote bad (-1), good (1) or abstain (0) on every document.
Expectation-maximisation over the counts of vote patterns, gathered from all documents,
estimates how each labeller votes on good and on bad documents, and so the posterior of
every pattern. A hashed linear scorer (word shapes and binned signals) is fitted to the
posteriors of all documents and scores them; it grades what the coarse votes cannot tell
apart. Features are written once; a step of the fit is one pass of sums over them.

Defined cases: a null text is an empty one. An empty table gives no rows. Null ids are
learnt from like others. Repeated rows each count and stay repeated. score is the probability of good
quality; keep is score >= 0.5. Extra columns are kept as they are by `kept`; `scored`
returns the id and its own columns only.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hashed_counts, slices, written
from .linear import Rows, lbfgs, logistic_sums, sparse

BITS = 14
#: Steps of the fit, the gradient at which it ends, and the weight of the squared weights.
ROUNDS, NEAR, DECAY = 30, 1e-4, 1e-4
SHAPE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + bytes(range(128, 256)), b"A" * 26 + b"a" * 26 + b"0" * 10 + b"a" * 128
)
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
PLAIN = LETTERS + b"0123456789 \n\t\r"
SIGNALS = ["odd", "pipes", "upper", "shout", "repeats", "variety", "lines", "stops", "n_words"]


def signals(text: bytes, words: list[bytes]) -> list[float]:
    """Measures of a text, in the order of SIGNALS."""
    n, size = max(1, len(words)), max(1, len(text))
    letters = max(1, size - len(text.translate(None, LETTERS)))
    upper = size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lines = [x for x in text.split(b"\n") if x]
    return [
        len(text.translate(None, PLAIN)) / size,
        text.count(b"|") / n,
        upper / letters,
        text.count(b"!") / n,
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        (text.count(b".") + text.count(b"?")) / n,
        float(len(words)),
    ]


def votes(s: list[float]) -> list[int]:
    """The labellers, on a text's signals."""
    odd, pipes, upper, shout, repeats, variety, lines, stops, n_words = s
    bad = lambda flag: -1 if flag else 0
    enough = n_words >= 8  # shares of a few words say little
    return [
        bad(enough and odd > 0.08),
        bad(enough and (odd > 0.12 or odd < 0.002)),
        bad(pipes > 0.2),
        bad(enough and upper > 0.25),
        bad(shout > 0.2),
        bad(repeats > 0.1),
        bad(n_words >= 30 and variety < 0.2),
        bad(enough and lines > 0.4),
        bad(n_words < 1),
        bad(enough and (stops < 0.01 or stops > 0.6)),
        1 if n_words and (not enough or 0.01 <= odd <= 0.07) and stops >= 0.02 else 0,
        1 if n_words and (not enough or upper < 0.15) and shout < 0.05 and pipes < 0.05 else 0,
        1 if repeats < 0.03 and (variety > 0.3 or n_words > 2000) else 0,
    ]


LABELLERS = len(votes([0.0] * len(SIGNALS)))


def features(text: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(votes, feature numbers, values): hashed word shapes by share, and binned signals."""
    words = text.split()
    s = signals(text, words)
    index, count = hashed_counts(text.translate(SHAPE).split(), BITS)
    bins = {xxhash.xxh3_64_intdigest(f"{name}:{int(6 * np.log2(1 + 50 * min(x, 4)))}".encode()) % (1 << BITS) for name, x in zip(SIGNALS, s, strict=True)}
    value = np.sqrt(count / max(1, len(words)))
    bins = np.array(sorted(bins))
    return votes(s), np.concatenate((index, bins)), np.concatenate((value, np.full(len(bins), 0.5)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds=200):
    """EM over distinct vote patterns: (bad prior, vote probabilities[labeller, vote + 1, class], P(bad | pattern))."""
    one_hot = (patterns[:, :, None] + 1 == np.arange(3)).astype(float)
    tally = (patterns == -1).sum(axis=1) - 0.5 * (patterns == 1).sum(axis=1)
    posterior = np.where(tally > 0, 0.9, 0.05)
    for _ in range(rounds):
        mass = np.stack((counts * (1 - posterior), counts * posterior), axis=1)
        votes_by_class = np.einsum("plv,pc->lvc", one_hot, mass) + 0.5
        table = votes_by_class / votes_by_class.sum(axis=1, keepdims=True)
        prior = (mass[:, 1].sum() + 1) / (counts.sum() + 2)
        log_odds = np.log(prior / (1 - prior)) + np.einsum("plv,lv->p", one_hot, np.log(table[:, :, 1] / table[:, :, 0]))
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -40, 40)))
    return prior, table, posterior


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def described(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, key, index, value) of every row, written: its votes and features."""
    source = _texts(docs, id_col, text_col)

    def run(batches):
        for batch in slices(batches):
            out = [features(t) for t in batch.column("text").to_pylist()]
            columns = [bytes(v + 1 for v in o[0]) for o in out], [o[1].astype("<i4").tobytes() for o in out], [o[2].astype("<f4").tobytes() for o in out]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.binary()) for c in columns)], ["id", "key", "index", "value"])

    id_type = source.schema["id"].dataType.simpleString()
    return written(source.mapInArrow(run, f"id {id_type}, key binary, index binary, value binary"), "described")


def fit(rows: DataFrame):
    """(weights and bias of good quality, labeller table) learnt from described rows, or None for an empty table."""
    # Distinct patterns are few (3 ** labellers at most), whatever the documents' number.
    found = rows.groupBy("key").count().collect()
    if not found:
        return None
    patterns, counts = np.array([list(r["key"]) for r in found]) - 1, np.array([r["count"] for r in found], float)
    _, table, bad = estimate(patterns, counts)
    good = {bytes(r["key"]): 1 - p for r, p in zip(found, bad, strict=True)}
    share = float(np.clip(counts @ (1 - bad) / counts.sum(), 1e-6, 1 - 1e-6))

    def objective(x):
        n, loss, *gradient = logistic_sums(rows, x, good)
        weights = np.append(x[:-1], 0.0)
        return loss / n + DECAY / 2 * (weights @ weights), np.array(gradient) / n + DECAY * weights

    start = np.append(np.zeros(1 << BITS), np.log(share / (1 - share)))
    return lbfgs(objective, start, ROUNDS, NEAR), table


def good_probability(rows: Rows, x: np.ndarray) -> np.ndarray:
    """Probability of good quality per row; an empty text has that of its signals alone."""
    g = np.bincount(rows.row, rows.value * x[rows.index], rows.n) + x[-1]
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def scored(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id, score, keep for every row."""
    rows = described(docs, id_col, text_col)
    model = fit(rows)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, score double, keep boolean"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    x, _ = model

    def run(batches):
        for batch in slices(batches):
            score = good_probability(sparse(batch), x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array(score >= 0.5)], ["id", "score", "keep"])

    return rows.select("id", "index", "value").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def kept(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs with a score of 0.5 or more, all columns as they were."""
    rows = described(docs, id_col, text_col)
    model = fit(rows)
    discard(rows)
    if model is None:
        return docs
    x, _ = model
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            found = Rows([features(t.encode() if t else b"")[1:] for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(good_probability(found, x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
