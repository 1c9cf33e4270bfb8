"""Mixing to target weights with soft domain membership.

A softmax scorer, fitted on a bounded sample of a labelled table, gives every document a
posterior over domains. With n_d tokens and posterior p_d, document d at rate w_d adds
w_d n_d p_d to the domains' expected tokens. Rates w_d >= floor minimise

    1/2 sum_k (sum_d w_d n_d p_dk / B - target_k)^2 / share_k      B: the token budget

by accelerated projected gradient steps from w = 1; share_k are the domain's tokens in
budgets at w = 1. Where the targets can be met they are met; weighing the domains makes
rare ones converge as fast, and bounds the step by 1. In the metric that weighs a document
by its tokens the step for w_d depends on the K scaled residuals and p_d alone, so a
document's rate is a function of its posterior and of the few residual vectors so far: an
iteration is one aggregation of 2K sums over the (narrow) posterior table, and no rates are
stored between iterations. Residuals, K numbers each, are all that reaches the driver.

Steps end when every domain is within MET of its target, or when they no longer move the
domains' totals (targets that no rates can meet at this budget and floor; the budget can be
raised then). If not all are met, a warning says how
far each domain is from its target.

Defined cases: a null or empty text has no tokens and the posterior of the bias. Null
ids are mixed but not learnt from. Repeated rows each count. Domains without labelled
rows do not exist; a target for one is an error. Without labelled rows, or tokens, every
rate is 1 (or the floor, if higher). Targets are scaled to sum 1. Other columns are
ignored by `rates` and kept as they are by `mixed`.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, hashed_counts, slices, written
from .linear import Rows, fit_softmax, sampled, smallest_hashes, softmax

#: Labelled documents fitted on, at most (by smallest hash of the id).
SAMPLE = 3_000
BITS = 13
ROUNDS = 200
#: Met: within this share of the target; of a target of zero, within TOLERANCE.
MET = 1e-3
TOLERANCE = 1e-5
#: First share by which a budget is raised, and the last one.
RAISE, MOST_RAISE = 0.01, 1.0
SEED = 101


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words by the root of their share."""
    index, count = hashed_counts(words, BITS)
    return index, np.sqrt(count / max(1, len(words)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.xxhash64(text_col).alias("digest"))


def posteriors(docs: DataFrame, labelled: DataFrame, id_col="doc_id", text_col="text", domain_col="domain") -> tuple[DataFrame, list[str]]:
    """((id, digest, n_tokens, posterior) of every row, domains in order of the posterior's entries).

    labelled: id and domain of some documents.
    """
    source = _texts(docs, id_col, text_col)
    known = labelled.select(F.col(id_col).alias("key"), F.col(domain_col).cast("string").alias("domain")).where("key is not null and domain is not null")
    keys = smallest_hashes(known, "key", SAMPLE, SEED)
    chosen = F.broadcast(known.join(F.broadcast(keys), "key").groupBy("key").agg(F.min("domain").alias("domain")))

    def describe(batches):
        for batch in slices(batches):
            out = [features(t.translate(TO_LOWER).split()) for t in batch.column("text").to_pylist()]
            columns = [i.astype("<i4").tobytes() for i, _ in out], [v.astype("<f4").tobytes() for _, v in out]
            yield pa.RecordBatch.from_arrays([batch.column("domain"), *(pa.array(c, pa.binary()) for c in columns)], ["domain", "index", "value"])

    sample = sampled(source, chosen, "id", SAMPLE).join(chosen, F.col("id") == F.col("key")).select("domain", "text").mapInArrow(describe, "domain string, index binary, value binary").collect()
    domains = sorted({r["domain"] for r in sample})
    rows = Rows([(np.frombuffer(r["index"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in sample])
    target = (np.array([[r["domain"]] for r in sample]) == np.array(domains)).astype(float) if sample else np.ones((1, 0))
    weights, bias = fit_softmax(rows, target, 1 << BITS) if sample else (np.zeros((1 << BITS, 0)), np.zeros(0))

    def run(batches):
        for batch in slices(batches):
            words = [t.translate(TO_LOWER).split() for t in batch.column("text").to_pylist()]
            found = Rows([features(w) for w in words])
            p = softmax(found.times(weights) + bias) if len(bias) else np.empty((len(words), 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("digest"), pa.array([len(w) for w in words], pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))],
                ["id", "digest", "n_tokens", "posterior"],
            )

    id_type = source.schema["id"].dataType.simpleString()
    return written(source.mapInArrow(run, f"id {id_type}, digest long, n_tokens long, posterior array<double>"), "posteriors"), domains


def replayed(p: np.ndarray, slopes: np.ndarray, momenta: list[float], floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates of documents with posteriors p before the last step so far, after it, and extrapolated."""
    before = w = y = np.full(len(p), max(1.0, floor))
    for slope, momentum in zip((p @ slopes.T).T, momenta, strict=True):
        before, last, w = y, w, np.maximum(floor, y - slope)
        y = np.maximum(floor, w + momentum * (w - last))
    return before, w, y


class Steps:
    """What the steps of a fit left: enough to replay any document's rate, and how far the domains are from their targets."""

    def __init__(self, slopes: np.ndarray, momenta: list[float], residual: np.ndarray, near: np.ndarray):
        self.slopes, self.momenta, self.residual, self.near = slopes, momenta, residual, near

    @property
    def met(self) -> bool:
        return bool((np.abs(self.residual) <= self.near).all())


def fitted(members: DataFrame, expected: np.ndarray, target: np.ndarray, budget: float, floor: float) -> Steps:
    """Steps towards target shares of a budget; expected: the domains' tokens at rate 1."""
    k = len(target)
    share = expected / budget
    scale = np.divide(1.0, share, out=np.zeros(k), where=share > 0)
    near = np.where(target > 0, MET * target, TOLERANCE)

    slopes, momenta, residual, value, since = np.empty((0, k)), [], share * max(1.0, floor) - target, np.inf, 0
    for _ in range(ROUNDS):
        if (np.abs(residual) <= near).all():
            break
        # Momentum starts again when a step led away from the targets.
        value, since = (now := (scale * residual**2).sum()), since if now <= value else 0
        slopes, momenta, since = np.vstack((slopes, scale * residual)), [*momenta, since / (since + 3)], since + 1

        def add(batches, slopes=slopes, momenta=momenta):
            total, moved = np.zeros(k), np.zeros(k)
            for batch in batches:
                p = np.array(batch.column("posterior").flatten()).reshape(-1, k)
                n = np.array(batch.column("n_tokens"), float)
                before, w, y = replayed(p, slopes, momenta, floor)
                total += (y * n) @ p
                moved += ((w - before) * n) @ p
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*total, *moved)], [f"e{i}" for i in range(2 * k)])

        parts = members.select("n_tokens", "posterior").mapInArrow(add, ", ".join(f"e{i} double" for i in range(2 * k)))
        found = np.array(parts.agg(*[F.sum(f"e{i}") for i in range(2 * k)]).first()) / budget
        residual = found[:k] - target
        if (np.abs(found[k:]) <= near / 100).all():
            break
    return Steps(slopes, momenta, residual, near)


def raised(members: DataFrame, expected: np.ndarray, target: np.ndarray, budget: float, floor: float) -> Steps:
    """The fit of the least budget from `budget` on that meets the targets, to a fourth of the last doubling of its excess.

    With a floor, a document that is raised for one domain adds to every other that it is
    partly of, so the budget at which the largest domain just keeps its tokens may be too small.
    """
    excess, short = RAISE, 0.0
    found = fitted(members, expected, target, budget, floor)
    if found.met:
        return found
    while not (more := fitted(members, expected, target, budget * (1 + excess), floor)).met:
        short, excess = excess, 2 * excess
        if excess > MOST_RAISE:
            return more
    for _ in range(2):
        middle = (short + excess) / 2
        found = fitted(members, expected, target, budget * (1 + middle), floor)
        if found.met:
            more, excess = found, middle
        else:
            short = middle
    return more


def rates(members: DataFrame, domains: list[str], targets: dict[str, float], budget: float | None = None, floor=0.0, raise_budget=False) -> DataFrame:
    """members (id, digest, n_tokens, posterior) with their rate.

    targets: weight per domain. budget: expected tokens in all (None: those of the table);
    raise_budget: it may be raised until the targets can be met at the floor.
    """
    if missing := set(targets) - set(domains):
        raise ValueError(f"no labelled rows for {sorted(missing)}")
    k = len(domains)
    target = np.array([targets.get(d, 0.0) for d in domains])
    sums = [F.sum(F.col("n_tokens") * F.get("posterior", F.lit(i))) for i in range(k)]
    total, *rest = members.agg(F.sum("n_tokens"), *sums).first() if k else (0,)
    if not total or not target.sum():
        return members.withColumn("rate", F.lit(max(1.0, floor)))
    steps = (raised if raise_budget else fitted)(members, np.array(rest), target / target.sum(), float(budget or total), floor)
    if not steps.met:
        short = dict(zip(domains, steps.residual.round(6).tolist(), strict=True))
        warnings.warn(f"targets not met after {len(steps.momenta)} rounds, shares less targets: {short}", stacklevel=2)
    slopes, momenta = steps.slopes, steps.momenta

    def rate(batches):
        for batch in batches:
            p = np.array(batch.column("posterior").flatten()).reshape(-1, k)
            w = replayed(p, slopes, momenta, floor)[2]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w)], [*batch.schema.names, "rate"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema) + ", rate double"
    return members.mapInArrow(rate, schema)


def smoothed_targets(members: DataFrame, domains: list[str], power: float) -> dict[str, float]:
    """Targets in proportion to the domains' expected tokens to a power below 1."""
    if not domains:
        return {}
    row = members.agg(*[F.sum(F.col("n_tokens") * F.get("posterior", F.lit(i))) for i in range(len(domains))]).first()
    return {d: (v or 0.0) ** power for d, v in zip(domains, row, strict=True)}


def mixed(docs: DataFrame, found: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """docs, each row as often as its rate says: the whole part, and once more by a hash of id and text below the rest.

    found: id, digest, rate from `rates` over docs.
    """
    once = found.groupBy("id", "digest").agg(F.first("rate").alias("rate"))
    chance = F.pmod(F.xxhash64("id", "digest", F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    counts = once.select("id", "digest", copies.alias("copies"))
    same = docs[id_col].eqNullSafe(counts["id"]) & (F.xxhash64(docs[text_col]) == counts["digest"])
    times = F.explode(F.array_repeat(F.lit(0), counts["copies"]))
    # Columns are told apart by their frame, whatever their names.
    return docs.join(counts, same).select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), times).select("row.*")
