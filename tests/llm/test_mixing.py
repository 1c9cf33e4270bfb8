import warnings

import numpy as np
import pytest

from tallyvane.llm import mixing as m

SCHEMA = "id long, digest long, n_tokens long, posterior array<double>"


def members(spark, n=300, k=3, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.3, 0.3, 0.9][:k], n)
    tokens = rng.integers(1, 400, n)
    return spark.createDataFrame([(i, 0, int(t), q.tolist()) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], SCHEMA), p, tokens


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_expected_totals_match_targets(spark, floor):
    df, p, tokens = members(spark)
    budget = 2.0 * tokens.sum() if floor else None
    targets = {"a": 0.35, "b": 0.3, "c": 0.35}
    rows = sorted(m.rates(df, ["a", "b", "c"], targets, budget, floor).collect(), key=lambda r: r.id)
    w = np.array([r.rate for r in rows])
    assert (w >= floor).all()
    shares = (w * tokens) @ p / (budget or tokens.sum())
    assert np.abs(shares - [0.35, 0.3, 0.35]).max() < 1e-3


def test_agrees_with_plain_projected_gradient(spark):
    df, p, tokens = members(spark, 60, 3, 4)
    target = np.array([0.9, 0.05, 0.05])  # some rates end at zero
    w, a = np.ones(60), (p * tokens[:, None]).T / tokens.sum()
    for _ in range(20000):
        w = np.maximum(0, w - 0.5 * (a.T @ (a @ w - target)) / (tokens / tokens.sum()))
    rows = sorted(m.rates(df, ["a", "b", "c"], dict(zip("abc", target, strict=True))).collect(), key=lambda r: r.id)
    got = np.array([r.rate for r in rows])
    assert np.abs(a @ got - a @ w).max() < 5e-3 and (got < 1e-2).any()


@pytest.mark.parametrize("rare", [0.01, 0.0005])
@pytest.mark.parametrize("soft", [False, True])
def test_rare_domains_meet_their_targets(spark, rare, soft):
    tokens, target = np.array([0.6, 0.3, 0.1 - rare, rare]) * 1e6, np.array([0.4, 0.2, 0.2, 0.2])
    p = np.eye(4) * 0.9 + 0.025 if soft else np.eye(4)
    df = spark.createDataFrame([(i, 0, int(tokens[i]), p[i].tolist()) for i in range(4)], SCHEMA)
    w = np.array([r.rate for r in sorted(m.rates(df, list("abcd"), dict(zip("abcd", target.tolist(), strict=True))).collect(), key=lambda r: r.id)])
    assert (np.abs((w * tokens) @ p / tokens.sum() - target) <= m.MET * target + 1e-6).all()


@pytest.mark.parametrize("rare", [1e-3, 1e-4])
def test_rare_language_is_raised_as_the_pipeline_asks(spark, rare):
    tokens = np.array([0.6, 0.3, 0.1 - rare, rare]) * 1e7
    target = tokens**0.8 / (tokens**0.8).sum()
    df = spark.createDataFrame([(i, 0, int(round(tokens[i])), np.eye(4)[i].tolist()) for i in range(4)], SCHEMA)
    budget = (tokens / target).max()
    w = np.array([r.rate for r in sorted(m.rates(df, list("abcd"), dict(zip("abcd", target.tolist(), strict=True)), budget, 1.0).collect(), key=lambda r: r.id)])
    assert np.abs(w / (target * budget / tokens) - 1).max() < 2e-3


def test_targets_out_of_reach_are_reported(spark):
    df = spark.createDataFrame([(0, 0, 100, [0.5, 0.5]), (1, 0, 300, [0.6, 0.4])], SCHEMA)
    with pytest.warns(UserWarning, match="targets not met"):
        w = {r.id: r.rate for r in m.rates(df, ["a", "b"], {"a": 0.9, "b": 0.1}).collect()}
    assert w[1] > 1 and w[0] < 0.05


def test_posteriors_mixed_and_odd_rows(spark):
    rows = [(i, ("der die und " if i % 3 else "the of and ") * (1 + i % 5), "x") for i in range(60)] + [(60, None, "x"), (None, "the of", "x"), (4, "der die und " * 4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    labelled = spark.createDataFrame([(i, "de" if i % 3 else "en") for i in range(0, 60, 2)] + [(None, "en"), (5, None)], "doc_id long, domain string")
    found, domains = m.posteriors(docs, labelled)
    assert domains == ["de", "en"]
    for r in found.where("n_tokens > 0 and id is not null").collect():
        assert (r.posterior[0] > 0.5) == bool(r.id % 3)
    rated = m.rates(found, domains, {"de": 1, "en": 1}, budget=None)
    assert rated.count() == len(rows)
    out = m.mixed(docs, rated)
    assert out.columns == docs.columns
    en = out.where("text like 'the%'").count()
    assert en > 20


def test_empty_and_unlabelled(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labelled = spark.createDataFrame([], "doc_id long, domain string")
    found, domains = m.posteriors(docs, labelled)
    assert domains == [] and m.rates(found, domains, {}).collect() == []
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found, domains = m.posteriors(some, labelled)
    rated = m.rates(found, domains, {})
    assert [r.rate for r in rated.collect()] == [1.0, 1.0] and m.mixed(some, rated).count() == 2
    with pytest.raises(ValueError):
        m.rates(found, domains, {"en": 1.0})


def test_query_meets_the_targets_and_the_optimum(spark):
    """Rates of the query against plain numpy over its own posteriors, and these against the languages."""
    from tallyvane.llm.queries import MIX, op1_mixing

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.n_tokens == len((docs[r.doc_id].text or "").encode().split()) for r in rows)
    told = [r.domains[int(np.argmax(r.posterior))] == docs[r.doc_id].lang for r in rows if r.n_tokens >= 20]
    assert np.mean(told) > 0.95
    n, p, w = np.array([r.n_tokens for r in rows], float), np.array([r.posterior for r in rows]), np.array([r.rate for r in rows])
    target = np.array([MIX[d] for d in rows[0].domains])
    assert np.allclose(p.sum(axis=1), 1) and (w >= 0).all()
    assert (np.abs((w * n) @ p / n.sum() - target) <= 2e-3 * target).all()


def test_posteriors_equal_a_plain_fit(spark):
    """Dense numpy over all labelled rows gives the same posteriors."""
    from tallyvane.llm.linear import Adam

    rng = np.random.default_rng(3)
    words = {"a": ["red", "blue", "x"], "b": ["one", "two", "x"], "c": ["x", "y", "z"]}
    rows = [(i, " ".join(rng.choice(words["abc"[i % 3]], 6)), "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found, domains = m.posteriors(docs, spark.createDataFrame([(i, d) for i, _, d in rows], "doc_id long, domain string"))
    dense = np.zeros((60, 1 << m.BITS))
    for i, text, _ in rows:
        index, value = m.features(text.encode().split())
        dense[i, index] = value
    target = np.eye(3)[[i % 3 for i in range(60)]]
    weights, bias = np.zeros((1 << m.BITS, 3)), np.log(target.mean(axis=0) + 1e-6)
    by_weight, by_bias = Adam(weights.shape, 0.1), Adam(bias.shape, 0.1)
    for _ in range(120):
        z = np.exp(dense @ weights + bias)
        error = (z / z.sum(axis=1, keepdims=True) - target) / 60
        weights -= by_weight.step(dense.T @ error + 1e-4 * weights)
        bias -= by_bias.step(error.sum(axis=0))
    z = np.exp(dense @ weights + bias)
    got = {r.id: r.posterior for r in found.collect()}
    assert domains == ["a", "b", "c"] and np.abs(np.array([got[i] for i in range(60)]) - z / z.sum(axis=1, keepdims=True)).max() < 1e-3


@pytest.mark.parametrize("elsewhere", [0.0, 0.01, 0.05])
def test_raised_budget_meets_targets_at_the_floor(spark, elsewhere):
    """Soft posteriors: raising one domain adds to the others, so the budget has to grow."""
    tokens = np.array([0.7, 0.2, 0.07, 0.03]) * 1e6
    p = np.eye(4) * (1 - elsewhere - elsewhere / 3) + elsewhere / 3
    expected = tokens @ p
    target = expected**0.8 / (expected**0.8).sum()
    budget = (expected / target).max()
    df = spark.createDataFrame([(i, 0, int(tokens[i]), p[i].tolist()) for i in range(4)], SCHEMA)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        rows = m.rates(df, list("abcd"), dict(zip("abcd", target.tolist(), strict=True)), budget, 1.0, raise_budget=True).collect()
    w = np.array([r.rate for r in sorted(rows)])
    got = (w * tokens) @ p
    assert (w >= 1).all() and (np.abs(got / got.sum() - target) <= 2 * m.MET * target).all()
    assert got.sum() <= budget * (1 + 4 * elsewhere + 1e-3)


@pytest.mark.parametrize("name", ["__id", "__copies", "__digest", "id", "digest", "copies", "row", "rate", "col"])
def test_clashing_names_stay(spark, name):
    docs = spark.createDataFrame([(1, "the of", 7), (2, "der die", 8), (2, "der die", 9)], f"doc_id long, text string, `{name}` int")
    labelled = spark.createDataFrame([(1, "en"), (2, "de")], "doc_id long, domain string")
    out = m.mixed(docs, m.rates(*m.posteriors(docs, labelled), {"de": 0.4, "en": 0.6}, floor=1.0, budget=24.0))
    assert out.columns == docs.columns and {r[2] for r in out.collect()} == {7, 8, 9}
