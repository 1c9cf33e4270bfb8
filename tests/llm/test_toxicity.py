import zlib

import numpy as np

from tallyvane.llm import toxicity as t
from tallyvane.llm.linear import Rows, lbfgs
from tallyvane.llm.queries import op10_toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.85 and np.mean([r.predicted for r in clean]) < 0.04
    assert np.mean([r.score for r in toxic]) > np.mean([r.score for r in clean]) + 0.5


def test_nnpu_separates_without_negatives():
    rng = np.random.default_rng(0)
    row = lambda ids: (np.unique(np.array(ids, np.int64)), np.ones(len(set(ids))))
    positive = Rows([row([7, *rng.integers(100, 900, 20)]) for _ in range(150)])
    u = Rows([row([*([7] if i % 10 == 0 else []), *rng.integers(100, 900, 20)]) for i in range(1500)])

    def unlabelled(x):
        g = u.times(x[:-1, None])[:, 0] + x[-1]
        p = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        return u.n, np.logaddexp(0, g).sum(), *u.back(p[:, None], 900)[:, 0], p.sum()

    x = t.nnpu(positive, unlabelled, 0.1, 900)
    assert x[-1] < 0 < x[-1] + x[7]


def test_held_rows_never_teach(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, "badword here" if i % 2 else "fine words") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got = t.toxicity(docs, labels).collect()
    assert len(got) == len(ids) and all(r.held_out and r.score == 0 and r.predicted == 0 for r in got)


def test_a_rare_kind_of_toxicity_has_features(spark):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5]
    held = [i for i in range(100) if i not in set(ids)]
    toxic = ids[::4]
    rare = set(toxic[::100])  # one per cent of the positives, with its own vocabulary
    toxic_ids = set(toxic)
    docs = [(i, f"item {i} speaks {'vilest' if i in rare else 'horrid' if i in toxic_ids else 'gentle'} words") for i in ids] + [(i, f"row {i} is vilest") for i in held]
    labels = spark.createDataFrame([(i, int(i in toxic_ids)) for i in ids], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in t.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()}
    assert all(got[i] for i in rare) and all(got[i] for i in held)
    assert not any(got[i] for i in ids if i not in toxic_ids)


def test_copies_of_one_text_are_no_features(spark):
    docs = spark.createDataFrame([(i, "copied notice again" if i < 60 else f"plain text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(400)], "doc_id long, toxic int")
    assert len(t.fit(docs, labels)[1]) == 0


def test_odd_rows(spark):
    rows = [(i, f"word{i} filler text " + ("awful " if i % 4 == 0 else "")) for i in range(200)] + [(300, None), (301, ""), (None, "awful"), (4, "word4 awful"), (302, "long " * 100_000)]
    docs = spark.createDataFrame([(i, x, 0.5) for i, x in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(200) if i != 7] + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    got = t.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got if r.doc_id != 4}
    assert by[300] == by[301] == by[302] == 0 and by[8] == 1 and by[9] == 0
    assert t.toxicity(docs.limit(0), labels).collect() == []


def test_beginnings_end_between_characters():
    assert list(t.beginnings(b"abcdefghij")) == [b"abcde", b"abcdef", b"abcdefg", b"abcdefgh"]
    assert list(t.beginnings(b"abcde")) == [b"abcde"] and list(t.beginnings(b"abcd")) == []
    assert [b.decode() for b in t.beginnings("été où".replace(" ", "").encode())] == ["été", "étéo", "étéoù"]


def test_features_and_scores_equal_plain_counting(spark):
    """Features by document frequencies of all learnable rows, then the risk over all of them minimised by dense numpy, through the query's own scores."""
    rng = np.random.default_rng(5)
    vocabulary = [f"term{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocabulary, 8)) + (f" nasty{i % 3} slur" if i % 5 == 0 else "")) for i in range(600)]
    learnable = [(i, x) for i, x in rows if zlib.crc32(str(i).encode()) % 5]
    labels = [(i, int(i % 5 == 0)) for i, _ in rows if i % 2 == 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    toxic = {i for i, x in labels if x}
    counts = {i: dict(zip(*(a.tolist() for a in t.features(x.encode())), strict=True)) for i, x in rows}
    in_p = {x: i for i, x in learnable if i in toxic}
    n_p, n_u, want = len(in_p), len(learnable), []
    for f in sorted(set().union(*(counts[i] for i, _ in learnable))):
        df_p, df_u = sum(f in counts[i] for i in in_p.values()), sum(f in counts[i] for i, _ in learnable)
        share = (df_u + 1) / (n_u + 2)
        if df_p >= t.MIN_POSITIVES and (df_p / n_p - share) / np.sqrt(share * (1 - share) / n_p + 1e-12) > t.MIN_Z:
            want.append(f)
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    _, chosen, _ = t.fit(docs, frame)
    assert chosen.tolist() == want and want
    dense = lambda ids: np.array([[counts[i].get(f, 0.0) for f in want] + [1.0] for i in ids])
    everyone, u, p = dense([i for i, _ in rows]), dense([i for i, _ in learnable]), dense([i for i, _ in learnable if i in toxic])
    known = [x for i, x in labels if zlib.crc32(str(i).encode()) % 5]
    prior = sum(known) / len(known)

    def risk(w):
        rest = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        return prior * np.logaddexp(0, -p @ w).mean() + abs(rest) + t.DECAY / 2 * (w[:-1] @ w[:-1]), np.sign(rest)

    best, w, m, v = np.inf, np.append(np.zeros(len(want)), np.log(prior / (1 - prior))), 0.0, 0.0
    sigmoid = lambda g: 1 / (1 + np.exp(-g))
    for k in range(1, 8001):  # plain Adam with falling steps
        value, sign = risk(w)
        best = min(best, value)
        grad = prior * p.T @ (sigmoid(p @ w) - 1) / len(p) + sign * (u.T @ sigmoid(u @ w) / len(u) - prior * p.T @ sigmoid(p @ w) / len(p)) + t.DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.05 / (1 + k / 500) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    scores = {r.doc_id: r.score for r in t.toxicity(docs, frame).collect()}
    got = np.array([scores[i] for i, _ in rows])
    logits = np.log(got / (1 - got))
    own = np.linalg.lstsq(everyone, logits, rcond=None)[0]  # the query's weights, read off its scores
    assert np.abs(everyone @ own - logits).max() < 1e-3
    assert risk(own)[0] <= best + 2e-3
    assert all((scores[i] >= 0.5) == (i % 5 == 0) for i, _ in rows)


def test_lbfgs_finds_the_minimum():
    """A quadratic with curvatures from 1 to 10,000."""
    curve, at = np.logspace(0, 4, 30), np.arange(30.0)
    found = lbfgs(lambda x: (0.5 * (curve * (x - at) ** 2).sum(), curve * (x - at)), np.zeros(30), 1000, 1e-6)
    assert np.abs(found - at).max() < 1e-4


def test_numbers_among_some_features_are_those_of_all():
    text = "Horrid horrid, vilest été plain words".encode()
    index, value = t.features(text)
    assert sorted(t.present(text).tolist()) == index.tolist()
    some = index[::2]
    among = t.numbers_among(some)
    near, of_near = t.features(text, among)
    assert near.tolist() == some.tolist() and of_near.tolist() == value[::2].tolist()
    assert sorted(t.present(text, among).tolist()) == some.tolist() and t.present(b"", among).size == 0
