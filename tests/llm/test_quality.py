import numpy as np
import xxhash

from tallyvane.llm import quality as q
from tallyvane.llm.queries import op5_quality


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.2
    hit, false = np.array([0.8, 0.6, 0.7, 0.5]), np.array([0.02, 0.05, 0.01, 0.1])
    votes = -(rng.random((len(truth), 4)) < np.where(truth[:, None], hit, false)).astype(int)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, table, posterior = q.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.2) < 0.02
    assert np.abs(table[:, 0, 1] - hit).max() < 0.05 and np.abs(table[:, 0, 0] - false).max() < 0.02
    assert ((posterior[where.ravel()] > 0.5) == truth).mean() > 0.95


def test_query_agrees_with_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = got.select("quality", "keep").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_odd_rows_and_kept_columns(spark):
    rows = [(i, f"A quiet sentence about number {i}, and another. It ends here.", "s") for i in range(80)]
    rows += [(100 + i, "BUY NOW!! " * 30 + "###", "s") for i in range(20)] + [(200, None, "s"), (201, "", "s"), (None, "A fine line of words, it is.", "s"), (3, rows[3][1], "s"), (202, "word " * 100_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {(r.doc_id, r.keep) for r in q.scored(docs).collect()}
    assert q.scored(docs).count() == len(rows)
    assert all((i, True) in got for i in range(80)) and all((100 + i, False) in got for i in range(20))
    kept = q.kept(docs)
    assert kept.columns == docs.columns and kept.where("doc_id < 80").count() == 81
    assert q.scored(docs.limit(0)).collect() == [] and q.kept(docs.limit(0)).collect() == []


def plain_features(text: bytes) -> dict[int, float]:
    """Word shapes by the root of their share, and halves for binned signals, counted plainly."""
    shape = lambda w: bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in w)
    words = text.split()
    out: dict[int, float] = {}
    for w in words:
        i = xxhash.xxh3_64_intdigest(shape(w)) % (1 << q.BITS)
        out[i] = out.get(i, 0) + 1 / len(words)
    out = {i: v**0.5 for i, v in out.items()}
    for name, x in zip(q.SIGNALS, q.signals(text, words), strict=True):
        i = xxhash.xxh3_64_intdigest(f"{name}:{int(6 * np.log2(1 + 50 * min(x, 4)))}".encode()) % (1 << q.BITS)
        out[i] = out.get(i, 0) + 0.5
    return out


def test_query_equals_a_plain_fit(spark):
    """EM per document and a scorer of all rows by accelerated dense gradient steps, without Spark."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.text or "").encode() for r in rows]
    votes = np.array([q.votes(q.signals(t, t.split())) for t in texts])
    bad = np.where((votes == -1).sum(axis=1) - 0.5 * (votes == 1).sum(axis=1) > 0, 0.9, 0.05)
    for _ in range(200):
        odds = np.full(len(votes), np.log((bad.sum() + 1) / (len(bad) - bad.sum() + 1)))
        for k in range(votes.shape[1]):
            seen = lambda weight, v, k=k: weight[votes[:, k] == v].sum() + 0.5
            for v in (-1, 0, 1):
                on_bad = seen(bad, v) / sum(seen(bad, u) for u in (-1, 0, 1))
                on_good = seen(1 - bad, v) / sum(seen(1 - bad, u) for u in (-1, 0, 1))
                odds[votes[:, k] == v] += np.log(on_bad / on_good)
        bad = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    found = [plain_features(t) for t in texts]
    columns = {i: c for c, i in enumerate(sorted(set().union(*found)))}
    x = np.zeros((len(texts), len(columns) + 1))
    for r, f in enumerate(found):
        for i, v in f.items():
            x[r, columns[i]] = v
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    y, decay = w.copy(), np.append(np.full(len(columns), q.DECAY), 0)
    step = 1 / (0.25 * np.linalg.eigvalsh(x @ x.T / len(x)).max() + q.DECAY)
    for k in range(6000):
        p = 1 / (1 + np.exp(-x @ y))
        new = y - step * (x.T @ (p - (1 - bad)) / len(x) + decay * y)
        w, y = new, new + k / (k + 3) * (new - w)
    want = 1 / (1 + np.exp(-x @ w))
    got = {r.doc_id: r.score for r in op5_quality(spark, sf).collect()}
    told = np.array([got[r.doc_id] for r in rows])
    assert np.abs(told - want).max() < 0.02 and ((told >= 0.5) == (want >= 0.5)).all()


def test_every_row_teaches(spark):
    """Rare rows that a sample would miss: one kind of junk among thousands of sentences is told from them."""
    rows = [(i, f"A quiet sentence about number {i}, and another. It ends here.") for i in range(3_000)] + [(5_000 + i, "BUY NOW!! " * 30 + "###") for i in range(3)]
    got = {r.doc_id: r.keep for r in q.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert not any(got[5_000 + i] for i in range(3)) and all(got[i] for i in range(3_000))
