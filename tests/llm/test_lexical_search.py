"""Ranked search against every document scored plainly."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tallyvane.llm import lexical_search as s
from tallyvane.llm import queries as q

SF = "/root/testdata/sf0.001"


def terms(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, top):
    """Rows (item, rank, id, score), every document scored for every item."""
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n, length, df = len(held), sum(x for _, _, x in held), Counter(t for _, c, _ in held for t in c)
    of_item = {}
    for i, t in items:
        of_item.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in of_item.items():
        found = []
        for i, c, size in held:
            m = 100 - 50 + 50 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found, key=lambda r: r[:3])[:top], 1)]
    return sorted(out, key=str)


def corpus(n, seed, words=60):
    """Documents of Zipf words: some lists are long, some short; copies give ties."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    weight = [1 / (k + 1) for k in range(words)]
    texts = [" ".join(r.choices(vocabulary, weight, k=r.randint(1, 40))) for _ in range(n)]
    return [(i, texts[r.randrange(n // 2)] if r.random() < 0.3 else texts[i]) for i in range(n)]


@pytest.mark.parametrize("short", [0, 1 / 32, 0.3, 1])
@pytest.mark.parametrize("top", [1, 7, 50])
def test_any_division_into_short_and_long(short, top, monkeypatch):
    """Accumulators alone, iterators alone, and both together give the same best documents."""
    monkeypatch.setattr(s, "STRIDE", 16)
    r = np.random.default_rng(top)
    for _ in range(20):
        lists = []
        for share in (0.02, 0.05, 0.2, 0.6, 0.9):
            docs = np.flatnonzero(r.random(300) < share)
            scores = r.integers(1, 9, len(docs)) * 10
            if len(docs):
                lists.append((docs, scores, int(scores.max())))
        total = np.zeros(300, np.int64)
        for docs, scores, _ in lists:
            total[docs] += scores
        want = sorted((-x, d) for d, x in enumerate(total.tolist()) if x)[:top]
        docs, scores = s.best_of(lists, 300, top, short=short)
        assert sorted((-x, d) for d, x in zip(docs.tolist(), scores.tolist(), strict=True))[:top] == want
        assert (total[docs] == scores).all()


def test_long_lists_are_skipped(monkeypatch):
    """Documents that only a weak long list holds are never candidates once better ones are known."""
    looked = []
    real = np.searchsorted
    monkeypatch.setattr(s.np, "searchsorted", lambda a, v, **k: looked.append(np.size(v)) or real(a, v, **k))
    rare, common = np.arange(0, 60_000, 600), np.arange(60_000)
    docs, scores = s.best_of([(common, np.ones(60_000, np.int64), 1), (rare, np.full(100, 50), 50)], 60_000, 10)
    assert len(docs) == 100 and (scores == 51).all() and sum(looked) < 1_000


def test_query_of_the_operator(spark, monkeypatch):
    """Small blocks, sets and strides; repeated ids and rows, nulls, ties at the last rank, clashing columns."""
    monkeypatch.setattr(s, "BLOCK_POSTINGS", 200)
    monkeypatch.setattr(s, "STRIDE", 8)
    monkeypatch.setattr(s, "SET_QUERIES", 3)
    docs = corpus(300, 5) + [(None, "w0 w1 w1"), (7, "w0 W1 W1"), (1000, None), (1001, ""), (1002, "... --"), (1003, "w3 " * 20_000 + "ÄÖ"), (5, "w2,w2;W2")]
    items = [(1, "w0 w1 w2"), (1, "W40 w1"), (2, "w50 unknown"), (3, None), (4, ""), (None, "w3 äÖ ÄÖ"), (6, "unknown"), (7, "w0 " * 300), (8, " ".join(f"w{k}" for k in range(60)))]
    d = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], "doc_id bigint, text string, ids int, terms int, rank int, score int").repartition(5)
    b = spark.createDataFrame([(i, t, 0, 0) for i, t in items], "item_id bigint, text string, query int, name int")
    got = sorted(map(tuple, s.lexical_search(d, b, top=9).collect()), key=str)
    assert got == plain(docs, items, 9)


def test_text_ids(spark):
    docs = [("b", "x y"), ("a", "x y"), (None, "x y"), ("ä", "x y"), ("c", "z")]
    d = spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    b = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [r["doc_id"] for r in s.lexical_search(d, b, top=3).orderBy("rank").collect()] == ["a", "b", "ä"]


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(1, "x")], "item_id bigint, text string")
    assert s.lexical_search(d, b).collect() == [] and s.lexical_search(d, one).collect() == []
    assert s.lexical_search(one.withColumnRenamed("item_id", "doc_id"), b).collect() == []


def test_registered_query(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = sorted(map(tuple, q.op12_lexical_search(spark, SF).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain(docs, items, 50) and got
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({q.ORACLES['op12_lexical_search']})").fetchall()
    assert sorted(sql, key=str) == got
