import re

import pytest

from tallyvane.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width):
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            b = words(item)
            k = min(width, len(b))
            grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
            for s in range(len(w) - k + 1) if k else ():
                if tuple(w[s : s + k]) in grams:
                    hit |= set(range(s, s + k))
                    found.add(str(item_id))
        out[doc_id] = (len(w), len(hit), sorted(found), bool(hit))
    return out


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta"),
    (2, "short item"),
    (3, None),
    (4, "!!"),
    (5, "the the the the the"),
    (6, "gamma delta epsilon zeta eta theta"),
    (10, "alpha beta gamma delta, epsilon ZETA"),
    (11, "nowhere to be seen at all"),
]
DOCS = [
    (1, "x alpha BETA gamma; delta epsilon zeta eta theta y"),
    (2, "a short item and a short, item"),
    (3, None),
    (4, ""),
    (5, "the the the the the the the the"),
    (6, "É alpha beta gamma delta nothing"),
    (7, "clean words " * 3000 + "short item"),
    (8, "delta epsilon zeta"),
]


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(d, "BROADCAST_WORDS", bound)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in DOCS], "doc_id long, text string, words string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in d.contamination(docs, items, width=4).collect()}
    want = brute(DOCS, ITEMS, 4)
    assert got == want and sum(w[3] for w in want.values()) >= 4
    clean = d.clean_documents(docs, items, width=4)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(k for k, w in want.items() if not w[3])


def test_repeated_and_null_ids_stay(spark):
    docs = spark.createDataFrame([(1, "short item"), (1, "short item"), (None, "short item"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_hit) for r in d.contamination(docs, items).collect())
    assert got == [(0, 0), (0, 2), (1, 2), (1, 2)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.contamination(docs, items).collect() == []
    some = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert d.contamination(some, items.limit(0)).where("contaminated").collect() == []


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zeta a b gamma c d alpha"), (2, "zeta " + "x " * 30 + "gamma alpha"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha gamma zeta"), (2, None)], "item_id long, text string")
    got = d.proximity_matches(docs, items, terms=3, span=10).collect()
    assert [(r.doc_id, r.item_id, r.start) for r in got] == [(1, "1", 0)]
    near = {r.doc_id: r.near for r in d.contamination(docs, items).collect()}
    assert near == {1: ["1"], 2: [], 3: []}


@pytest.mark.parametrize("name", ["doc", "row", "number"])
def test_names_that_clash(spark, name):
    docs = spark.createDataFrame([(1, "a short item", 7), (2, "clean", 8), (None, None, 9)], f"`{name}` long, text string, extra long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = {r[0] for r in d.contamination(docs, items, id_col=name).where("contaminated").collect()}
    clean = d.clean_documents(docs, items, id_col=name)
    assert bad == {1} and clean.columns == docs.columns and sorted(r.extra for r in clean.collect()) == [8, 9]


def test_long_item_and_phrases_across_blocks(spark):
    item = " ".join(f"w{i}" for i in range(500))
    docs = [(1, "x " * 61 + item), (2, " ".join(f"w{i}" for i in range(100, 111)) + " w0 w1"), (3, " ".join(f"w{i}" for i in range(9))), (4, (item + " ") * 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in d.contamination(frame, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == brute(docs, [(1, item)], 10) and got[1][1] == 500 and got[2][1] == 11 and got[3][1] == 0


def test_no_word_carries_the_text(spark, monkeypatch):
    """With the words of items not broadcast, what is shuffled by word holds ids, places and digests of rows, no texts."""
    plans = {}
    real = d.written
    monkeypatch.setattr(d, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(d, "written", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()) and real(df, label))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
        path = real(docs, "docs")
        assert d.contamination(path, items).count() == len(DOCS)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plans["postings"].split("Generate posexplode")[0]
    assert "Exchange hashpartitioning(term" in above and "text#" not in above
