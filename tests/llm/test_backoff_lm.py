import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyvane.llm import backoff_lm as lm


def words(text):
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.split("[ \t\n\v\f\r]+", plain) if w]


def brute(rows):
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in rows]
    uni, bi, n_docs = Counter(), Counter(), 0
    for (_, text), h in zip(rows, held, strict=True):
        if not h:
            seq = [*words(text), None]
            uni.update(seq)
            bi.update(zip([0, *seq[:-1]], seq, strict=True))
            n_docs += 1
    n, z = sum(uni.values()), sum(uni.values()) + 0.5 * (len(uni) + 1)
    out = []
    for (i, text), h in zip(rows, held, strict=True):
        seq, base, score, prev = [*words(text), None], 0.0, 0.0, 0
        for w in seq:
            p = (uni[w] + 0.5) / z
            c = n_docs if prev == 0 else uni[prev]
            base += math.log10(p)
            score += math.log10((bi[prev, w] + lm.MU * p) / (c + lm.MU)) if c else math.log10(p)
            prev = w
        out.append((i, h, len(seq), sum(uni[w] > 0 for w in seq), n, base, score))
    return out


ROWS = [(i, t) for i, t in enumerate(["the cat sat", "The cat ran", None, "", "a  b\tc\nd", "the cat sat on the mat " * 300, "unseen words here", "the cat", "É é the"] * 3)]


@pytest.mark.parametrize("chunk", [64, 8 << 20])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
    rows = [*ROWS, (None, "the cat"), (3, "the cat sat")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int")
    got = lm.lm_scores(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    key = lambda r: [str(x) for x in r[:5]] + [round(r[5], 6)]
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:])


def test_model_is_a_distribution_over_known_unknown_and_end():
    uni, z = np.array([5.0, 3.0, 2.0]), 10 + 0.5 * 4
    p = np.append((uni + 0.5) / z, 0.5 / z)
    follow = np.array([2, 1, 0, 0])
    assert np.isclose(p.sum(), 1) and np.isclose(((follow + lm.MU * p) / (3 + lm.MU)).sum(), 1)


def test_empty_and_nothing_learnt(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.lm_scores(empty).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    one = lm.lm_scores(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).collect()[0]
    assert one.held_out and one.train_tokens == 0 and one.n_known == 0 and one.score == one.base_score


def test_counts_round_trip():
    counts = np.array([0, 1, 254, 255, 256, 2**40])
    assert (lm.unpack_counts(lm.pack_counts(counts), len(counts)) == counts).all()


def test_held_out_text_is_better_told_than_by_the_base(spark):
    from tallyvane.llm.queries import op4_backoff_lm

    rows = op4_backoff_lm(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_copies_of_one_row_are_spread(spark):
    docs = spark.range(0, 20_000, 1, 8).selectExpr("7L AS doc_id", "'one text in all rows' AS text").unionByName(spark.createDataFrame([(1, "another")], "doc_id long, text string"))
    rows = lm.lm_scores(docs).groupBy("doc_id", "score").count().collect()
    assert sorted((r.doc_id, r["count"]) for r in rows) == [(1, 1), (7, 20_000)]
