import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from tallyvane.llm.queries import word_vocabulary

from .test_decontaminate import brute
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_follows_the_labels(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in texts(stages[1])}
    judged = [(q, i in kept) for i, q in labels.items()]
    assert sum(bool(q) == k for q, k in judged) / len(judged) > 0.95


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[1]), {i for i, _ in texts(stages[2])}
    roots = brute_components([brute_fingerprint(t) for _, t in before])
    groups = {}
    for (i, _), r in zip(before, roots, strict=True):
        groups.setdefault(r, []).append(i)
    assert after == {min(g) for g in groups.values()}


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before = texts(stages[2])
    assert [i for i, _ in texts(stages[3])] == [i for i, v in sorted(brute(before, items, 10).items()) if not v[3]]


def test_mixing_keeps_all_and_moves_towards_targets(stages):
    before = Counter(i for i, _ in texts(stages[3]))
    after = Counter(i for i, _ in texts(stages[4]))
    assert set(before) == set(after) and all(after[i] >= n for i, n in before.items())
    assert after.total() > before.total()


def test_files_hold_the_tokens(stages):
    from tokenizers import Tokenizer

    tokenizer, at, want = Tokenizer.from_file(word_vocabulary()), 0, []
    for i, t in texts(stages[4]):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, stages[5].collect())) == want


def test_run_returns_the_same(spark, stages):
    got = cp.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[5].collect()))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (1, "", "en", "s", 0, 2), (2, "A fine sentence of words, it is.", "en", "s", 5, 3), (3, "A fine sentence of words, it is.", None, None, None, 4), (4, "word " * 30_000, "de", "s", 9, 5)]])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        seen[name] = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert seen["benchmark decontamination"] == seen["mixing to target weights"] == sorted((r[0] or 0, r[1] or "") for r in rows)
    if rows:
        assert [r[0] for r in seen["SimHash near-dedup"]] == [1, 2, 4]
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


@pytest.mark.parametrize("names", [["id", "digest", "copies", "row", "rate"], ["__id", "__digest", "__copies", "__bad_id", "__bad_digest"], ["fp", "first", "root", "key", "words"], ["term", "number", "pos", "at", "n_words"]])
def test_stages_on_clashing_names(spark, tmp_path, names):
    rows = [(i, t, "en", "s", 1, *range(5)) for i, t in enumerate(["A fine sentence of words, it is.", "A fine sentence of words, it is.", "Another one, with other words in it.", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    spark.createDataFrame([(0, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this"), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert all(tuple(r)[5:] == tuple(range(5)) for r in out.collect()), name
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
