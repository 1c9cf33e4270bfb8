"""Token counts against the library itself, over whole texts."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyvane.llm import queries as q
from tallyvane.llm import token_counts as t

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def plain(library, text):
    return len(library.encode(text or "", num_threads=1))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab e, s. ▁\n\t0159.,-<s>éß–“(²!=$日本\U0001f600\x00  theing"), max_size=60))
def test_any_text(text):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    words = t.pre_tokens(MODEL).findall(" " + text) if text else []
    assert "".join(words) == (" " + text if text else "")
    assert sum(t.pieces_of(words, MODEL)) == plain(library, text)


def test_defined_cases(spark, library, monkeypatch):
    monkeypatch.setattr(t, "CHUNK_DOCS", 3)
    texts = [None, "", " ", "  two  spaces ", "the the the", "x" * 30_000, "word " * 20_000, "日本語" * 50, "a\nb\r\n\tc", "<s></s><unk>", "▁ ▁▁x"] * 2
    ids = [None, *range(1, len(texts) - 1), 1]
    rows = [(i, x, "clash", "clash", "clash") for i, x in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, chunk string, id string, n_tokens string").repartition(3)
    got = sorted(map(tuple, t.token_counts(df, MODEL).collect()), key=str)
    want = sorted(((i, len((x or "").encode()), plain(library, x)) for i, x in zip(ids, texts, strict=True)), key=str)
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert t.token_counts(df, MODEL).collect() == []


def test_one_row_a_distinct_pre_token(spark, monkeypatch):
    """A pre-token that all chunks hold reaches the library once."""
    df = spark.createDataFrame([(i, "same words here") for i in range(40)], "doc_id bigint, text string").repartition(8)
    assert {r["n_tokens"] for r in t.token_counts(df, MODEL).collect()} == {3}
    chunks = t._chunks(df, MODEL, "doc_id", "text")
    assert chunks.count() <= 8 and chunks.selectExpr("inline(transform(words, w -> struct(w)))").distinct().count() == 3


def test_query_by_the_library(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in q.op11_token_counts(spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r["doc_id"]: (len((r["text"] or "").encode()), n := plain(library, r["text"]), n > 4096) for r in docs}
    assert got == want and len(docs) == len(got)
