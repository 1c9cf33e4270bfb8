import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyvane.llm import token_output as t
from tallyvane.llm.queries import op7_token_output, word_vocabulary


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_block_round_trip(values):
    ids = np.array(values, np.uint32)
    block = t.pack_block(ids)
    back, used = t.unpack_block(memoryview(block))
    assert used == len(block) and (back == ids).all()


def test_many_blocks_round_trip():
    ids = np.random.default_rng(1).integers(0, 49408, 3 * t.BLOCK + 7).astype(np.uint32)
    payload, starts, offsets = t.pack(ids)
    assert (t.unpack(payload) == ids).all() and starts == [0, t.BLOCK, 2 * t.BLOCK, 3 * t.BLOCK]
    assert (t.unpack_block(memoryview(payload)[offsets[2] :])[0] == ids[2 * t.BLOCK : 3 * t.BLOCK]).all()
    assert len(t.unpack(b"")) == 0


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(word_vocabulary()), 0, []
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_equals_plain_encoding(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, op7_token_output(spark, sf).collect())) == expected(rows)


def test_odd_rows(spark):
    texts = ["", None, " \n\t ", 'quotes "x"  nbsp line', "<|endoftext|> é ≠ don't I'LL 12345", "word " * 70000]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, x, 0) for i, x in rows], "doc_id long, text string, start int")
    path = t.write_tokens(docs, word_vocabulary())
    assert sorted(map(tuple, t.read_tokens(spark, path).collect())) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(None, "b"), (2, "same"), (2, "same"), (None, None)]])
def test_empty_null_and_repeated(spark, rows):
    path = t.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), word_vocabulary())
    got = t.read_tokens(spark, path, with_ids=True).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert sorted(r.start for r in got) == list(np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1])
    assert all(r.ids[-1] == 1 and len(r.ids) == r.n_tokens for r in got)


ODD = list("abcXYZ 019.,;:!?#$%&*()-|'\n\tİıßÉñ’“—ΣςσΔЖ中文あア한ﬁ́̇ǅ̧​ 　")


def test_words_get_the_tokenizers_own_ids():
    ids = t.WordIds(word_vocabulary())
    rng = np.random.default_rng(7)
    texts = ["CUMHURİYETİ. — x", "İ. —", *("".join(rng.choice(ODD, rng.integers(0, 14))) for _ in range(8000))]
    for text in texts:
        assert ids.encode(text) == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_documents_are_read_from_their_blocks_alone(spark, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 64)
    ids = np.arange(1000, dtype=np.uint32)
    payload, starts, offsets = t.pack(ids)
    decoded = []
    whole = t.unpack_block
    monkeypatch.setattr(t, "unpack_block", lambda data: decoded.append(1) or whole(data))
    for a, b, blocks in [(0, 64, 1), (63, 65, 2), (130, 140, 1), (900, 1000, 2), (5, 5, 1)]:
        decoded.clear()
        assert (t.unpack_between(payload, starts, offsets, a, b) == ids[a:b]).all() and len(decoded) == blocks
    monkeypatch.undo()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    path = t.write_tokens(docs, word_vocabulary())
    want = {r.doc_id: r.ids for r in t.read_tokens(spark, path, with_ids=True).collect()}
    asked = [0, 7, 150, 10**9]
    assert {r.doc_id: r.ids for r in t.read_documents(spark, path, asked).collect()} == {i: want[i] for i in asked if i in want}
    assert t.read_documents(spark, path, []).collect() == []


def test_places_add_up_over_groups_of_shards(spark, monkeypatch):
    monkeypatch.setattr(t, "SHARD_GROUP", 3)
    rows = [(s, 10 * s + k) for s in range(11) for k in range(2)]
    got = {r.shard: r.shard_start for r in t.shard_starts(spark.createDataFrame(rows, "shard int, n_ids long")).collect()}
    assert got == {s: sum(n for o, n in rows if o < s) for s in range(11)}
