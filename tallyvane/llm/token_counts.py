"""Token counts: pieces are counted once per distinct pre-token and summed by frequency.

A subword model that never merges across certain places of a text gives each part between
two such places the same pieces wherever it occurs. Where they are is read from the model's
own vocabulary: before a run of spaces (no piece has a space after another character), and
between characters of different groups (two characters are of one group if a chain of
pieces holds them side by side; letters and marks are groups of their own in models that
split by script). So a document's tokens are the sum of its pre-tokens' pieces by their
frequency, and no document is encoded.

Texts are read once, in chunks: a chunk is one row with its distinct pre-tokens and, per
document, their numbers (as gaps) and frequencies. Only the chunks' vocabularies are shuffled, which
grow far slower than texts; a frequent pre-token has one row in a chunk, so no key holds
more than a chunk's share of its vocabulary. They meet in order, so the library sees each
distinct pre-token once; the counts go back to the chunks, whose documents sum them.

Defined cases: a null or empty text has no bytes and no tokens; it stays. Repeated rows and
null ids stay as they are. A very long text is a chunk of its own. Special strings inside
texts are ordinary text, as the library's own default has it. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

SPACE, APART = "▁", "\n"
#: A chunk ends after so many bytes of text, or so many documents.
CHUNK_BYTES, CHUNK_DOCS = 16 << 20, 1 << 15


@cache
def processor(model: str):
    """The library's model, loaded once a process."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model)


@cache
def pre_tokens(model: str) -> re.Pattern:
    """The pattern of the model's pre-tokens; an error if its pieces join a character to a following space."""
    found = processor(model)
    pieces = [found.id_to_piece(i) for i in range(found.get_piece_size()) if not (found.is_byte(i) or found.is_control(i) or found.is_unknown(i))]
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        raise ValueError(f"{model} has pieces across the start of a word: texts cannot be cut there")
    if any(APART in p for p in pieces):
        raise ValueError(f"{model} has pieces with a line end, which is to keep pre-tokens apart from the space before a text")
    group = {c: c for p in pieces if len(p.strip(SPACE)) > 1 for c in p.strip(SPACE)}

    def first(c):
        while group[c] != c:
            group[c] = group[group[c]]
            c = group[c]
        return c

    for p in pieces:
        for a, b in pairwise(p.strip(SPACE)):
            group[first(a)] = first(b)
    groups: dict[str, list[str]] = {}
    for c in sorted(group):
        groups.setdefault(first(c), []).append(f"\\U{ord(c):08x}")
    runs = "|".join(f"[{''.join(held)}]+" for held in groups.values())
    # Spaces go with what follows them; a character of no group is a run by itself.
    return re.compile(f"[ {SPACE}]*(?:{runs}|.)" if runs else f"[ {SPACE}]*.", re.DOTALL)


def pieces_of(words: list[str], model: str) -> list[int]:
    """Pieces of each pre-token. The library puts a space before a text; pre-tokens bring their own, so a line end comes between."""
    before, *found = processor(model).encode([APART, *(APART + w for w in words)], num_threads=1)
    return [len(ids) - len(before) for ids in found]


def packed(parts: list) -> bytes:
    """Whole numbers below 2**32 as compressed bytes: all lowest bytes, all second ones, and so on."""
    planes = np.concatenate(parts).astype("<u4").view(np.uint8).reshape(-1, 4).T if parts else np.empty(0, np.uint8)
    return len(planes.tobytes()).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(held: bytes) -> np.ndarray:
    planes = pa.decompress(held[8:], int.from_bytes(held[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _chunks(docs: DataFrame, model: str, id_col: str, text_col: str) -> DataFrame:
    """(chunk, words, ids, n_bytes, sizes, numbers, times): documents as frequencies of their chunk's distinct pre-tokens, packed."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        find = pre_tokens(model).findall
        first, made = TaskContext.get().partitionId() << 32, 0
        words: dict[str, int] = {}
        ids, n_bytes, sizes, numbers, times = [], [], [], [], []

        def flush():
            nonlocal made
            held = pa.concat_arrays(ids)
            row = [first + made, list(words), held.to_pylist(), n_bytes, packed(sizes), packed(numbers), packed(times)]
            types = [pa.int64(), pa.list_(pa.string()), pa.list_(held.type), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["chunk", "words", "ids", "n_bytes", "sizes", "numbers", "times"])
            made += 1
            for part in (words, ids, n_bytes, sizes, numbers, times):
                part.clear()
            return batch

        for batch in slices(batches, 64):
            for text in batch.column("text"):
                raw = text.as_py()
                tally = Counter(find(" " + raw.decode(errors="replace"))) if raw else {}
                n_bytes.append(len(raw))
                sizes.append([len(tally)])
                found = np.fromiter((words.setdefault(w, len(words)) for w in tally), np.int64, len(tally))
                order = np.argsort(found)
                numbers.append(np.diff(found[order], prepend=0))  # gaps are small numbers
                times.append(np.fromiter(tally.values(), np.int64, len(tally))[order])
            ids.append(batch.column("id"))
            if sum(n_bytes) >= CHUNK_BYTES or len(n_bytes) >= CHUNK_DOCS:
                yield flush()
        if n_bytes:
            yield flush()

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"chunk long, words array<string>, ids array<{id_type}>, n_bytes array<long>, sizes binary, numbers binary, times binary")


def token_counts(docs: DataFrame, model: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of docs, as the sentencepiece model at a path counts them."""
    id_type = docs.schema[id_col].dataType.simpleString()
    chunks = written(_chunks(docs, model, id_col, text_col), "chunks")
    words = chunks.select("chunk", F.posexplode("words").alias("at", "word"))

    def count(batches):
        last, n_last = None, 0
        for batch in slices(batches, 8192):
            coded = batch.column("word").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            known = [n_last] if distinct[0] == last else []
            n = known + pieces_of(distinct[len(known) :], model)
            last, n_last = distinct[-1], n[-1]
            found = (np.array(batch.column("at"), np.int64) << 32) + np.array(n, np.int64)[np.array(coded.indices)]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(found)], ["chunk", "at_n"])

    counted = words.repartition("word").sortWithinPartitions("word").mapInArrow(count, "chunk long, at_n long")
    of_chunk = counted.groupBy("chunk").agg(F.collect_list("at_n").alias("at_n"))
    met = chunks.drop("words").join(of_chunk, "chunk", "left")

    def add(batches):
        for batch in slices(batches, 1):
            sizes, gaps, times = (unpacked(batch.column(c)[0].as_py()) for c in ("sizes", "numbers", "times"))
            found = np.array(batch.column("at_n").flatten(), np.int64)
            pieces = np.empty_like(found)
            pieces[found >> 32] = found & 0xFFFFFFFF
            ends = np.cumsum(sizes)
            numbers = np.concatenate(([0], np.cumsum(gaps)))
            numbers = numbers[1:] - np.repeat(numbers[ends - sizes], sizes)
            upto = np.concatenate(([0], np.cumsum(times * pieces[numbers])))
            columns = [batch.column("ids").flatten(), batch.column("n_bytes").flatten(), pa.array(upto[ends] - upto[ends - sizes], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens"])

    return met.mapInArrow(add, f"id {id_type}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
