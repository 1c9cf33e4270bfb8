"""Language-model scoring with a weighted backoff automaton.

The model is a bigram model with Dirichlet smoothing over a smoothed unigram model:

    P(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))          an unknown word has c = 0
    P(w | h) = (c(h w) + MU P(w)) / (c(h) + MU)

As an automaton: the root has an arc for every word; every training word, and the start
of a text, is a state with one arc per bigram seen after it and a failure arc of weight
log10(MU / (c(h) + MU)) to the root. A text is read once from left to right: the state
goes along, failure arcs and word arcs add their weights.

The counts never come together in one place. Documents are dealt to chunks by hash; a
chunk sends its distinct n-grams (64-bit hashes, with training counts) to buckets by
hash; a bucket sums them and answers each chunk with the totals it asked for. A chunk
then builds just its part of the automaton and runs its documents through it. A frequent
n-gram adds one entry per chunk, however often it occurs.

Two different n-grams share a 64-bit hash with a probability of about n**2 / 2**65.

Defined cases: a null or empty text is the end token alone. A null id counts as empty
text for the split. Repeated rows stay repeated (each counts). If no row is learnt from,
N and V are 0 and all words are unknown. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, crc32_mod, shuffle_width

MU = 500.0
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
#: Beyond so many tasks each takes several chunks or buckets, one after another.
MOST_TASKS = 50_000
#: Words never hold white space, so these two stand for no word.
START, END = (xxhash.xxh3_64_intdigest(b) for b in (b" ", b"\n"))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29))


class _Hashes(dict):
    """Word to hash, computed once per word and chunk."""

    def __missing__(self, word):
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def tokens_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens of all texts in a row, each ended; and where each text ends (exclusive)."""
    seen, out, ends = _Hashes(), [], []
    for text in texts:
        words = text.translate(TO_LOWER).split()
        ids = np.empty(len(words) + 1, np.uint64)
        ids[:-1] = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        ids[-1] = END
        out.append(ids)
        ends.append(len(ids))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.cumsum(ends, dtype=np.int64)


def bigram_keys(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of (previous token, token) at every place; START comes before a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate(([0], ends[:-1])) if len(ends) else []] = START
    mixed = (before * _MIX[0]) ^ (tokens + _MIX[1])
    return (mixed ^ (mixed >> _MIX[2])) * _MIX[1]


def _grams(table: pa.Table):
    """Tokens, ends, and all n-gram keys of a chunk: distinct, with training counts and inverse."""
    tokens, ends = tokens_of(table.column("text").to_pylist())
    both = np.concatenate((tokens, bigram_keys(tokens, ends)))
    keys, where = np.unique(both, return_inverse=True)
    lengths = np.diff(ends, prepend=0)
    learnt = np.repeat(~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool), lengths)
    counts = np.bincount(where, np.concatenate((learnt, learnt)), len(keys)).astype(np.int64)
    return tokens, ends, keys, where, counts


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as one byte each; 255 stands for those from 255 on, which follow in full."""
    large = counts[counts >= 255].astype("<u8")
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", offset=n)
    return counts


def _of_bucket(keys: np.ndarray, buckets: int):
    """(bucket, places of its keys), in order of buckets."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for places in np.split(order, cuts) if len(order) else []:
        yield int(bucket[places[0]]), places


def run_automaton(tokens, ends, before_state, words, arcs, weights, fail, root):
    """Log10 probability of each text.

    words: local number of each token, with state words + 1 for those learnt, else 0;
    arcs: sorted state * len(root) + word of bigrams seen, weights beside them;
    fail: weight of each state's failure arc; root: weight of the root's arc per word.
    All texts step together, the longest first, so a step is a few array operations.
    """
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    state = np.full(len(starts), before_state, np.int64)
    score = np.zeros(len(starts))
    width = len(root)
    live = len(starts)
    for t in range(int(lengths[0]) if live else 0):
        while lengths[live - 1] <= t:
            live -= 1
        word = words[starts[:live] + t]
        at = state[:live]
        place = np.searchsorted(arcs, at * width + word)
        found = place < len(arcs)
        place[~found] = 0
        if len(arcs):
            found &= arcs[place] == at * width + word
        score[:live] += np.where(found, weights[place] if len(arcs) else 0.0, fail[at] + root[word])
        state[:live] = word + 1
    out = np.empty(len(starts))
    out[order] = score
    return out


def lm_scores(docs: DataFrame, id_col="doc_id", text_col="text", held_out=None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    held_out: boolean Column of the rows not learnt from (crc32 of the id mod 5 is 1).
    """
    spark = docs.sparkSession
    held = crc32_mod(id_col, 5) == 1 if held_out is None else held_out
    source = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), held.alias("held_out")
    )
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = shuffle_width(spark, n_bytes, CHUNK_BYTES)
    buckets = shuffle_width(spark, n_bytes, BUCKET_BYTES)

    def count_words(batches):
        for batch in batches:
            tokens, _ = tokens_of(batch.column("text").to_pylist())
            words, n = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    learnt = source.where(~F.col("held_out"))
    words = learnt.select("text").mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, n_types, n_docs = total[0], total[1], learnt.count()
    z = n_all + 0.5 * (n_types + 1)

    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        _, _, keys, _, counts = _grams(table)
        rows = [(b, keys[p].tobytes(), pack_counts(counts[p])) for b, p in _of_bucket(keys, buckets)]
        b, k, c = zip(*rows, strict=True)
        return pa.table({"chunk": pa.array([chunk] * len(b), pa.int64()), "bucket": pa.array(b, pa.int64()), "keys": pa.array(k, pa.binary()), "counts": pa.array(c, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([unpack_counts(c, len(k)) for c, k in zip(table.column("counts").to_pylist(), keys, strict=True)])
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(where, counts)[where].astype(np.int64)
        packed = [pack_counts(x) for x in np.split(totals, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "totals": pa.array(packed, pa.binary())})

    id_type = source.schema["id"].dataType.simpleString()
    out_type = f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, ends, keys, where, _ = _grams(table)
        totals = np.zeros(len(keys), np.int64)
        got = dict(zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist(), strict=True))
        for b, places in _of_bucket(keys, buckets):
            totals[places] = unpack_counts(got[b], len(places))
        n = len(tokens)
        word_keys, words = np.unique(where[:n], return_inverse=True)
        c_word, c_pair = totals[word_keys], totals[where[n:]]
        p_word = (c_word + 0.5) / z
        # State 0 is the start of a text, state w + 1 the word w; a word never learnt fails to the root at no cost.
        c_state = np.concatenate(([n_docs], c_word)).astype(np.float64)
        fail = np.where(c_state > 0, np.log10(MU / (c_state + MU)), 0.0)
        before = np.zeros(n, np.int64)
        before[1:] = words[:-1] + 1
        before[np.concatenate(([0], ends[:-1]))] = 0
        seen = c_pair > 0
        arcs, first = np.unique((before * len(word_keys) + words)[seen], return_index=True)
        state, word = before[seen][first], words[seen][first]
        weights = np.log10((c_pair[seen][first] + MU * p_word[word]) / (c_state[state] + MU))
        root = np.log10(p_word)
        scores = run_automaton(tokens, ends, 0, words, arcs, weights, fail, root)
        starts = np.concatenate(([0], ends[:-1]))
        return pa.table(
            {
                "id": table.column("id"),
                "held_out": table.column("held_out"),
                "n_tokens": pa.array(ends - starts),
                "n_known": pa.array(np.add.reduceat((c_word > 0)[words].astype(np.int64), starts)),
                "base_score": pa.array(np.add.reduceat(root[words], starts)),
                "score": pa.array(scores),
            }
        )

    # Copies of one row read in different places go to different chunks.
    place = F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(chunks)).cast("long")
    chunked = source.withColumn("chunk", place).repartition(min(chunks, MOST_TASKS), "chunk")
    asked = chunked.groupBy("chunk").applyInArrow(ask, "chunk long, bucket long, keys binary, counts binary")
    answered = asked.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, totals binary")
    scored = chunked.groupBy("chunk").cogroup(answered.repartition(min(chunks, MOST_TASKS), "chunk").groupBy("chunk")).applyInArrow(score, out_type)
    return scored.withColumnRenamed("id", id_col).withColumn("train_tokens", F.lit(n_all).cast("long"))
