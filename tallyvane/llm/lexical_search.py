"""Ranked lexical search: summed accumulators of short lists inside a document-at-a-time pass over long ones.

`index` stores documents in blocks: a block is one row with its documents in order of id
and one postings list (document, occurrences) per term. `ranked` takes stated queries, in
sets of bounded size, against all blocks. In a block, a query's lists are of two kinds:

- Short lists are read term at a time: their scores are summed into accumulators, which
  are then one iterator of documents in order, bounded by its largest sum.
- This iterator and the long lists, each bounded by its largest score, are passed document
  at a time, in strides. Iterators whose bounds together stay below the worst score of the
  best documents so far propose no candidates; they are only looked up, largest bound
  first, for candidates that the rest of the bounds can still lift to that score.

The best documents of a query are carried from block to block within a task, so later
blocks skip more. A task returns no more than the wanted number of rows per query, and two
levels of ranking (query and part of the ids, then query) keep a query's rows in one task few.

A term of a query weighs floor(1000 ln((2N + 2) / (2 df + 1))), N documents with terms, df
of them with this one. With tf occurrences among a document's n terms, L in all documents,
it scores weight * ((10^9 tf) div (1000 tf + 20 m)), m = 50 + (50 n N) div L.

Defined cases: a null or termless text is no document of the ranking, a null or termless
query ranks nothing. Rows with the same query id are one query of all their terms; a null
id is an id like any other, and null document ids come last among equals. Repeated
documents are ranked each. Equal scores are ranked by ascending document id. Texts are read
whole. A document's, and a query's, distinct terms are held at once. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TO_LOWER, ascii_lower, slices, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A-Z lower-cased; ASCII that is neither letter nor digit parts terms.
TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in TO_LOWER)
#: A block ends after so many postings, or so many documents (their numbers take two bytes).
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 20, 1 << 16
#: Lists of at most this share of a block's documents are short.
SHORT = 1 / 32
#: Documents that a stride looks at.
STRIDE = 2048
#: Distinct terms, and queries, of a set of queries that is searched at once.
SET_TERMS, SET_QUERIES = 200_000, 4_000
#: Parts that a query's candidates are ranked in first.
PARTS = 64


def index(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Blocks of documents with terms: ids in order, their lengths, terms, the sizes of their lists, the lists one after another."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        terms: dict[bytes, int] = {}
        ids, lengths, of_doc, times = [], [], [], []

        def flush():
            held = pa.concat_arrays(ids)
            order = pc.sort_indices(held, null_placement="at_end")
            rank = np.empty(len(held), np.int64)
            rank[order.to_numpy()] = np.arange(len(held))
            term, tf = np.concatenate(of_doc), np.concatenate(times)
            doc = np.repeat(rank, [len(t) for t in of_doc])
            by_term = np.lexsort((doc, term))
            columns = [
                held.take(order).to_pylist(), np.array(lengths, "<i8")[order.to_numpy()].tobytes(), list(terms), np.bincount(term, minlength=len(terms)),
                doc[by_term].astype("<u2").tobytes(), tf[by_term].astype("<u4").tobytes(), len(held), sum(lengths),
            ]
            types = [pa.list_(held.type), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            for part in (terms, ids, lengths, of_doc, times):
                part.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types, strict=True)], ["ids", "lengths", "terms", "sizes", "docs", "times", "n_docs", "n_terms"])

        postings = 0
        for batch in slices(batches, 64):
            found = [t.translate(TERM_BYTES).split() for t in batch.column("text").to_pylist()]
            ids.append(batch.column("id").filter(pa.array([bool(w) for w in found], pa.bool_())))
            for words in filter(None, found):
                tally = Counter(words)
                lengths.append(len(words))
                of_doc.append(np.fromiter((terms.setdefault(w, len(terms)) for w in tally), np.int32, len(tally)))
                times.append(np.fromiter(tally.values(), np.int64, len(tally)))
                postings += len(tally)
            if postings >= BLOCK_POSTINGS or len(lengths) > BLOCK_DOCS - 64:
                yield flush()
                postings = 0
        if lengths:
            yield flush()

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"ids array<{id_type}>, lengths binary, terms array<binary>, sizes array<int>, docs binary, times binary, n_docs long, n_terms long")


class Lists:
    """The scores before weighting of one block's postings, by term."""

    def __init__(self, terms: list[bytes], sizes: np.ndarray, docs: np.ndarray, times: np.ndarray, lengths: np.ndarray, total: tuple[int, int]):
        n, length = total
        distinct, where = np.unique(lengths, return_inverse=True)
        m = np.array([50 + 50 * int(x) * n // length for x in distinct], np.int64)[where]  # exact for any sizes
        self.docs, self.n = docs.astype(np.int64), len(lengths)
        self.share = 10**9 * times // (1000 * times + 20 * m[self.docs])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.most = np.maximum.reduceat(self.share, self.starts) if len(sizes) else np.empty(0, np.int64)
        self.number = dict(zip(terms, range(len(terms)), strict=True))

    def of(self, weights: list[tuple[bytes, int]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(documents, scores, bound) per term that the block has, shortest first."""
        held = sorted(((int(self.ends[i] - self.starts[i]), i, w) for t, w in weights if w and (i := self.number.get(t)) is not None))
        return [(self.docs[s : s + size], self.share[s : s + size] * w, int(self.most[i]) * w) for size, i, w in held for s in [self.starts[i]]]


def accumulated(short: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Short lists as one: documents in order, summed scores, and the largest sum as bound."""
    docs, where = np.unique(np.concatenate([d for d, _, _ in short]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, where, np.concatenate([s for _, s, _ in short]))
    return docs, sums, int(sums.max())


def best_of(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, top: int, least: int = 1, short: float = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of at least the `top` best of a block that score `least` or more; equal scores are all kept."""
    few = [x for x in lists if len(x[0]) <= short * n_docs]
    iterators = [x for x in lists if len(x[0]) > short * n_docs]
    if few:
        iterators.append(acc := accumulated(few))
        if len(acc[1]) >= top:
            least = max(least, int(np.partition(acc[1], -top)[-top]))  # sums only grow
    iterators.sort(key=lambda x: x[2])
    upto = np.cumsum([bound for _, _, bound in iterators])
    docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    for first in range(0, n_docs, STRIDE):
        passive = int(np.searchsorted(upto, least))  # bounds of these together stay below `least`
        if passive == len(iterators):
            break
        sums = np.zeros(min(STRIDE, n_docs - first), np.int64)
        for held, values, _ in iterators[passive:]:
            a, b = np.searchsorted(held, (first, first + STRIDE))
            sums[held[a:b] - first] += values[a:b]
        found = np.flatnonzero(sums)
        for i in range(passive - 1, -1, -1):
            found = found[sums[found] + upto[i] >= least]
            held, values, _ = iterators[i]
            at = np.minimum(np.searchsorted(held, found + first), len(held) - 1)
            met = held[at] == found + first
            sums[found[met]] += values[at[met]]
        found = found[sums[found] >= least]
        docs, scores = np.concatenate((docs, found + first)), np.concatenate((scores, sums[found]))
        if len(scores) > top:
            least = max(least, int(np.partition(scores, -top)[-top]))
            docs, scores = docs[scores >= least], scores[scores >= least]
    return docs, scores


def _searched(blocks: DataFrame, queries: list[list[tuple[bytes, int]]], total: tuple[int, int], top: int) -> DataFrame:
    """(query, id, score): the best documents that each task finds for each query."""
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        best: list[list] = [[] for _ in queries]
        of_id = None
        for batch in slices(batches, 1):
            ids, of_id = batch.column("ids").flatten(), batch.schema.field("ids").type.value_type
            lengths, docs, times = (np.frombuffer(batch.column(c)[0].as_py(), t).astype(np.int64) for c, t in (("lengths", "<i8"), ("docs", "<u2"), ("times", "<u4")))
            lists = Lists(batch.column("terms").flatten().to_pylist(), np.array(batch.column("sizes").flatten(), np.int64), docs, times, lengths, total)
            for number, weights in enumerate(queries):
                held = best[number]
                found, scores = best_of(lists.of(weights), lists.n, top, -held[-1][0] if len(held) == top else 1)
                if len(found):
                    first = np.lexsort((found, -scores))[:top]
                    named = zip(scores[first].tolist(), ids.take(pa.array(found[first])).to_pylist(), strict=True)
                    held += [(-s, i is None, i) for s, i in named]
                    held.sort(key=lambda r: r if not r[1] else r[:2])
                    del held[top:]
        rows = [(number, i, -s) for number, held in enumerate(best) for s, _, i in held]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), of_id, pa.int64()), strict=True)], ["query", "id", "score"])

    return blocks.mapInArrow(run, f"query int, id {id_type}, score long")


def query_sets(rows: Iterable, terms: int | None = None, queries: int | None = None) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Queries (id, distinct terms) of rows (id, term) in order of id, in sets that end at a bound."""
    held, size = [], 0
    for found, of_query in groupby(rows, key=lambda r: r[0]):
        held.append((found, [bytes(r[1]) for r in of_query]))
        size += len(held[-1][1])
        if size >= (terms or SET_TERMS) or len(held) >= (queries or SET_QUERIES):
            yield held
            held, size = [], 0
    if held:
        yield held


def ranked(blocks: DataFrame, queries: DataFrame, top: int, query_col="item_id", text_col="text", id_col="doc_id") -> DataFrame:
    """(query id, rank, document id, score): the `top` best documents of an index for each query, from rank 1."""
    spark = blocks.sparkSession
    query_type, id_type = queries.schema[query_col].dataType.simpleString(), blocks.schema["ids"].dataType.elementType.simpleString()
    total = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    terms = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(TERM), F.lit(0)).cast("array<binary>")
    wanted = queries.select(F.col(query_col).alias("query"), F.explode(terms).alias("term")).distinct()
    sizes = blocks.select(F.inline(F.arrays_zip("terms", "sizes")))
    results = []
    for held in query_sets(wanted.orderBy("query", "term").toLocalIterator()):
        lexicon = spark.createDataFrame([(t,) for t in {t for _, terms in held for t in terms}], "terms binary")
        of_term = sizes.join(F.broadcast(lexicon), "terms").groupBy("terms").agg(F.sum("sizes")).collect()
        weight = {bytes(t): math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df + 1))) for t, df in of_term}
        weighed = [[(t, weight[t]) for t in terms if t in weight] for _, terms in held]
        names = spark.createDataFrame([(n, q) for n, (q, _) in enumerate(held)], f"query int, name {query_type}")
        found = _searched(blocks, weighed, tuple(total), top)
        for keys in (["query", F.pmod(F.xxhash64("id"), F.lit(PARTS))], ["query"]):
            order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        results.append(found.join(F.broadcast(names), "query").select(F.col("name").alias(query_col), "rank", F.col("id").alias(id_col), "score"))
    if not results:
        return spark.createDataFrame([], f"`{query_col}` {query_type}, rank int, `{id_col}` {id_type}, score long")
    return reduce(DataFrame.unionByName, results)


def lexical_search(docs: DataFrame, queries: DataFrame, top: int = 50, id_col="doc_id", text_col="text", query_col="item_id", query_text_col="text") -> DataFrame:
    """(query id, rank, document id, score) of the `top` best documents for each query."""
    return ranked(written(index(docs, id_col, text_col), "index"), queries, top, query_col, query_text_col, id_col)
