"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits share at least six of their eight
positional bytes. A list per single byte would hold 1/256 of all fingerprints, so the index
has a list per five positional bytes: OPEN names the three positions that each kind of list
leaves out. Its 20 kinds leave every two positions out together at least twice, which makes
the count exact: fingerprints that share six bytes or more meet in at least two lists, those
that share five meet in one list at most, others in none. Pairs are tallied over the lists
they meet in, those under MIN_LISTS are dropped, and the rest are verified bit by bit.

Near copies in thousands make long lists, whose pairs are not all to be emitted. A pair that
shares such a list gets its link there, another way: members are posted again under six of
eight bytes, which leaves two bytes open, and fingerprints at two bits or fewer meet at a
common fingerprint that differs from each in at most one of those open bits. These meeting
points have at most 17 members, so rows stay linear in the fingerprints. A pair that shares
no long list has its whole tally in the short ones; so no link is lost at any length.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other.
Repeated rows stay repeated. A null id never is a component's id unless all its ids are
null. Empty input gives empty output. Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, discard, slices, written
from .components import components

SHINGLE = 3
MAX_BITS = 2
BYTES = 8
MIN_SHARED = BYTES - MAX_BITS
#: Positional bytes that each kind of list leaves open: {i, i+1, i+3} and {i, i+1, i+4} modulo 8, and {i, i+2, i+4} for four i.
OPEN = [sorted({i, (i + a) % BYTES, (i + b) % BYTES}) for a, b, starts in ((1, 3, range(8)), (1, 4, range(8)), (2, 4, (0, 1, 4, 5))) for i in starts]
#: Lists that fingerprints sharing MIN_SHARED bytes are sure to meet in.
MIN_LISTS = 2
#: The pairs of a list of more members are found at meeting points.
LONG_LIST = 32
SEED = 42


def fingerprint(text: bytes) -> int:
    """SimHash of the 3-word shingles, as a signed 64-bit integer."""
    words = text.translate(TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _key(fp, number: int, mask: int):
    """Posting key: which bytes are taken, and what they hold."""
    mask -= (mask >> 63) << 64
    return F.struct(F.lit(number).cast("byte").alias("at"), fp.bitwiseAND(F.lit(mask)).alias("held"))


def _mask(open_bytes) -> int:
    """Bits of the bytes that are not open."""
    return sum(255 << 8 * b for b in range(BYTES) if b not in open_bytes)


INDEX_MASKS = [_mask(o) for o in OPEN]
SIX_MASKS = [_mask(o) for o in itertools.combinations(range(BYTES), BYTES - MIN_SHARED)]


def links(distinct_fps: DataFrame) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) that connect just those within two bits.

    Every linked pair is joined by a path of such links; pairs of long lists are not all listed.
    """
    fp = F.col("fp")
    posted = F.explode(F.array(*[_key(fp, i, m) for i, m in enumerate(INDEX_MASKS)])).alias("key")
    postings = written(distinct_fps.select("fp", posted), "postings")
    lists = written(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    short = written(postings.join(lists.where(F.col("n") <= LONG_LIST).select("key"), "key").select("key", "fp"), "short")
    pairs = short.select("key", F.col("fp").alias("a")).join(short.select("key", F.col("fp").alias("b")), "key").where("a < b")
    tallied = pairs.groupBy("a", "b").agg(F.count("*").alias("met")).where(F.col("met") >= MIN_LISTS)
    near = tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    crowded = written(postings.join(lists.where(F.col("n") > LONG_LIST).select("key"), "key").select("fp").distinct(), "crowded")
    discard(postings)
    return near.unionByName(crowded_links(crowded))


def crowded_links(crowded: DataFrame) -> DataFrame:
    """Links among fingerprints of long lists, over their lists of six bytes."""
    fp = F.col("fp")
    six = written(crowded.select("fp", F.explode(F.array(*[_key(fp, i, m) for i, m in enumerate(SIX_MASKS)])).alias("key")), "six")
    # A list of six bytes is often one fingerprint alone; the rest meet at one open bit's distance.
    shared = six.join(six.groupBy("key").count().where("count > 1").select("key"), "key")
    opened = F.array(
        *[
            F.array(fp, *[fp.bitwiseXOR(F.lit((1 << b) - ((1 << b >> 63) << 64))) for b in range(64) if not m >> b & 1])
            for m in SIX_MASKS
        ]
    )
    meet = shared.select("fp", F.explode(F.element_at(opened, F.col("key.at").cast("int") + 1)).alias("point")).distinct()
    # At most 65 fingerprints lie within one bit of a point, so these lists are bounded.
    met = meet.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def _components_of(fps: DataFrame) -> DataFrame:
    """(fp, root, first): per distinct fingerprint its component and that one's first row."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")).alias("first")
    distinct_fps = written(fps.groupBy("fp").agg(first), "distinct")
    labels = components(links(distinct_fps))
    linked = written(labels.join(distinct_fps, F.col("node") == F.col("fp")).select("fp", F.col("label").alias("root"), "first"), "linked")
    firsts = written(linked.groupBy("root").agg(F.min("first").alias("group_first")), "firsts")
    grouped = linked.join(firsts, "root").select("fp", "root", "group_first")
    return written(
        distinct_fps.join(grouped, "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("group_first", "first").alias("first")
        ),
        "components",
    )


def _with_digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("digest"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )

    def run(batches):
        for batch in slices(batches):
            fps = [fingerprint(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(fps, pa.int64())], ["id", "digest", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, digest long, fp long")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (its smallest id)."""
    fps = written(_with_digest(docs, id_col, text_col), "fingerprints")
    found = _components_of(fps)
    return fps.join(found, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"),
    )


def one_per_group(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """docs with one row of every component: smallest id, then smallest text digest."""
    fps = written(_with_digest(docs, id_col, text_col), "fingerprints")
    kept = written(_components_of(fps).select("first.id", "first.digest").distinct(), "kept")
    discard(fps)
    # Columns are told apart by their frame, whatever their names.
    same = docs[id_col].eqNullSafe(kept["id"]) & (F.xxhash64(docs[text_col]) == kept["digest"])
    return docs.join(kept, same, "left_semi").dropDuplicates([id_col, text_col])
