"""Token ids in patched frame-of-reference blocks.

The files are Parquet; a row is a segment: a run of whole documents in ascending id
order, as a payload of blocks plus its indexes. A block of BLOCK ids is packed as

    header   "<IBHI": block minimum, bit width, number of exceptions, number of ids
    packed   the low `width` bits of (id - minimum), least significant bit first
    patches  exception places (uint16), then their high parts (uint32)

The width is that of the PERCENTILE of (id - minimum) in the block; what does not fit
is an exception. block_starts holds the place of every block's first id among the ids
of the shard, block_offsets its byte in the payload, and doc_ids / doc_lengths the
documents, so a reader can reach any document without decoding what comes before.

Tokenisation is per run of non-white-space, which gives the tokenizer's own ids as it
drops white space and joins nothing across it; a bounded cache keeps frequent runs.

Defined cases: a null or empty text is the end id alone. Null ids come first. Rows with
equal ids stay, in order of their text's digest. An empty table gives no documents.
Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.session import shared_path

from .common import shuffle_width, slices

END_ID = 1
BLOCK = 4096
PERCENTILE = 95
SEGMENT_IDS = 1 << 18
TASK_BYTES = 24 << 20
#: Beyond so many tasks they grow instead; segments keep their memory bounded.
MOST_TASKS = 50_000
#: Shards whose places are added up together.
SHARD_GROUP = 1024
#: Words of a generation of a worker's cache; two are kept, some 250 bytes a word.
CACHE_WORDS = 200_000
IDS = b""
#: Below this, letters are composed and lower-case as the tokenizer has them.
PLAIN_BELOW = "\u0180"
#: Byte-level vocabularies spell each byte by a letter: printable ones by themselves, the others from U+0100 on.
_OTHERS = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
BYTE_LETTERS = {b: chr(256 + n) for n, b in enumerate(_OTHERS)}
MARKS = ".,;:!?#$%&*()-|"
HEADER = "<IBHI"


class WordIds(dict):
    """Word to its ids as little-endian uint32 bytes; keeps two generations of CACHE_WORDS."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.older = Tokenizer.from_file(path), {}
        self.merges = self.tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            core = word.rstrip(MARKS)
            if core != word and core.isalpha() and core.lower().isalpha():
                # The tokenizer cuts between letters and marks (but for '), so these have ids of their own.
                # Not so where lower-casing leaves a combining mark, which the marks would join.
                ids = self[core] + self[word[len(core) :]]
            elif word.isalpha() and word.islower() and max(word) < PLAIN_BELOW:
                # One piece, already normal: straight to the merges, by its bytes' letters.
                spelt = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = IDS.join(t.id.to_bytes(4, "little") for t in self.merges(spelt))
            else:
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        # The tokenizer lower-cases by character; below U+0180 str.lower does the same.
        if text.isascii() or max(text) < PLAIN_BELOW:
            text = text.lower()
        words = text.replace("\n", " ").replace("\t", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


_HELD: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's cache for a vocabulary; workers are reused, so it outlives a task."""
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = WordIds(path)
    return _HELD[path]


def pack_block(ids: np.ndarray) -> bytes:
    """One block of up to BLOCK ids (uint32)."""
    base = int(ids.min())
    rest = (ids - np.uint32(base)).astype("<u4")
    width = int(np.partition(rest, k := (len(rest) - 1) * PERCENTILE // 100)[k]).bit_length()
    places = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    packed = np.packbits(bits, bitorder="little").tobytes()
    patches = places.astype("<u2").tobytes() + (rest[places] >> np.uint32(width)).astype("<u4").tobytes() if len(places) else b""
    return struct.pack(HEADER, base, width, len(places), len(ids)) + packed + patches


def unpack_block(data: memoryview) -> tuple[np.ndarray, int]:
    """Ids of the block at the start of data, and its bytes."""
    base, width, patched, n = struct.unpack_from(HEADER, data)
    at, size = struct.calcsize(HEADER), (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    if width:
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    rest = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel().copy()
    at += size
    if patched:
        places = np.frombuffer(data, "<u2", patched, at)
        rest[places] |= np.frombuffer(data, "<u4", patched, at + 2 * patched) << np.uint32(width)
        at += 6 * patched
    return rest + np.uint32(base), at


def pack(ids: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """(payload, first id's place and byte offset of every block)."""
    parts, starts, offsets, size = [], [], [], 0
    for i in range(0, len(ids), BLOCK):
        parts.append(pack_block(ids[i : i + BLOCK]))
        starts.append(i)
        offsets.append(size)
        size += len(parts[-1])
    return b"".join(parts), starts, offsets


def unpack(payload: bytes) -> np.ndarray:
    data, out = memoryview(payload), []
    while len(data):
        ids, used = unpack_block(data)
        out.append(ids)
        data = data[used:]
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def unpack_between(payload: bytes, starts: list[int], offsets: list[int], a: int, b: int) -> np.ndarray:
    """Ids a to b (exclusive) of a payload, from the blocks that hold them; starts and offsets are the block index."""
    first = np.searchsorted(starts, a, "right") - 1
    last = np.searchsorted(starts, b, "left")
    data, out = memoryview(payload), [np.empty(0, np.uint32)]
    for block in range(first, last):
        out.append(unpack_block(data[offsets[block] :])[0])
    return np.concatenate(out)[a - starts[first] : b - starts[first]]


def write_tokens(docs: DataFrame, vocabulary: str, path: str | None = None, id_col="doc_id", text_col="text") -> str:
    """Writes the files of docs below path (a new folder of the shared one if None); returns the path."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = source.withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(shuffle_width(spark, n_bytes, TASK_BYTES, MOST_TASKS), "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    id_type = ordered.schema["id"].dataType
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encode, shard, at = word_ids(vocabulary).encode, TaskContext.get().partitionId(), 0

        def segment(doc_ids, parts):
            nonlocal at
            ids = np.frombuffer(b"".join(parts), "<u4")
            payload, starts, offsets = pack(ids)
            row = [[shard], [at], [len(ids)], [doc_ids], [[len(p) // 4 for p in parts]], [[at + s for s in starts]], [offsets], [payload]]
            at += len(ids)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)

        doc_ids, parts, size = [], [], 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                doc_ids.append(doc_id)
                parts.append(encode(text) + end)
                size += len(parts[-1])
                if size >= 4 * SEGMENT_IDS:
                    yield segment(doc_ids, parts)
                    doc_ids, parts, size = [], [], 0
        if doc_ids:
            yield segment(doc_ids, parts)

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["shard", "start", "n_ids", "doc_ids", "doc_lengths", "block_starts", "block_offsets", "payload"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(to_arrow_type(id_type)), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    schema = f"shard int, start long, n_ids long, doc_ids array<{id_type.simpleString()}>, doc_lengths array<bigint>, block_starts array<bigint>, block_offsets array<int>, payload binary"
    ordered.mapInArrow(run, schema).write.parquet(path)
    return path


def shard_starts(files: DataFrame) -> DataFrame:
    """(shard, shard_start): ids in all shards before. Sums run within groups of shards, then over the groups' totals."""
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("group", F.floor(F.col("shard") / SHARD_GROUP))
    before = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = shards.groupBy("group").agg(F.sum("n").alias("n")).select("group", before(Window.orderBy("group")).alias("group_start"))
    inside = shards.withColumn("start", before(Window.partitionBy("group").orderBy("shard")))
    return inside.join(groups, "group").select("shard", (F.col("start") + F.col("group_start")).alias("shard_start"))


def read_documents(spark, path: str, ids: list, id_col="doc_id") -> DataFrame:
    """(id, ids): token ids of the documents asked for (a short list), from their blocks alone.

    Segments without any of them are not read beyond their list of documents; of the others
    only the blocks that the index names are decoded. Ids that are not there give no rows.
    """
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType
    wanted = F.array(*[F.lit(i).cast(id_type) for i in ids]) if ids else F.array().cast(files.schema["doc_ids"].dataType)
    asked = set(ids)

    def run(batches):
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                ends = np.cumsum(row["doc_lengths"])
                starts = [s - row["start"] for s in row["block_starts"]]
                for doc_id, n, end in zip(row["doc_ids"], row["doc_lengths"], ends.tolist(), strict=True):
                    if doc_id in asked:
                        found = unpack_between(row["payload"], starts, row["block_offsets"], end - n, end)
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], batch.schema.field("doc_ids").type.value_type), pa.array([found.tolist()], pa.list_(pa.int64()))], ["id", "ids"])

    segments = files.where(F.arrays_overlap("doc_ids", wanted)).select("start", "doc_ids", "doc_lengths", "block_starts", "block_offsets", "payload")
    return segments.mapInArrow(run, f"id {id_type.simpleString()}, ids array<bigint>").withColumnRenamed("id", id_col)


def read_tokens(spark, path: str, id_col="doc_id", with_ids=False) -> DataFrame:
    """Per document of the files at path: id, start, n_tokens, ids_crc32 (and its ids).

    start counts the ids of all documents before it, over all shards.
    """
    files = spark.read.parquet(path)
    first = shard_starts(files)
    id_type = files.schema["doc_ids"].dataType.elementType
    schema = f"id {id_type.simpleString()}, shard int, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids

    def run(batches):
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                raw = unpack(row["payload"]).astype("<u4")
                ends = np.cumsum(row["doc_lengths"])
                starts = ends - row["doc_lengths"]
                spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
                columns = [
                    pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                    pa.array([row["shard"]] * len(spans), pa.int32()),
                    pa.array(starts + row["start"], pa.int64()),
                    pa.array(row["doc_lengths"], pa.int64()),
                    pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in spans], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([raw[a:b].tolist() for a, b in spans], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["id", "shard", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    found = files.select("doc_ids", "shard", "start", "doc_lengths", "payload").mapInArrow(run, schema)
    ids = ["ids"] * with_ids
    return found.join(first, "shard").select(
        F.col("id").alias(id_col), (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", *ids
    )
