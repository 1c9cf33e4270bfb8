"""Archive interiors as rows: ZIP and tar.gz files read from a table of contents."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries, bytes and ratio of one archive that are read at most.
MAX_ENTRIES, ALLOWANCE, MAX_RATIO = 10_000, 64 << 20, 1_000
PREFIX = 4096
SCHEMA = "member string, kind string, entry string, i int, size bigint, compressed bigint, state string, reason string, prefix binary"


def is_tar_header(block: bytes) -> bool:
    """Whether 512 bytes are a tar header: the checksum, signed or unsigned, is right."""
    if len(block) < 512:
        return False
    try:
        told = int(block[148:156].split(b"\0")[0].strip() or b"x", 8)
    except ValueError:
        return False
    counted = block[:148] + b" " * 8 + block[156:512]
    return told in (sum(counted), sum(b - 256 if b > 127 else b for b in counted))


def archive_kind(content: bytes) -> str | None:
    """zip, or tar.gz if gzip holds a tar, else None."""
    if content[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if content[:2] == b"\x1f\x8b":
        try:
            return "tar.gz" if is_tar_header(zlib.decompressobj(31).decompress(content, 512)) else None
        except zlib.error:
            return None
    return None


def _zip_rows(member: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        left = ALLOWANCE
        for i, info in enumerate(archive.infolist()):
            row = [member, "zip", info.filename, i, info.file_size, info.compress_size]
            if info.is_dir():
                continue
            if i >= MAX_ENTRIES:
                yield [*row, "unread", "archive_over_cap", None]
            elif info.flag_bits & 1:
                yield [*row, "unread", "encrypted", None]
            elif info.file_size > MAX_RATIO * max(1, info.compress_size):
                yield [*row, "unread", "ratio", None]
            elif info.file_size > left:
                yield [*row, "unread", "budget_exhausted", None]
                left = -1  # later entries are not tried either
            else:
                left -= info.file_size
                try:
                    yield [*row, "read", None, archive.read(info)[:PREFIX]]
                except (zipfile.BadZipFile, NotImplementedError, zlib.error):
                    yield [*row, "unread", "corrupt", None]


def _tar_rows(member: str, content: bytes):
    left = ALLOWANCE
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
        for i, info in enumerate(archive):
            row = [member, "tar.gz", info.name, i, info.size, 0]
            if not info.isfile():
                continue
            if i >= MAX_ENTRIES:
                yield [*row, "unread", "archive_over_cap", None]
                return
            if info.size > left:
                yield [*row, "unread", "budget_exhausted", None]
                return
            left -= info.size
            content = archive.extractfile(info).read()  # whole, at most ALLOWANCE: what is cut short is not read
            if len(content) < info.size:
                raise EOFError(info.name)
            yield [*row, "read", None, content[:PREFIX]]


def entries_of(member: str, content: bytes) -> list[list]:
    """Rows of one archive, and one with a reason if it cannot be opened or read to its end; entries before that stay."""
    kind = archive_kind(content)
    if not kind:
        return [[member, None, None, -1, 0, 0, "unread", "no_archive", None]]
    rows = []
    try:
        for row in (_zip_rows if kind == "zip" else _tar_rows)(member, content):
            rows.append(row)
    except (zipfile.BadZipFile, tarfile.TarError, gzip.BadGzipFile, EOFError, zlib.error):
        return [*rows, [member, kind, None, -1, 0, 0, "unread", "corrupt", None]]
    return rows or [[member, kind, None, -1, 0, 0, "read", None, None]]


def expand_archives(files: DataFrame) -> DataFrame:
    """One row per entry of files (member, content): sizes, state, reason, and the first bytes. Nested archives stay closed."""
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [r for member, content in zip(batch["member"], batch["content"], strict=True) for r in entries_of(member, bytes(content))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("member", "content").mapInPandas(run, SCHEMA)


def archive_rollup(entries: DataFrame) -> DataFrame:
    """(member, kind, opened, partial, entries, bytes, reasons) of expanded archives."""
    read = F.col("state") == "read"
    return entries.groupBy("member").agg(
        F.max("kind").alias("kind"), F.bool_or(read).alias("opened"), F.bool_or(~read).alias("partial"), F.count_if(F.col("i") >= 0).alias("entries"),
        F.sum(F.when(read, F.col("size")).otherwise(0)).alias("bytes"), F.array_sort(F.collect_set("reason")).alias("reasons"),
    )
