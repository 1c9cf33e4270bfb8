"""Files as tables: listing, digests, continuous listing, sinks."""

from __future__ import annotations

import hashlib
import os
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.operators.inventory import block_digests
from tallyvane.session import shared_path

BINARY = "path string, modificationTime timestamp, length bigint, content binary"
MAX_FILES = 100_000
LISTED = "source string, relative_path string, path string, kind string, size bigint, mtime timestamp"
#: Stores that workers open by themselves, and the folders that a task looks into.
OPENED, FOLDERS = ("file", "hdfs", "s3", "gs", "abfs"), 64
BLOCK = 8 << 20
#: A larger file is no row of Spark's: it is read by byte ranges, PIECE bytes at a time.
WHOLE, PIECE = 1 << 30, 8 << 20
#: Bytes that a task reads in blocks.
SHARE = 512 << 20


def list_files(spark: SparkSession, sources: dict[str, str], cap: int | None = MAX_FILES) -> DataFrame:
    """(source, relative_path, size, mtime, path) of all regular files below each root; contents are not read, links not followed.

    Folders are a table that grows a level a round: tasks look into the folders of a round,
    what they find is written, and its folders are the next round's. So a tree is as deep as
    the rounds, and no more of it is in one place than a folder. A root may be a link itself.
    sources: root folder by name. cap: a listing of more files is refused whole; None takes any.
    Stores that workers cannot open are listed by Spark (which leaves out empty files).
    """
    roots = []
    for name, root in sources.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        roots.append((name, "", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()))
    unknown = [r for r in roots if r[2].split(":", 1)[0] not in OPENED]
    level = spark.createDataFrame([r for r in roots if r not in unknown], "source string, relative_path string, path string")
    levels = [_spark_listing(spark, *r) for r in unknown]
    total = 0
    while not level.isEmpty():
        path = shared_path(spark, "listing")
        wide = level.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-level.count() // FOLDERS)), "path")
        wide.mapInArrow(_look_into, LISTED).write.parquet(path)
        found = spark.read.schema(LISTED).parquet(path)
        files = found.where("kind = 'file'").select("source", "relative_path", "size", "mtime", "path")
        levels.append(files)
        total += files.count() if cap is not None else 0
        if cap is not None and total > cap:
            break
        level = found.where("kind = 'folder'").select("source", "relative_path", "path")
    out = reduce(DataFrame.unionByName, levels) if levels else spark.createDataFrame([], LISTED).drop("kind")
    if cap is None or (total <= cap and not unknown):
        return out
    n = out.agg(F.count("*")).scalar()
    return out.where(F.when(n <= cap, True).otherwise(F.raise_error(F.lit(f"more than {cap} files")).cast("boolean")))


def _look_into(batches):
    """What stands in folders (source, relative_path, path)."""
    for batch in batches:
        for row in batch.to_pylist():
            found = []
            for name, kind, size, mtime in entries(row["path"]):
                rel = f"{row['relative_path']}/{name}" if row["relative_path"] else name
                found.append({"source": row["source"], "relative_path": rel, "path": f"{row['path'].rstrip('/')}/{name}", "kind": kind, "size": size, "mtime": mtime})
            for i in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_pylist(found[i : i + 10_000], pa.schema([("source", pa.string()), ("relative_path", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))]))


def entries(folder: str):
    """(name, kind, size, time in microseconds) of a folder's entries; kind is file, folder, link or other."""
    if folder.startswith("file:"):
        with os.scandir("/" + folder[len("file:") :].lstrip("/")) as found:
            for e in found:
                kind = "link" if e.is_symlink() else "folder" if e.is_dir() else "file" if e.is_file() else "other"
                told = e.stat(follow_symlinks=False)
                yield e.name, kind, told.st_size if kind == "file" else None, told.st_mtime_ns // 1000
    else:
        from pyarrow import fs

        store, inner = _store(folder)
        for e in store.get_file_info(fs.FileSelector(inner)):
            kind = "folder" if e.type == fs.FileType.Directory else "file" if e.type == fs.FileType.File else "other"
            yield e.base_name, kind, e.size if kind == "file" else None, e.mtime_ns // 1000 if e.mtime_ns else None


def _spark_listing(spark: SparkSession, name: str, _: str, root: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    return found.select(F.lit(name).alias("source"), rel.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "path")


def _store(path: str):
    from pyarrow import fs

    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")


def opened(path: str):
    """A file of the shared store for reading at any place, by its path as Spark lists it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[len("file:") :].lstrip("/"))
    store, inner = _store(path)
    return store.open_input_file(inner)


def _width(spark: SparkSession, wanted) -> int:
    """Tasks: the session's shuffle partitions, or more if wanted."""
    rows = spark.range(1).select(F.coalesce(wanted, F.lit(0))).first()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows[0]))


def file_digests(spark: SparkSession, path: str, most: int = WHOLE) -> DataFrame:
    """(path, size, sha256) of whole files. One over `most` bytes is read by its task piece after piece; the others are rows.

    Spark's file source leaves out empty files (list_files does not): theirs is the digest of nothing.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = found.where(F.col("length") <= most).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = found.where(F.col("length") > most).select("path", F.col("length").alias("size"))

    def digest(batches):
        for batch in batches:
            for name, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                held, left = hashlib.sha256(), size
                with opened(name) as file:
                    while left:
                        piece = file.read(min(PIECE, left))
                        if not piece:
                            raise EOFError(f"{name} became shorter while it was read")
                        held.update(piece)
                        left -= len(piece)
                yield pa.RecordBatch.from_pylist([{"path": name, "size": size, "sha256": held.hexdigest()}])

    return small.unionByName(large.repartition(_width(spark, large.agg(F.count("*")).scalar()), "path").mapInArrow(digest, "path string, size bigint, sha256 string"))


def file_block_digests(spark: SparkSession, path: str, block: int = BLOCK, most: int = WHOLE) -> DataFrame:
    """(path, block, digest) of every block of files. Blocks of a file over `most` bytes are rows of their own, read by many tasks."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = block_digests(found.where(F.col("length") <= most), F.col("content"), block, "path")
    last = F.ceil(F.col("length") / block).cast("int") - 1
    large = found.where(F.col("length") > most).select("path", "length", F.explode(F.sequence(F.lit(0), last)).alias("block"))

    def digest(batches):
        for batch in batches:
            for row in batch.to_pylist():
                start = row["block"] * block
                held, left = hashlib.sha256(), min(block, row["length"] - start)
                with opened(row["path"]) as file:
                    file.seek(start)
                    while left:
                        piece = file.read(min(PIECE, left))
                        if not piece:
                            raise EOFError(f"{row['path']} became shorter while it was read")
                        held.update(piece)
                        left -= len(piece)
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([row["block"]], pa.int32()), pa.array([held.hexdigest()])], ["path", "block", "digest"])

    # Neighbouring blocks of a file are dealt to different tasks, as many as the bytes ask for.
    width = found.where(F.col("length") > most).agg(F.ceil(F.sum("length") / SHARE)).scalar()
    spread = large.repartition(_width(spark, width), "path", "block")
    return small.unionByName(spread.mapInArrow(digest, "path string, block int, digest string"))


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of files as they appear: path, modificationTime, length, sha256."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_generation(df: DataFrame, path: str, generation: int) -> None:
    """Appends an inventory batch as one generation; a repeated one replaces itself."""
    df.withColumn("generation", F.lit(generation)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls kept."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)
