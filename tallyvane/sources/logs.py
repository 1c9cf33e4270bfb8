"""Manifests and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "provider string, key string, etag string, size bigint, format string, version_id string"


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Members of bucket snapshots (JSON lines), with the format told by the key where none is given."""
    from tallyvane.functions.content import format_of

    return spark.read.schema(MANIFEST).json(path).withColumn("format", F.coalesce("format", format_of(F.col("key"))))


def _parsed(lines: DataFrame) -> DataFrame:
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return lines.select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("part"), get("seq").cast("bigint").alias("seq"), get("time").alias("time"),
        get("message_type").alias("message_type"), get("body").alias("body"), get("prev_hash").alias("prev_hash"),
    )


def scan_audit(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a log of JSON lines with their file as `part`; order by seq where needed."""
    return _parsed(spark.read.text(path))


def stream_audit(spark: SparkSession, path: str) -> DataFrame:
    """scan_audit as a stream of new files."""
    return _parsed(spark.readStream.text(path))


def torn_tails(spark: SparkSession, path: str, drop: str = "") -> DataFrame:
    """(part, torn, bad_lines): whether a file's last line has no end, and how many others are no JSON objects.

    drop: characters that a writer put between lines and that are none of theirs.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("part"), F.translate("value", drop, "").alias("value"))
    lines = F.split("value", "\n")
    whole = F.slice(lines, 1, F.greatest(F.lit(0), F.size(lines) - 1))
    return files.select("part", (F.element_at(lines, -1) != "").alias("torn"), F.size(F.filter(whole, lambda x: F.try_parse_json(x).isNull())).alias("bad_lines"))
