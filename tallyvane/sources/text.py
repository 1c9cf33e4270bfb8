"""Delimited, JSON-lines and document scans, and inference over their first records."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvane.operators.scans import hot_keys, scan

from .files import OPENED, opened

BOM = "﻿"
#: A file of more lines is numbered in segments of about so many.
LINES = 1 << 17
#: Fixed value: the bytes that a record may have.
RECORD = 16 << 20


def records(spark: SparkSession, path: str, lines: int | None = None) -> DataFrame:
    """(file, number, record) of delimited files, cut where a line end stands outside quotes; number is that of the first line.

    Files are read as physical lines in byte ranges. A line begins a record if the quotes
    before it in its file are even in number, which a running sum over the ranges tells
    (quotes within quotes are doubled, so parity holds). A carriage return before a line end
    belongs to it, within quotes too. Only lines of one record meet, and
    a record of more than RECORD bytes is refused before they do.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    numbered = text.select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("at"), "value"
    )
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    size = (F.octet_length("value") + 1).cast("bigint")
    hot = hot_keys(numbered, ["file"], lines or LINES)
    upto = scan(numbered.select("*", quotes.alias("quotes"), size.alias("size")), ["file"], ["at"], hot, lines or LINES, n=("sum", F.lit(1).cast("bigint")), open=("sum", F.col("quotes")), end=("sum", F.col("size")))
    begins = (F.col("open") - F.col("quotes")) % 2 == 0
    found = scan(upto, ["file"], ["at"], hot, lines or LINES, number=("max", F.when(begins, F.col("n"))), begin=("max", F.when(begins, F.col("end") - F.col("size"))))
    line = F.when(F.endswith("value", F.lit("\r")), F.substring("value", F.lit(1), F.char_length("value") - 1)).otherwise(F.col("value"))
    whole = F.when(F.col("end") - F.col("begin") <= RECORD, line).otherwise(F.raise_error(F.lit(f"a record of more than {RECORD} bytes")))
    met = found.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("n", whole.alias("value")))).alias("lines"))
    return met.select("file", "number", F.array_join("lines.value", "\n").alias("record"))


def _marked(spark: SparkSession, path: str) -> bool:
    """Whether a file begins with a byte-order mark, by three bytes of one file; stores that only Spark opens count as without."""
    some = spark.read.text(path).select("_metadata.file_path").head(1)
    name = unquote(some[0][0]) if some else ""
    if name.split(":", 1)[0] not in OPENED:
        return False
    with opened(name) as file:
        return file.read(3) == BOM.encode()


def scan_delimited(spark: SparkSession, path: str, sep: str = ",", strict: bool = False, whole: bool = False) -> DataFrame:
    """Text columns of delimited files with a header; quoted fields may span lines.

    Tolerant: short rows are padded with nulls, empty fields are null, a byte-order mark
    stays in the first name. Strict: the mark is taken off, empty fields stay empty, and a
    row of another width raises. Files are read in parts (see `records`); whole: one task
    reads a file from end to end.
    """
    options = {"header": "true", "sep": sep, "multiLine": "true", "quote": '"', "escape": '"', "inferSchema": "false", "mode": "FAILFAST" if strict else "PERMISSIVE"}
    options |= {"nullValue": "" if not strict else "\x00", "emptyValue": ""}
    df = spark.read.options(**options).csv(path)
    if not strict and df.columns and _marked(spark, path):  # Spark's readers leave the mark out
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0].removeprefix(BOM))
    if not whole and df.columns:
        rows = records(spark, path).where("number > 1 and record <> ''")
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in df.columns)
        del options["header"], options["multiLine"]
        df = rows.select(F.from_csv("record", schema, options).alias("row")).select("row.*")
    if strict and df.columns and df.columns[0].startswith(BOM):
        df = df.withColumnRenamed(df.columns[0], df.columns[0][1:])
    empty = (lambda c: F.coalesce(c, F.lit(""))) if strict else (lambda c: F.nullif(c, F.lit("")))
    return df.select(*[empty(F.col(f"`{c}`")).alias(c) for c in df.columns])


def scan_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(pos, fields) of flat JSON lines, blank lines left out; fields is a map of text, nulls for JSON nulls.

    Strict: a nested value, a repeated key or a line that is no object raises.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("pos", F.monotonically_increasing_id())
    fields = F.from_json("value", "map<string,string>")
    df = lines.select("pos", "value", fields.alias("fields"))
    if strict:
        # A text may begin like a list or object; only then is the value's own kind looked at.
        suspect = F.exists(F.map_values("fields"), lambda v: F.coalesce(v.rlike(r"^\s*[\[{]"), F.lit(False)))
        kinds = F.transform(F.map_values(F.from_json("value", "map<string,variant>")), lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))
        nested = F.when(suspect, F.exists(kinds, lambda k: k.startswith("ARRAY") | k.startswith("OBJECT"))).otherwise(False)
        keys = F.map_keys("fields")
        twice = F.size(F.array_distinct(keys)) != F.size(keys)
        bad = F.col("fields").isNull() | nested | twice
        df = df.withColumn("fields", F.when(~F.coalesce(bad, F.lit(True)), F.col("fields")).otherwise(F.raise_error(F.lit("not a flat JSON object"))))
    return df.select("pos", "fields")


def jsonl_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Text columns of scan_jsonl's fields; missing keys are null."""
    return df.select("pos", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names])


def scan_documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of any table with text; bytes are decoded as UTF-8, bad bytes replaced."""
    text = F.col(text_col)
    if dict(df.dtypes)[text_col] == "binary":
        text = F.make_valid_utf8(text.cast("string"))
    return df.select(F.col(id_col).alias("id"), text.alias("text"))


def discover_schema(df: DataFrame, line: str, pos: str) -> DataFrame:
    """(key, first_pos, n): keys of JSON objects by first appearance, summed before the shuffle."""
    keys = df.select(F.col(pos), F.explode(F.json_object_keys(line)).alias("key"))
    return keys.groupBy("key").agg(F.min(pos).alias("first_pos"), F.count("*").alias("n"))


def within_first_bytes(df: DataFrame, pos: str, size: str, limit: int) -> DataFrame:
    """Rows whose record (and line end) lies within the first `limit` bytes, by position.

    Records have at least their line end, so only the first `limit` rows can count: a
    bounded head is taken before the running sum.
    """
    head = df.orderBy(pos).limit(limit)
    upto = F.sum(F.col(size) + 1).over(Window.orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return head.withColumn("_upto", upto).where(F.col("_upto") <= limit).drop("_upto")
