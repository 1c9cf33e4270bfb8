"""Registered queries over files, archives and streams that Spark derives from the tables."""

from __future__ import annotations

import io
import zipfile
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyvane.operators import census
from tallyvane.session import shared_path
from tallyvane.sources import archives, files, logs, text
from tallyvane.streaming import deadlines, state

from . import views as V
from .registry import query, table
from .views import REQUESTS


@query("SELECT count(*) AS rows, count(o_orderpriority) AS priorities, sum(o_orderkey::BIGINT)::BIGINT AS keys, count(DISTINCT o_orderstatus) AS statuses FROM orders")
def csv_scan(spark, sf):
    """A delimited file with quotes and empty fields, read back."""
    path = shared_path(spark, "csv")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit('say "'), "o_orderpriority", F.lit('",\nnext')).alias("o_orderpriority"), F.lit("").alias("none")).write.option("header", "true").option("quote", '"').option("escape", '"').csv(path)
    df = text.scan_delimited(spark, path)
    return df.where("none is null").agg(F.count("*").alias("rows"), F.count("o_orderpriority").alias("priorities"), F.sum(F.col("o_orderkey").cast("bigint")).alias("keys"), F.count_distinct("o_orderstatus").alias("statuses"))


@query("SELECT user_id, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def jsonl_scan(spark, sf):
    """Flat JSON lines, strict, read back."""
    path = shared_path(spark, "jsonl")
    k = F.get_json_object("props", "$.k").cast("bigint")
    table(spark, sf, "events").select(F.to_json(F.struct("user_id", k.alias("k"))).alias("value")).write.text(path)
    df = text.jsonl_columns(text.scan_jsonl(spark, path, strict=True), ["user_id", "k"])
    return df.groupBy(F.col("user_id").cast("bigint").alias("user_id")).agg(F.count("*").alias("n"), F.sum(F.col("k").cast("bigint")).alias("k"))


_LINE = "translate(coalesce(text, ''), chr(10) || chr(13), '  ')"


@query(f"SELECT 'part=' || doc_id // 100 AS folder, sum(strlen({_LINE}) + 1)::BIGINT AS size, sha256(string_agg({_LINE} || chr(10), '' ORDER BY doc_id)) AS sha256, count(*) AS lines FROM documents GROUP BY 1")
def file_listing(spark, sf):
    """Files of a hundred documents each, written, listed, digested and read again."""
    path, reports = shared_path(spark, "files"), shared_path(spark, "reports")
    docs = text.scan_documents(table(spark, sf, "documents"), "doc_id", "text")
    value = F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")
    parted = docs.select(F.floor(F.col("id") / 100).alias("part"), "id", value.alias("value"))
    parted.repartition("part").sortWithinPartitions("part", "id").select("part", "value").write.partitionBy("part").text(path)
    listed = files.list_files(spark, {"root": path}, cap=None).where("relative_path like 'part=%.txt'").join(files.file_digests(spark, path).select("path", "sha256"), "path")
    lines = spark.read.text(path).groupBy(F.concat(F.lit("part="), "part").alias("folder")).agg(F.count("*").alias("lines"))
    told = listed.select(F.regexp_extract("relative_path", "^([^/]*)/", 1).alias("folder"), "size", "sha256").join(lines, "folder")
    files.write_report(told, reports)
    return spark.read.schema("folder string, size bigint, sha256 string, lines bigint").json(reports)


@query("SELECT (doc_id // 20)::VARCHAR AS member, 'zip' AS kind, true AS opened, false AS partial, count(*) AS entries, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY 1")
def archive_rollups(spark, sf):
    """Archives of 20 documents each, expanded and rolled up."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for r in rows.itertuples():
                z.writestr(f"{r.doc_id}.txt", r.text or "")
        return pd.DataFrame({"member": [rows["member"].iloc[0]], "content": [out.getvalue()]})

    docs = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 20).cast("string").alias("member"), "doc_id", "text")
    packed = docs.groupBy("member").applyInPandas(pack, "member string, content binary")
    return archives.archive_rollup(archives.expand_archives(packed)).drop("reasons")


@query("SELECT source || '/d' || doc_id || '.ndjson' AS key, 'jsonl' AS format, doc_id AS size FROM documents")
def manifest_scan(spark, sf):
    """Snapshot manifests."""
    path = shared_path(spark, "manifest")
    d = F.col("doc_id").cast("string")
    table(spark, sf, "documents").select(F.lit("s3").alias("provider"), F.concat("source", F.lit("/d"), d, F.lit(".ndjson")).alias("key"), F.col("doc_id").alias("size")).write.json(path)
    return logs.scan_manifest(spark, path).select("key", "format", "size")


@query("SELECT event_type AS message_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def audit_scan(spark, sf):
    """An audit log of JSON lines."""
    path = shared_path(spark, "audit")
    table(spark, sf, "events").select(F.to_json(F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("message_type"))).alias("value")).write.text(path)
    return logs.scan_audit(spark, path).groupBy("message_type").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query("SELECT 'part=' || part AS part, last % 2 = 1 AS torn, bad - CASE WHEN last % 2 = 1 AND last % 7 = 3 THEN 1 ELSE 0 END AS bad_lines FROM (SELECT event_id // 500 AS part, max(event_id) AS last, count_if(event_id % 7 = 3) AS bad FROM events GROUP BY 1)")
def torn_tails(spark, sf):
    """Files of a log, whether their last lines are whole, and lines that are no entries."""
    path = shared_path(spark, "torn")
    e = table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 500).alias("part")).where("part is not null")
    # A window, not a join with the last ids: what a join puts next to each other is dealt anew where it turns into a broadcast, and a part gets several files.
    final = F.lead("event_id").over(Window.partitionBy("part").orderBy("event_id")).isNull()
    line = F.when(F.col("event_id") % 7 == 3, F.lit("{no entry")).otherwise(F.concat(F.lit('{"seq":'), F.col("event_id").cast("string"), F.lit("}")))
    end = F.when(F.col("final") & (F.col("event_id") % 2 == 1), "").otherwise("\n")
    lines = e.withColumn("final", final).select("part", "event_id", "final", F.concat(line, end).alias("value"))
    lines.sortWithinPartitions("part", "event_id", "final").select("part", "value").write.option("lineSep", "\x00").partitionBy("part").text(path)
    return logs.torn_tails(spark, path, "\x00").select(F.regexp_extract("part", "(part=[0-9]+)", 1).alias("part"), "torn", "bad_lines")


#: Letters beyond ASCII, and characters beyond Latin-1.
_HIGH, _BEYOND = r"[\x{80}-\x{FF}]", r"[^\x{00}-\x{FF}]"


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf8_bom' WHEN 1 THEN 'utf16' WHEN 2 THEN 'latin1_like' ELSE 'utf8' END AS encoding FROM documents WHERE regexp_matches(text, '{_HIGH}') AND NOT regexp_matches(text, '{_BEYOND}')")
def byte_encodings(spark, sf):
    """Encodings of the documents' own texts, each written in one of four; all texts with letters beyond ASCII that Latin-1 has."""
    k, t = F.col("doc_id") % 4, F.col("text")
    own = table(spark, sf, "documents").where(t.rlike(_HIGH) & ~t.rlike(_BEYOND))
    data = F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), t.cast("binary"))).when(k == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE"))).when(k == 2, F.encode(t, "ISO-8859-1")).otherwise(t.cast("binary"))
    return census.classified(own.select("doc_id", data.alias("content"))).select("doc_id", "encoding")


@query("SELECT count(*) AS members, sum(strlen(coalesce(text, '')))::BIGINT AS stored_bytes, 'complete' AS depth_class FROM documents")
def census_report(spark, sf):
    """The assembled report (its parts are checked by their own queries)."""
    m = V.members(spark, sf)
    report = census.census_report(m, census.findings(table(spark, sf, "documents")))
    return report.where("length(inventory) > 2 and length(inspected) > 2 and length(findings) > 2").select("members", "stored_bytes", "depth_class")


# Streams -------------------------------------------------------------------


def _streamed(spark, df, label: str):
    """df, a table that Spark derived, as a stream of its files."""
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _drained(spark, stream, label: str):
    """A finite stream's appended rows as a table."""
    path, check = shared_path(spark, label), shared_path(spark, label + "-check")
    done = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", check).trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("SELECT user_id, event_type, count(DISTINCT 1) AS n FROM events GROUP BY 1, 2")
def stream_dedupe(spark, sf):
    """The first row per key of a stream."""
    s = _streamed(spark, table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), "dedupe-in")
    return _drained(spark, state.stream_dedupe(s, ["user_id", "event_type"], delay="365 days"), "dedupe").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY oid, fid ORDER BY id) AS n FROM {REQUESTS}),
s AS (SELECT DISTINCT oid, fid, 0::BIGINT AS n, 0::BIGINT AS id, NULL::BIGINT AS granted_end, []::STRUCT(a BIGINT, b BIGINT)[] AS given FROM r
 UNION ALL SELECT oid, fid, n, id, granted_end, CASE WHEN granted_end IS NULL THEN given ELSE list_append(given, {{'a': start, 'b': granted_end}}) END FROM (
  SELECT oid, fid, n, id, start, given, CASE WHEN full_at IS NULL THEN "end" WHEN full_at > start THEN full_at - 1 END AS granted_end FROM (
   SELECT r.oid, r.fid, r.n, r.id, r.start, r."end", s.given,
    list_min(list_filter(list_append(list_transform(s.given, lambda x: x.a), r.start), lambda p: p >= r.start AND p <= r."end" AND len(list_filter(s.given, lambda x: x.a <= p AND x.b >= p)) >= 2)) AS full_at
   FROM s JOIN r ON r.oid = s.oid AND r.fid = s.fid AND r.n = s.n + 1)))
SELECT oid, fid, id, granted_end, CASE WHEN granted_end IS NULL THEN 'exhausted' ELSE 'granted' END AS verdict, len(list_distinct(flatten(list_transform(given, lambda x: range(x.a, x.b + 1)))))::BIGINT AS served FROM s WHERE n > 0""")
def stream_transfers(spark, sf):
    """A stream of transfer requests, granted against their state."""
    s = _streamed(spark, V.requests(spark, sf).select("oid", "fid", "id", "start", "end"), "transfers-in")
    return _drained(spark, state.stream_transfers(s), "transfers").select("oid", "fid", "id", "granted_end", "verdict", "served")


_ADMISSIONS = """WITH RECURSIVE e AS (SELECT event_type AS listing, event_id AS id, floor(epoch(ts))::BIGINT - CASE WHEN event_id % 11 = 3 THEN 90000 ELSE 0 END AS seconds, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT listing, 0::BIGINT AS n, 0::BIGINT AS id, ''::VARCHAR AS verdict, 0::BIGINT AS high, []::BIGINT[] AS days FROM e
 UNION ALL SELECT listing, n, id, verdict, CASE WHEN verdict = 'admitted' THEN greatest(high, seconds) ELSE high END, CASE WHEN verdict = 'admitted' THEN list_append(days, seconds // 86400) ELSE days END FROM (
  SELECT e.listing, e.n, e.id, e.seconds, s.high, s.days, CASE WHEN e.seconds < s.high - 300 THEN 'late' WHEN len(list_filter(s.days, lambda d: d = e.seconds // 86400)) >= 10 THEN 'over_quota' ELSE 'admitted' END AS verdict
  FROM s JOIN e ON e.listing = s.listing AND e.n = s.n + 1))
"""


def _admissions(spark, sf, label: str):
    e = table(spark, sf, "events").select(F.col("event_type").alias("listing"), F.col("event_id").alias("id"), (F.unix_seconds(F.col("ts").cast("timestamp")) - F.when(F.col("event_id") % 11 == 3, 90_000).otherwise(0)).alias("seconds"))
    return _streamed(spark, e, label)


@query(_ADMISSIONS + "SELECT listing, id, verdict FROM s WHERE n > 0")
def stream_admission(spark, sf):
    """T4: a stream of admissions with quota and high water."""
    return _drained(spark, state.stream_admission(_admissions(spark, sf, "admission-in")), "admission").select("listing", "id", "verdict")


@query(_ADMISSIONS + "SELECT listing, id FROM s WHERE verdict = 'late'")
def stream_late(spark, sf):
    """T5: the late rows of a stream of admissions."""
    return _drained(spark, state.stream_late(_admissions(spark, sf, "late-in")), "late").select("listing", "id")


#: State stores of a stream that comes in a few large batches, on up to half as many cores.
STORES = 32


@contextmanager
def _few_stores(spark):
    """Streams that start within have at most STORES shuffle partitions, or twice the cores if that is more: each is a state store, which a batch loads and commits even if it is empty."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), max(STORES, 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _batched(spark, tables, build, label: str, parts: int = 4):
    """The rows of a stream that build makes of tables, which come in batches in order of their columns at.

    A batch is what has been written when the stream is started again from its checkpoint, so it
    may have any number of files, and all cores write and read it.
    """
    paths = [shared_path(spark, f"{label}-in") for _ in tables]
    ends = [df.agg(F.min("at"), F.max("at")).first() for df in tables]
    build_on = lambda: build(*[spark.readStream.schema(df.schema).parquet(path) for df, path in zip(tables, paths, strict=True)])
    out, check = shared_path(spark, label), shared_path(spark, f"{label}-check")
    for i in range(parts):
        for df, path, (low, high) in zip(tables, paths, ends, strict=True):
            share = lambda k, low=low, high=high: low + (high - low) * k / parts
            part = df if low is None else df.where((F.col("at") >= share(i)) & ((F.col("at") < share(i + 1)) if i + 1 < parts else F.lit(True)))
            part.write.mode("append").parquet(path)
        stream = build_on()
        with _few_stores(spark):
            done = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
            done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("""WITH r AS (SELECT event_id AS id, epoch_ms(ts) AS t, epoch_ms(ts) + (event_id % 5 + 1) * 86400000 AS deadline, CASE WHEN event_id % 3 = 0 THEN epoch_ms(ts) + 3 * 86400000 END AS closed FROM events),
w AS (SELECT max(greatest(t, closed)) - 3600000 AS w FROM r)
SELECT id, CASE WHEN closed < deadline THEN 'closed' ELSE 'expired' END AS outcome FROM r, w WHERE closed IS NOT NULL OR deadline < w""")
def stream_expiry(spark, sf):
    """Requests that are closed, or expire in a batch after their own; those still open at the end are not reported."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    days = lambda n: F.make_dt_interval(n)
    opened = e.select("id", F.lit(deadlines.OPEN).alias("kind"), "at", (F.col("at") + days((F.col("id") % 5 + 1).cast("int"))).alias("deadline"))
    closed = e.where("id % 3 = 0").select("id", F.lit(deadlines.CLOSE), F.col("at") + days(F.lit(3)), F.lit(None).cast("timestamp"))
    return _batched(spark, [opened.union(closed)], lambda s: deadlines.stream_expiry(s, "1 hour"), "expiry").select("id", "outcome")


@query("""WITH r AS (SELECT event_id AS seq, epoch_ms(ts) AS t, CASE WHEN event_id % 4 <> 0 THEN epoch_ms(ts) + event_id % 5 * 172800000 END AS audited FROM events),
w AS (SELECT least(max(t), max(audited)) - 86400000 AS w FROM r)
SELECT seq, coalesce(audited < t + 604800000, false) AS delivered, CASE WHEN audited < t + 604800000 THEN seq END AS audit_seq FROM r, w WHERE audited IS NOT NULL OR t + 604800000 < w""")
def stream_outbox(spark, sf):
    """Outbox rows delivered by audits of later batches, or never within a week."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"))
    audits = e.where("seq % 4 <> 0").select("seq", F.col("seq").alias("audit_seq"), (F.col("at") + F.make_dt_interval((F.col("seq") % 5 * 2).cast("int"))).alias("at"))
    settled = _batched(spark, [e, audits], lambda s, a: deadlines.stream_outbox(s, a, "7 days", "1 day"), "outbox")
    return settled.select("seq", "delivered", "audit_seq")


@query("SELECT sha256('f' || doc_id) AS file_id, strlen(coalesce(text, ''))::BIGINT AS size, true AS present FROM documents")
def stream_inventory(spark, sf):
    """An inventory folded from a stream of listed files."""
    d = F.sha2(F.concat(F.lit("f"), F.col("doc_id").cast("string")).cast("binary"), 256)
    m = V.members(spark, sf).select(d.alias("file_id"), "size", F.lit("2024-01-01").cast("timestamp").alias("mtime"), "sha256")
    path = shared_path(spark, "inventory")
    state.stream_inventory(_streamed(spark, m, "inventory-in"), path, shared_path(spark, "inventory-check")).awaitTermination()
    last = spark.read.parquet(f"{path}/changes").agg(F.max("generation")).first()[0]
    return state.inventory_at(spark, path, last).select("file_id", "size", "present")


@query("""SELECT sha256('part=' || doc_id // 100) AS file_id, sum(strlen(translate(coalesce(text, ''), chr(10) || chr(13), '  ')) + 1)::BIGINT AS size, true AS present FROM documents GROUP BY 1""")
def stream_listing(spark, sf):
    """Files as they appear, digested as a stream, folded into an inventory and written as a generation."""
    path, out = shared_path(spark, "appearing"), shared_path(spark, "generations")
    value = F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")
    docs = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).alias("part"), "doc_id", value.alias("value"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    named = files.stream_files(spark, path).where("path like '%.txt'").select(F.sha2(F.regexp_extract("path", "(part=[0-9]+)", 1), 256).alias("file_id"), "size", "mtime", "sha256")
    folded = shared_path(spark, "listed")
    state.stream_inventory(named, folded, shared_path(spark, "listed-check"), complete=True).awaitTermination()
    files.write_generation(state.inventory_at(spark, folded, 0), out, 0)
    return spark.read.parquet(out).where("generation = 0").select("file_id", "size", "present")
