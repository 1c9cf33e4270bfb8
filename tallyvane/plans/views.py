"""Derived inputs of the registered queries, once in Spark and once in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import table

FORMATS = ["csv", "tsv", "jsonl", "parquet", "txt", "md", "zip", "py"]
KEYS = ["oid", "fid"]

MEMBERS = f"""(SELECT source AS listing_id, sha256(source || '/' || doc_id) AS identity, strlen(coalesce(text, ''))::BIGINT AS size, sha256(coalesce(text, '')) AS sha256,
 ({FORMATS!r})[doc_id % 8 + 1] AS format, doc_id, source || '/d' || doc_id || '.' || ({FORMATS!r})[doc_id % 8 + 1] AS key, '"' || substr(sha256(coalesce(text, '')), 1, 16) || '"' AS etag,
 CASE doc_id % 3 WHEN 0 THEN 'v' || doc_id WHEN 1 THEN 'null' ELSE '' END AS version_id FROM documents)"""
PREV = f"(SELECT sha256('f' || doc_id) AS file_id, size, doc_id % 5 AS mtime, sha256, TIMESTAMP '2024-01-01' + INTERVAL (doc_id % 28) DAY AS first_seen_at, TIMESTAMP '2024-02-01' AS changed_at, doc_id % 17 <> 0 AS present FROM {MEMBERS} WHERE doc_id % 10 <> 0)"
CUR = f"(SELECT sha256('f' || doc_id) AS file_id, size + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size, doc_id % 5 AS mtime, sha256 FROM {MEMBERS} WHERE doc_id % 7 <> 0)"
REQUESTS = """(SELECT event_id AS id, user_id AS oid, event_type AS fid, (event_id * 37) % 2000 AS start, (event_id * 37) % 2000 + 4 * json_extract(props, '$.k')::BIGINT AS "end", ts, value FROM events)"""
SERVES = f"""(SELECT oid, fid, pos AS start, nxt - 1 AS "end", c AS count FROM (SELECT oid, fid, pos, lead(pos) OVER w AS nxt, sum(d) OVER (PARTITION BY oid, fid ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS c
 FROM (SELECT oid, fid, pos, sum(d) AS d FROM (SELECT oid, fid, start AS pos, 1 AS d FROM {REQUESTS} UNION ALL SELECT oid, fid, "end" + 1, -1 FROM {REQUESTS}) GROUP BY ALL HAVING sum(d) <> 0) WINDOW w AS (PARTITION BY oid, fid ORDER BY pos)) WHERE c > 0)"""
ISLANDS = f"""(SELECT oid, fid, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY oid, fid ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island
 FROM (SELECT oid, fid, start, "end", CASE WHEN start > coalesce(max("end") OVER (PARTITION BY oid, fid ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -9) + 1 THEN 1 ELSE 0 END AS fresh FROM {REQUESTS} WHERE id % 3 <> 0)) GROUP BY oid, fid, island)"""
SIZES = f"(SELECT DISTINCT oid, fid, 40 * (oid % 9) AS size FROM {REQUESTS})"
PERMISSIONS = f"""(SELECT oid || '-' || fid || '-' || id % 3 AS jti, oid, fid, min(ts) AS bound_at, CASE WHEN oid % 2 = 0 THEN max(ts) END AS closed_at,
 CASE oid % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'issued' WHEN 2 THEN 'revoked' ELSE 'bound' END AS state, floor(epoch(min(ts)))::BIGINT + 86400 AS sd, floor(epoch(max(ts)))::BIGINT + 3 * 86400 AS td FROM {REQUESTS} GROUP BY oid, fid, id % 3)"""


def members(spark, sf):
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    sha, fmt = F.sha2(text.cast("binary"), 256), F.element_at(F.array(*map(F.lit, FORMATS)), (d % 8 + 1).cast("int"))
    ident = F.sha2(F.concat("source", F.lit("/"), d.cast("string")).cast("binary"), 256)
    return table(spark, sf, "documents").select(
        F.col("source").alias("listing_id"), ident.alias("identity"), F.octet_length(text).cast("bigint").alias("size"), sha.alias("sha256"), fmt.alias("format"), "doc_id",
        F.concat("source", F.lit("/d"), d.cast("string"), F.lit("."), fmt).alias("key"), F.concat(F.lit('"'), F.substring(sha, 1, 16), F.lit('"')).alias("etag"),
        F.when(d % 3 == 0, F.concat(F.lit("v"), d.cast("string"))).when(d % 3 == 1, "null").otherwise("").alias("version_id"),
    )


def prev(spark, sf):
    d = F.col("doc_id")
    seen = F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), (d % 28).cast("int")))
    return members(spark, sf).where(d % 10 != 0).select(
        F.sha2(F.concat(F.lit("f"), d.cast("string")).cast("binary"), 256).alias("file_id"), "size", (d % 5).alias("mtime"), "sha256", seen.alias("first_seen_at"),
        F.lit("2024-02-01").cast("timestamp").alias("changed_at"), (d % 17 != 0).alias("present"),
    )


def cur(spark, sf):
    d = F.col("doc_id")
    return members(spark, sf).where(d % 7 != 0).select(
        F.sha2(F.concat(F.lit("f"), d.cast("string")).cast("binary"), 256).alias("file_id"), (F.col("size") + F.when(d % 13 == 0, 1).otherwise(0)).alias("size"), (d % 5).alias("mtime"), "sha256"
    )


def requests(spark, sf):
    start = F.col("event_id") * 37 % 2000
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("oid"), F.col("event_type").alias("fid"), start.alias("start"),
        (start + 4 * F.get_json_object("props", "$.k").cast("bigint")).alias("end"), "ts", "value",
    )


def serves(spark, sf):
    from tallyvane.operators.intervals import serve_counts

    return serve_counts(requests(spark, sf), KEYS)


def islands(spark, sf):
    from tallyvane.operators.intervals import coverage_islands

    return coverage_islands(requests(spark, sf).where("id % 3 <> 0"), KEYS)


def sizes(spark, sf):
    return requests(spark, sf).select("oid", "fid", (40 * (F.col("oid") % 9)).alias("size")).distinct()


def permissions(spark, sf):
    r = requests(spark, sf).withColumn("k", F.col("id") % 3)
    state = F.element_at(F.array(*map(F.lit, ["closed", "issued", "revoked", "bound"])), (F.col("oid") % 4 + 1).cast("int"))
    return r.groupBy("oid", "fid", "k").agg(F.min("ts").alias("bound_at"), F.max("ts").alias("last")).select(
        F.concat_ws("-", F.col("oid").cast("string"), "fid", F.col("k").cast("string")).alias("jti"), "oid", "fid", "bound_at", F.when(F.col("oid") % 2 == 0, F.col("last")).alias("closed_at"),
        state.alias("state"), (F.unix_seconds(F.col("bound_at").cast("timestamp")) + 86400).alias("sd"), (F.unix_seconds(F.col("last").cast("timestamp")) + 3 * 86400).alias("td"),
    )
