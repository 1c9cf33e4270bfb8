"""Registered queries over inventories, listings and the delivery ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.functions import content as C
from tallyvane.functions import ids
from tallyvane.operators import census, inventory, ledger, listing
from tallyvane.operators import intervals as I

from . import views as V
from .registry import query, table
from .views import CUR, ISLANDS, KEYS, MEMBERS, PERMISSIONS, PREV, REQUESTS, SERVES, SIZES

ID_KEY, COMMIT_KEY = ids.derive_keys(bytes(range(32)))


def _hmac(key_hex: str, message: str) -> str:
    inner, outer = ids.pads(key_hex)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"


_Z = "unhex('00')"


_COMPOSED = f"""(SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN key WHEN 1 THEN key || 'e' || chr(769) || 'A' || chr(778) ELSE key || 'é' END AS k, etag, CASE WHEN doc_id % 5 = 0 THEN 'v' || 'u' || chr(776) ELSE version_id END AS v FROM {MEMBERS})"""


@query(f"""SELECT doc_id, sha256(nfc_normalize(k) || chr(0) || nfc_normalize(CASE WHEN v IN ('', 'null') THEN etag ELSE v END)) AS identity_digest FROM {_COMPOSED}""")
def composed_ids(spark, sf):
    """identities of keys and versions with letters beyond ASCII, composed or not."""
    d = F.col("doc_id")
    key = F.when(d % 3 == 0, F.col("key")).when(d % 3 == 1, F.concat("key", F.lit("e\u0301A\u030a"))).otherwise(F.concat("key", F.lit("é")))
    m = V.members(spark, sf).select("doc_id", key.alias("key"), "etag", F.when(d % 5 == 0, "vu\u0308").otherwise(F.col("version_id")).alias("version_id"))
    return ids.identities(m, "key", "etag", "version_id").select("doc_id", F.sha2(F.col("identity").cast("binary"), 256).alias("identity_digest"))


@query(f"""SELECT doc_id, substr({_hmac(ID_KEY, f"encode(listing_id) || {_Z} || encode(key)")}, 1, 32) AS file_id, {_hmac(COMMIT_KEY, "unhex(sha256)")} AS commitment,
 {_hmac(ID_KEY, f"encode('object') || {_Z} || encode('gateway_listing') || {_Z} || encode('gw') || {_Z} || encode(identity) || {_Z} || encode(sha256)")} AS object_id,
 {_hmac(ID_KEY, f"encode('s3_listing') || {_Z} || encode('bucket') || {_Z} || encode(sha256)")} AS locator,
 sha256(encode(key) || {_Z} || encode(coalesce(nullif(nullif(version_id, 'null'), ''), etag))) AS identity_digest FROM {MEMBERS}""")
def keyed_ids(spark, sf):
    """Keyed ids, commitments and canonical identities."""
    c = F.col
    return V.members(spark, sf).select(
        "doc_id", ids.file_id(ID_KEY, c("listing_id"), c("key")).alias("file_id"), ids.content_commitment(COMMIT_KEY, c("sha256")).alias("commitment"),
        ids.object_id(ID_KEY, "gateway_listing", "gw", c("identity"), c("sha256")).alias("object_id"), ids.locator_commitment(ID_KEY, "s3_listing", "bucket", c("sha256")).alias("locator"),
        F.sha2(ids.identity(c("key"), c("etag"), c("version_id"), ascii_only=True).cast("binary"), 256).alias("identity_digest"),
    )


@query("SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"none\":null}') AS digest FROM nation")
def row_digests(spark, sf):
    """canonical row digests, nulls kept."""
    return table(spark, sf, "nation").withColumn("none", F.lit(None).cast("string")).select("n_nationkey", ids.row_digest("n_nationkey", "n_name", "none").alias("digest"))


@query("""SELECT v, count(*) AS n, regexp_full_match(v, '[0-9-]{10}T[0-9:]{8}(\\.[0-9]{1,6})?Z') AS ok FROM (SELECT CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.1234567Z') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.5Z') END AS v FROM events) GROUP BY v""")
def utc_checks(spark, sf):
    """UTC timestamps of at most microseconds."""
    k, base = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    v = F.concat(base, F.when(k == 0, "Z").when(k == 1, "+00:00").when(k == 2, ".1234567Z").otherwise(".5Z"))
    return table(spark, sf, "events").select(v.alias("v")).groupBy("v").agg(F.count("*").alias("n")).withColumn("ok", ids.is_utc_micros(F.col("v")))


_EXT = " ".join(f"WHEN format IN ({', '.join(repr(f) for f in fs)}) THEN '{k}'" for k, fs in C.EXTENSION_CLASSES.items())


@query(f"""SELECT format, CASE {_EXT} ELSE 'other' END AS class, CASE format WHEN 'zip' THEN 'zip' END AS archive, format IN ('csv', 'tsv', 'jsonl', 'parquet') AS is_table, count(*) AS n
FROM (SELECT regexp_extract(key, '\\.([^.]+)$', 1) AS format FROM {MEMBERS}) GROUP BY ALL""")
def format_classes(spark, sf):
    """Format from the key, its class, archive kind and table scope."""
    f = V.members(spark, sf).select(C.format_of(F.col("key")).alias("format"))
    return f.select("format", C.extension_class(F.col("format")).alias("class"), C.archive_format(F.col("format")).alias("archive"), listing.is_table(F.col("format")).alias("is_table")).groupBy("format", "class", "archive", "is_table").agg(F.count("*").alias("n"))


@query(f"SELECT key FROM {MEMBERS} WHERE key IN ('src2/d2.jsonl', 'src3/d3.parquet') OR starts_with(key, 'src1/') OR starts_with(key, 'src7/')")
def scope_filter(spark, sf):
    """P10: members in the read scope."""
    return V.members(spark, sf).where(listing.in_scope(F.col("key"), ["src2/d2.jsonl", "src3/d3.parquet"], ["src1/", "src7"])).select("key")


@query(f"SELECT key FROM {MEMBERS} WHERE starts_with(key, 'src1/') OR regexp_full_match(key, 'src2/[^/]*\\.csv') OR regexp_full_match(key, 'src3/d[^/]\\.parquet')")
def ceiling_filter(spark, sf):
    """Members within the offer ceiling."""
    return V.members(spark, sf).where(ledger.within_ceiling(F.col("key"), ["src1/**", "src2/*.csv", "src3/d?.parquet"])).select("key")


_ALIASES = [("src1/d1.tsv", "first"), ("d2.jsonl", "second"), ("src3/d3.parquet", ""), ("d3.parquet", "third")]
_ALIAS_SQL = ", ".join(f"('{k}', '{v}')" for k, v in _ALIASES)


@query(f"""SELECT m.doc_id, coalesce(nullif(a.v, ''), nullif(b.v, ''), 'file-' || substr(m.identity, 1, 8) || '.' || CASE m.format WHEN 'csv' THEN 'csv' WHEN 'tsv' THEN 'tsv' WHEN 'jsonl' THEN 'jsonl' WHEN 'parquet' THEN 'parquet' ELSE 'bin' END) AS name
FROM {MEMBERS} m LEFT JOIN (VALUES {_ALIAS_SQL}) a(k, v) ON a.k = m.key LEFT JOIN (VALUES {_ALIAS_SQL}) b(k, v) ON b.k = substr(m.key, instr(m.key, '/') + 1)""")
def display_names(spark, sf):
    """Aliases, else neutral names."""
    a = spark.createDataFrame(_ALIASES, "k string, v string")
    media = {"csv": "text/csv", "tsv": "text/tab-separated-values", "jsonl": "application/x-ndjson", "parquet": "application/vnd.apache.parquet"}
    m = V.members(spark, sf).withColumn("rel", F.substring_index("key", "/", -1))
    full, rel = a.select(F.col("k").alias("key"), F.col("v").alias("full")), a.select(F.col("k").alias("rel"), F.col("v").alias("part"))
    joined = m.join(F.broadcast(full), "key", "left").join(F.broadcast(rel), "rel", "left")  # the configured aliases, a local table
    return joined.select("doc_id", ids.display_name(F.col("identity"), C.lookup(F.col("format"), media, ""), F.col("full"), F.col("part")).alias("name"))


_SCHEMA = "(SELECT source AS listing_id, doc_id AS object_id, unnest(['id', 'name_' || lang, CASE doc_id % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'secret' WHEN 2 THEN '' ELSE repeat('x', 100 + 2 * (doc_id % 100)::INTEGER) END]) AS name FROM documents)"


def _schemas(spark, sf):
    d = F.col("doc_id")
    last = F.when(d % 4 == 0, "id").when(d % 4 == 1, "secret").when(d % 4 == 2, "").otherwise(F.repeat(F.lit("x"), (100 + 2 * (d % 100)).cast("int")))
    return table(spark, sf, "documents").select(F.col("source").alias("listing_id"), d.alias("object_id"), F.explode(F.array(F.lit("id"), F.concat(F.lit("name_"), "lang"), last)).alias("name"))


@query(f"SELECT object_id, count(*) <= 1000 AND count(DISTINCT name) = count(*) AND min(length(name)) >= 1 AND max(length(name)) <= 256 AS valid FROM {_SCHEMA} GROUP BY 1")
def column_name_check(spark, sf):
    """Validity of column names."""
    return listing.name_check(_schemas(spark, sf))


@query(f"SELECT DISTINCT object_id FROM {_SCHEMA} WHERE name IN ('secret', 'name_de')")
def hidden_column_members(spark, sf):
    """Members with a column that a rule hides."""
    return listing.affected_members(_schemas(spark, sf), spark.createDataFrame([("secret",), ("name_de",)], "name string"))


_SIZE_BUCKET = "CASE WHEN {n} = 0 THEN '0' WHEN {n} < 1024 THEN '<1KB' WHEN {n} < 10240 THEN '<10KB' WHEN {n} < 102400 THEN '<100KB' WHEN {n} < 1048576 THEN '<1MB' WHEN {n} < 10485760 THEN '<10MB' WHEN {n} < 104857600 THEN '<100MB' ELSE '>=100MB' END"
_BAND = "CASE WHEN {n} = 0 THEN '0' WHEN {n} < 10 THEN '1-9' WHEN {n} < 100 THEN '10-99' WHEN {n} < 1000 THEN '100-999' ELSE '1000+' END"
_REQ_BAND = "CASE WHEN {n} < 1000 THEN " + _BAND + " WHEN {n} < 1024000 THEN (1000 * pow(2, floor(log2({n} / 1000.0))))::BIGINT || '-' || (2000 * pow(2, floor(log2({n} / 1000.0))) - 1)::BIGINT ELSE '' END"


@query(f"""SELECT listing_id, CASE WHEN sum(size) * 100 < 10000000 THEN 'small' WHEN sum(size) * 100 < 100000000 THEN 'medium' ELSE 'large' END AS size_class, {_SIZE_BUCKET.format(n='sum(size)')} AS size_bucket, {_BAND.format(n='count(*)')} AS count_band, {_REQ_BAND.format(n='sum(size)')} AS request_band FROM {MEMBERS} GROUP BY 1""")
def listing_bands(spark, sf):
    """Size class, size bucket, count and request bands of listings."""
    s = V.members(spark, sf).groupBy("listing_id").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    return s.select("listing_id", C.size_class(F.col("s") * 100).alias("size_class"), C.size_bucket(F.col("s")).alias("size_bucket"), C.count_band(F.col("n")).alias("count_band"), C.request_band(F.col("s")).alias("request_band"))


@query(f"""WITH x AS (SELECT * FROM {MEMBERS}) SELECT 'extension' AS part, CASE {_EXT} ELSE 'other' END AS class, count(*)::BIGINT AS n FROM x GROUP BY ALL UNION ALL SELECT 'size', {_SIZE_BUCKET.format(n='size')}, count(*) FROM x GROUP BY ALL
UNION ALL SELECT 'archives', CASE format WHEN 'zip' THEN 'zip' ELSE 'none' END, count(*) FROM x GROUP BY ALL UNION ALL SELECT 'stored_bytes', 'all', sum(size)::BIGINT FROM x""")
def inventory_counts(spark, sf):
    """Members by extension class and size bucket, archives, bytes."""
    return census.inventory_counts(V.members(spark, sf))


_STATES = f"(SELECT *, CASE doc_id % 5 WHEN 0 THEN 'unread' WHEN 1 THEN 'partly_read' ELSE 'fully_read' END AS state, CASE doc_id % 5 WHEN 0 THEN 'over_cap' WHEN 1 THEN 'budget' END AS reason FROM {MEMBERS})"


def _states(spark, sf):
    k = F.col("doc_id") % 5
    return V.members(spark, sf).withColumn("state", F.when(k == 0, "unread").when(k == 1, "partly_read").otherwise("fully_read")).withColumn("reason", F.when(k == 0, "over_cap").when(k == 1, "budget"))


@query(f"SELECT state, reason, count(*) AS members, sum(size)::BIGINT AS bytes FROM {_STATES} GROUP BY ALL")
def read_states(spark, sf):
    """Read states and reasons."""
    return census.read_states(_states(spark, sf))


@query(f"""SELECT listing_id, sum(r)::BIGINT AS readable, sum(u)::BIGINT AS unreadable, sum(u) > 0 AND sum(r) < (sum(r) + sum(u) + 9) // 10 AS limited FROM (SELECT listing_id, CASE WHEN doc_id % 11 = 0 THEN size ELSE 0 END AS r, CASE WHEN doc_id % 11 <> 0 THEN size ELSE 0 END AS u FROM {MEMBERS}) GROUP BY 1""")
def limited_coverage(spark, sf):
    """Listings with little readable content."""
    k = F.col("doc_id") % 11 == 0
    m = V.members(spark, sf).withColumn("readable", F.when(k, F.col("size")).otherwise(0)).withColumn("unreadable", F.when(~k, F.col("size")).otherwise(0))
    return census.limited_coverage(m, ["listing_id"])


_PRE = f"(SELECT listing_id, sum(size)::BIGINT AS total, sum(size) FILTER (doc_id % 17 = 0)::BIGINT AS known, sum(size) FILTER (doc_id % 19 = 0)::BIGINT AS unknown, count(*)::BIGINT AS members, count(*) * 3000 AS possible, sum(size)::BIGINT AS requests FROM {MEMBERS} GROUP BY 1)"


@query(f"""WITH p AS (SELECT listing_id, total, coalesce(known, 0) AS known, coalesce(unknown, 0) AS unknown, members, possible, requests FROM {_PRE})
SELECT *, CASE WHEN known >= ceil(total / 10) THEN 'meets_floor' WHEN known + unknown >= ceil(total / 10) THEN 'meets_floor_unknown_expansion' ELSE 'below_floor' END AS floor_result,
 CASE WHEN requests >= 1024000 OR members > 65536 OR possible > (67108864 - members * 1024) // 384 THEN 'over_bound' ELSE 'within_bounds' END AS admission_result, {_REQ_BAND.format(n='requests')} AS requests_band FROM p""")
def preflight(spark, sf):
    """Preflight floor, admission and request band."""
    d, some = F.col("doc_id"), lambda c, n: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).alias(n)
    t = V.members(spark, sf).groupBy("listing_id").agg(F.sum("size").alias("total"), some(d % 17 == 0, "known"), some(d % 19 == 0, "unknown"), F.count("*").alias("members"), (F.count("*") * 3000).alias("possible"), F.sum("size").alias("requests"))
    return census.preflight(t)


@query(f"""WITH s AS (SELECT listing_id, reason, count(*) AS n, count(*) FILTER (format IN ('csv', 'tsv', 'jsonl', 'parquet')) AS t FROM {_STATES} GROUP BY ALL)
SELECT listing_id, sum(n)::BIGINT AS discovered, coalesce(sum(t) FILTER (reason IS NULL), 0)::BIGINT AS scanned, coalesce(sum(n - t) FILTER (reason IS NULL), 0)::BIGINT AS in_census, coalesce(max(n) FILTER (reason = 'budget'), 0)::BIGINT AS budget, coalesce(max(n) FILTER (reason = 'over_cap'), 0)::BIGINT AS over_cap FROM s GROUP BY 1""")
def listing_coverage(spark, sf):
    """Coverage with skip reasons."""
    c = listing.coverage(_states(spark, sf))
    skip = lambda k: F.coalesce(F.try_element_at("skipped", F.lit(k)), F.lit(0)).alias(k)
    return c.select("listing_id", "discovered", "scanned", "in_census", skip("budget"), skip("over_cap"))


_FACTS = "(SELECT listing_id, object_id, row_number() OVER (PARTITION BY object_id ORDER BY name) - 1 AS ordinal, name, CASE WHEN name = 'id' THEN 'integer' ELSE 'string' END AS type FROM (SELECT DISTINCT * FROM " + _SCHEMA + "))"


def _facts(spark, sf):
    from pyspark.sql import Window

    s = _schemas(spark, sf).distinct()
    return s.withColumn("ordinal", F.row_number().over(Window.partitionBy("object_id").orderBy("name")) - 1).withColumn("type", F.when(F.col("name") == "id", "integer").otherwise("string"))


@query(f"SELECT object_id, list(name ORDER BY ordinal) AS names, list(type ORDER BY ordinal) AS types FROM {_FACTS} GROUP BY 1")
def folded_objects(spark, sf):
    """Columns of objects as arrays in order."""
    return listing.fold_objects(_facts(spark, sf))


@query(f"""WITH f AS (SELECT listing_id, object_id, list(name ORDER BY ordinal) AS names, list(type ORDER BY ordinal) AS types FROM {_FACTS} GROUP BY 1, 2),
d AS (SELECT listing_id, object_id, sha256('{{"names":["' || array_to_string(names, '","') || '"],"object_id":' || object_id || ',"types":["' || array_to_string(types, '","') || '"]}}') AS d FROM f)
SELECT listing_id, sha256(string_agg(d, '' ORDER BY object_id)) AS fingerprint FROM d GROUP BY 1""")
def listing_fingerprints(spark, sf):
    """Fingerprints of listings."""
    f = _facts(spark, sf)
    return listing.fingerprint(listing.fold_objects(f).join(f.select("listing_id", "object_id").distinct(), "object_id"))


_U64 = "lpad(hex({n}), 16, '0')"
_FRAME = "(" + _U64.format(n="strlen({t})") + " || hex(encode({t})))"
_META = f"({_U64.format(n='size')} || {_FRAME.format(t='trim(etag, chr(34))')} || {_FRAME.format(t='version_id')})"
PLAN = f"(SELECT listing_id, identity FROM {MEMBERS} WHERE doc_id % 2 = 0)"


def _plan(spark, sf):
    return V.members(spark, sf).where("doc_id % 2 = 0").select("listing_id", "identity")


@query(f"SELECT listing_id, sha256(unhex(string_agg({_FRAME.format(t='identity')} || {_U64.format(n='size')} || upper(sha256), '' ORDER BY identity))) AS digest FROM {MEMBERS} GROUP BY 1")
def ordered_digests(spark, sf):
    """Content digests of listings in identity order."""
    return listing.ordered_digest(V.members(spark, sf))


@query(f"SELECT listing_id, sha256(unhex(string_agg({_FRAME.format(t='identity')} || {_META}, '' ORDER BY identity))) AS digest FROM {MEMBERS} WHERE format NOT IN ('csv', 'tsv', 'jsonl', 'parquet') AND doc_id % 2 <> 0 GROUP BY 1")
def unread_bindings(spark, sf):
    """Bindings of members outside the plan."""
    return listing.unread_binding(V.members(spark, sf), _plan(spark, sf))


@query(f"""SELECT listing_id, identity, CASE state WHEN 'fully_read' THEN 'full' WHEN 'partly_read' THEN 'decoded_prefix' ELSE 'unread' END AS tag,
 CASE state WHEN 'fully_read' THEN sha256 WHEN 'partly_read' THEN sha256(unhex({_U64.format(n='strlen(key)')} || hex(encode('decoded_prefix' || key)))) ELSE sha256(unhex({_META})) END AS digest FROM {_STATES}""")
def member_commitments(spark, sf):
    """What was read of every member, as tag and digest."""
    return listing.member_commitment(_states(spark, sf).withColumn("prefix", F.col("key")))


@query(f"SELECT listing_id, greatest(1, (512 + sum(n + 512) + 2) // 3)::BIGINT AS tokens, greatest(1, (512 + sum(n + 512) + 2) // 3) > 8192 AS over FROM (SELECT listing_id, object_id, sum(strlen(name) * 6 + 768) AS n FROM {_SCHEMA} GROUP BY ALL) GROUP BY 1")
def token_estimates(spark, sf):
    """Token estimates of reports."""
    return listing.token_estimate(_schemas(spark, sf))


@query(f"""WITH s AS (SELECT listing_id, count(*) AS members, coalesce(sum(size * 20000) FILTER (format IN ('csv', 'tsv', 'jsonl')), 0)::BIGINT AS text, coalesce(sum(size * 20000) FILTER (format = 'parquet'), 0)::BIGINT AS parquet FROM {MEMBERS} GROUP BY 1)
SELECT *, CASE WHEN members > 17033 THEN 'member_count_exceeded' WHEN 955904 + 67 * members > 2097152 OR text > 6000000000 OR parquet > 1000000000 OR text + 6 * parquet > 6000000000 OR 9 * text + 50 * parquet > 54000000000 THEN 'refused' ELSE 'admitted' END AS verdict FROM s""")
def size_admission(spark, sf):
    """Size admission of listings."""
    return listing.admit_size(V.members(spark, sf).withColumn("size", F.col("size") * 20000))


@query(f"SELECT listing_id, identity FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY {_hmac(ID_KEY, 'encode(identity)')}, identity) AS rk FROM {MEMBERS}) WHERE rk <= 5")
def keyed_sample(spark, sf):
    """O2: the first five members of each listing in keyed order."""
    ranked = listing.keyed_rank(V.members(spark, sf), ID_KEY).withColumn("at", F.struct("rank_key", "identity"))
    return ledger.admit_quota(ranked, ["listing_id"], ["at"], 5).where("admitted").select("listing_id", "identity")


@query(f"""WITH RECURSIVE c AS (SELECT listing_id, identity, CASE WHEN format IN ('zip', 'tar.gz', 'tgz') THEN 6000 ELSE size END AS cost, row_number() OVER (PARTITION BY listing_id ORDER BY {_hmac(ID_KEY, 'encode(identity)')}, identity) AS n
 FROM {MEMBERS} WHERE format NOT IN ('csv', 'tsv', 'jsonl', 'parquet')),
s AS (SELECT DISTINCT listing_id, 0::BIGINT AS n, 20000::BIGINT AS room, ''::VARCHAR AS identity, false AS fits FROM c
 UNION ALL SELECT c.listing_id, c.n, s.room - CASE WHEN c.cost <= s.room THEN c.cost ELSE 0 END, c.identity, c.cost <= s.room FROM s JOIN c ON c.listing_id = s.listing_id AND c.n = s.n + 1)
SELECT listing_id, identity FROM s WHERE fits""")
def planned_reads(spark, sf):
    """Greedy keyed read plans within a byte budget."""
    return listing.planned_read_set(V.members(spark, sf), ID_KEY, budget=20_000, allowance=6_000)


@query(f"""WITH r AS (SELECT listing_id, count(*) + (CASE WHEN listing_id = 'src3' THEN 1 ELSE 0 END) AS members, count(*) FILTER (doc_id % 2 = 0) + (CASE WHEN listing_id = 'src4' THEN 1 ELSE 0 END) AS fully_read, count(*) FILTER (doc_id % 2 = 1) - (CASE WHEN listing_id = 'src5' THEN 1 ELSE 0 END) AS unread, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS planned FROM {MEMBERS} GROUP BY 1)
SELECT listing_id, 'members' AS violation FROM r WHERE members <> n UNION ALL SELECT listing_id, 'read_over_plan' FROM r WHERE fully_read > planned UNION ALL SELECT listing_id, 'unread_short' FROM r WHERE unread < n - planned""")
def coverage_violations(spark, sf):
    """Reports that do not agree with members and plan."""
    l, one = F.col("listing_id"), lambda s: F.when(F.col("listing_id") == s, 1).otherwise(0)
    even = F.count_if(F.col("doc_id") % 2 == 0)
    r = V.members(spark, sf).groupBy(l).agg(F.count("*").alias("n"), even.alias("e")).select("listing_id", (F.col("n") + one("src3")).alias("members"), (F.col("e") + one("src4")).alias("fully_read"), (F.col("n") - F.col("e") - one("src5")).alias("unread"))
    return listing.check_coverage(r, V.members(spark, sf), _plan(spark, sf))


_CENSUS = f"""(SELECT listing_id, substr(listing_id, 4)::INTEGER AS k, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS planned FROM {MEMBERS} GROUP BY 1)"""
_BAND = "CASE WHEN n = 0 THEN '0' WHEN n < 10 THEN '1-9' WHEN n < 100 THEN '10-99' WHEN n < 1000 THEN '100-999' ELSE '1000+' END"


@query(f"""WITH c AS (SELECT *, CASE k WHEN 1 THEN (n + 1)::VARCHAR WHEN 2 THEN n::VARCHAR WHEN 3 THEN '5-7' ELSE {_BAND} END AS members, CASE WHEN k = 4 THEN '0' ELSE n::VARCHAR END AS population, CASE k WHEN 5 THEN '{listing.COMPLETE}' WHEN 6 THEN 'whole' ELSE '{listing.SAMPLED}' END AS depth, k <> 7 AS sampled,
 CASE k WHEN 8 THEN 'suppressed' WHEN 9 THEN 'open' ELSE 'checked' END AS state, planned + CASE k WHEN 10 THEN 1 WHEN 11 THEN 1 ELSE 0 END AS read, greatest(0, n - planned - CASE k WHEN 11 THEN 1 WHEN 12 THEN 1 ELSE 0 END) AS unread FROM {_CENSUS}),
v AS (SELECT *, state = 'checked' AS checked, CASE WHEN k = 13 THEN 0 ELSE read END AS read_told, CASE WHEN k = 15 THEN read ELSE 0 END AS again FROM c)
SELECT listing_id, unnest(list_filter([CASE WHEN NOT (CASE WHEN regexp_full_match(members, '[0-9]+') THEN members::BIGINT = n ELSE members = {_BAND} END) THEN 'members_outside_band' END, CASE WHEN depth NOT LIKE 'content%' THEN 'depth_class_unknown' END, CASE WHEN depth = '{listing.COMPLETE}' THEN 'complete_but_sampled' END,
 CASE WHEN depth = '{listing.SAMPLED}' AND NOT sampled THEN 'sampled_but_complete' END, CASE WHEN state = 'open' THEN 'state_unknown' END, CASE WHEN checked AND population::BIGINT <> n THEN 'population_outside_band' END, CASE WHEN k = 13 THEN 'cell_not_exact' END, CASE WHEN k = 15 THEN 'cell_repeated' END, CASE WHEN k = 14 THEN 'cell_unknown' END,
 CASE WHEN checked AND read_told + again + unread <> n THEN 'cells_do_not_sum_up' END, CASE WHEN checked AND read_told + again > planned THEN 'read_over_plan' END, CASE WHEN checked AND unread < n - planned THEN 'unread_short' END], lambda x: x IS NOT NULL)) AS violation FROM v""")
def census_violations(spark, sf):
    """Published census reports with every kind of fault, against members and plan."""
    m = V.members(spark, sf)
    k, n, p = F.substring("listing_id", F.lit(4), F.lit(9)).cast("int"), F.col("n"), F.col("p")
    of = lambda *ks: F.when(k.isin(*ks), 1).otherwise(0)
    band = F.when(n == 0, "0").when(n < 10, "1-9").when(n < 100, "10-99").when(n < 1000, "100-999").otherwise("1000+")
    told = F.when(k == 1, (n + 1).cast("string")).when(k == 2, n.cast("string")).when(k == 3, "5-7").otherwise(band)
    cell = lambda kind, count: F.struct(F.lit(kind).alias("class"), count.cast("string").alias("members"))
    read, unread = p + of(10, 11), F.greatest(F.lit(0), n - p - of(11, 12))
    cells = F.when(k == 13, F.array(cell("fully_read", F.lit("1-9")), cell("unread", unread))).when(k == 14, F.array(cell("fully_read", read), cell("unread", unread), cell("odd", F.lit(0))))
    cells = cells.when(k == 15, F.array(cell("other", read), cell("other", read), cell("unread", unread))).otherwise(F.array(cell("partly_read", read), cell("unread", unread)))
    counts = m.groupBy("listing_id").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 2 == 0).alias("p"))
    reports = counts.select(
        "listing_id", told.alias("members"), told.alias("members_total"), F.when(k == 4, "0").otherwise(n.cast("string")).alias("population"), (k != 7).alias("sampled"), cells.alias("cells"),
        F.when(k == 5, listing.COMPLETE).when(k == 6, "whole").otherwise(listing.SAMPLED).alias("depth_class"), F.when(k == 8, "suppressed").when(k == 9, "open").otherwise("checked").alias("state"),
    )
    return listing.check_census(reports, m, _plan(spark, sf))


_ENTRIES = f"""(SELECT l_orderkey AS member, l_linenumber - 1 AS i, (CASE WHEN l_linenumber = 5 THEN -1 ELSE (l_linenumber - 1) * 1000 + CASE WHEN l_orderkey % 9 = 0 AND l_linenumber = 3 THEN -960 ELSE 0 END END)::BIGINT AS "offset", (l_quantity * 20)::BIGINT AS compressed, (l_quantity * 40)::BIGINT AS size, 6500::BIGINT AS cd_offset FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity))"""


@query(f"""WITH e AS (SELECT *, "offset" >= 0 AND "offset" <= cd_offset - 30 AS ins, sum(size) OVER (PARTITION BY member ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM {_ENTRIES}),
b AS (SELECT *, coalesce(lead("offset") OVER w, cd_offset) - "offset" AS room FROM e WINDOW w AS (PARTITION BY member, ins ORDER BY "offset", i)),
c AS (SELECT *, compressed > greatest(0, room - 30) OR room < 30 AS short FROM b)
SELECT member, i, i < 6 AND s <= 4000 AS selected, ins AND NOT short AND NOT coalesce(lag(short) OVER (PARTITION BY member, ins ORDER BY "offset", i), false) AS valid FROM c""")
def zip_plans(spark, sf):
    """Archive entries that may be opened."""
    i, k = F.col("l_linenumber") - 1, F.col("l_orderkey")
    first = F.min_by(F.col("l_quantity"), F.struct("l_partkey", "l_suppkey", "l_quantity"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first.alias("q"))
    off = F.when(F.col("l_linenumber") == 5, -1).otherwise(i * 1000 + F.when((k % 9 == 0) & (F.col("l_linenumber") == 3), -960).otherwise(0)).cast("bigint")
    e = lines.select(k.alias("member"), i.alias("i"), off.alias("offset"), (F.col("q") * 20).cast("bigint").alias("compressed"), (F.col("q") * 40).cast("bigint").alias("size"), F.lit(6500).cast("bigint").alias("cd_offset"))
    return listing.zip_plan(e, max_entries=6, allowance=4000).select("member", "i", "selected", "valid")


# Inventory -----------------------------------------------------------------


@query(f"""SELECT coalesce(c.file_id, p.file_id) AS file_id, CASE WHEN p.file_id IS NULL THEN 'added' WHEN c.file_id IS NULL THEN 'removed' WHEN c.size = p.size AND c.mtime = p.mtime THEN 'same' ELSE 'changed' END AS status FROM {CUR} c FULL JOIN {PREV} p ON c.file_id = p.file_id""")
def inventory_diff(spark, sf):
    """Added, removed, changed and same files."""
    return inventory.diff_inventory(V.cur(spark, sf), V.prev(spark, sf))


@query(f"""SELECT coalesce(c.file_id, p.file_id) AS file_id, coalesce(c.size, p.size) AS size, coalesce(c.mtime, p.mtime) AS mtime, CASE WHEN c.file_id IS NOT NULL AND NOT coalesce(c.size = p.size AND c.mtime = p.mtime, false) THEN c.sha256 ELSE p.sha256 END AS sha256,
 coalesce(p.first_seen_at, TIMESTAMP '2024-03-01') AS first_seen_at, CASE WHEN c.file_id IS NOT NULL AND NOT coalesce(c.size = p.size AND c.mtime = p.mtime, false) THEN TIMESTAMP '2024-03-01' ELSE p.changed_at END AS changed_at, c.file_id IS NOT NULL AS present
FROM {CUR} c FULL JOIN (SELECT * FROM {PREV} WHERE present) p ON c.file_id = p.file_id""")
def inventory_next(spark, sf):
    """L1: the next inventory."""
    return inventory.inventory_update(V.cur(spark, sf), V.prev(spark, sf), F.lit("2024-03-01").cast("timestamp"))


@query(f"SELECT file_id, size FROM {PREV} p WHERE present AND NOT EXISTS (FROM {CUR} c WHERE c.file_id = p.file_id)")
def tombstones(spark, sf):
    """Files that went."""
    return inventory.tombstones(V.cur(spark, sf), V.prev(spark, sf)).select("file_id", "size")


@query(f"SELECT file_id, (row_number() OVER (ORDER BY file_id) - 1) // 100 AS batch FROM {CUR}")
def inventory_batches(spark, sf):
    """Batches in order of id."""
    return inventory.batches(V.cur(spark, sf), "file_id", 100).select("file_id", "batch")


@query("SELECT o_orderkey, NULL::VARCHAR AS refusal FROM orders WHERE (SELECT count(*) FROM orders) <= 10000 UNION ALL SELECT NULL, 'too_large' WHERE (SELECT count(*) FROM orders) > 10000")
def capped_rows(spark, sf):
    """O3: a cap that refuses and never cuts."""
    return inventory.enforce_cap(table(spark, sf, "orders").select("o_orderkey"), 10_000, "too_large")


_OBSERVED = f"(SELECT identity, CASE WHEN doc_id % 13 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha256 END AS sha256, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE etag END AS etag FROM {MEMBERS} WHERE doc_id % 11 <> 0)"


@query(f"""SELECT coalesce(a.identity, b.identity) AS identity, CASE WHEN b.identity IS NULL THEN 'missing' WHEN a.identity IS NULL THEN 'unexpected' WHEN a.size IS DISTINCT FROM b.size THEN 'size_changed' WHEN a.etag IS DISTINCT FROM b.etag THEN 'etag_changed' WHEN a.sha256 IS DISTINCT FROM b.sha256 THEN 'sha256_changed' ELSE 'same' END AS status
FROM (SELECT * FROM {MEMBERS} WHERE doc_id % 9 <> 0) a FULL JOIN {_OBSERVED} b ON a.identity = b.identity""")
def member_drift(spark, sf):
    """Pinned against observed members."""
    d, m = F.col("doc_id"), V.members(spark, sf)
    seen = m.where(d % 11 != 0).select("identity", F.when(d % 13 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(d % 7 == 0, "x").otherwise(F.col("sha256")).alias("sha256"), F.when(d % 5 != 0, F.col("etag")).alias("etag"))
    return inventory.drift(m.where(d % 9 != 0), seen)


@query("SELECT doc_id, b AS block, sha256(encode(text)[b * 2048 + 1 : (b + 1) * 2048]) AS digest FROM (SELECT doc_id, text, unnest(range(0, (strlen(text) + 2047) // 2048)) AS b FROM documents WHERE text IS NOT NULL)")
def block_digests(spark, sf):
    """S3: digests of every block."""
    return inventory.block_digests(table(spark, sf, "documents"), F.col("text").cast("binary"), 2048, "doc_id")


@query(f"SELECT doc_id, sha256 AS content_sha256 FROM {MEMBERS} m WHERE NOT EXISTS (FROM {PREV} p WHERE p.file_id = sha256('f' || m.doc_id) AND p.size = m.size)")
def files_to_hash(spark, sf):
    """Only files that are new or of another size are read."""
    m = V.members(spark, sf).withColumn("file_id", F.sha2(F.concat(F.lit("f"), F.col("doc_id").cast("string")).cast("binary"), 256)).withColumn("mtime", F.col("doc_id") % 5)
    return inventory.to_hash(m, V.prev(spark, sf)).select("doc_id", F.col("sha256").alias("content_sha256"))


# Intervals -----------------------------------------------------------------


@query(f"SELECT * FROM {SERVES}")
def serve_counts(spark, sf):
    """Serve counts per byte range."""
    return V.serves(spark, sf)


@query(f"SELECT * FROM {ISLANDS}")
def coverage_islands(spark, sf):
    """Transmitted islands."""
    return V.islands(spark, sf)


@query(f"""SELECT oid, fid, size, least(size, coalesce("end" + 1, 0)) AS "offset" FROM {SIZES} LEFT JOIN (SELECT * FROM {ISLANDS} WHERE start <= 0) USING (oid, fid)""")
def resume_offsets(spark, sf):
    """First byte not transmitted."""
    return I.resume_offset(V.islands(spark, sf), V.sizes(spark, sf), KEYS)


@query(f"""WITH f AS (SELECT * FROM {SERVES} WHERE count = 2) SELECT oid, fid, (sum(n) - sum(done))::BIGINT AS unwritten FROM (SELECT f.oid, f.fid, f."end" - f.start + 1 AS n, coalesce((SELECT sum(greatest(0, least(f."end", i."end") - greatest(f.start, i.start) + 1)) FROM {ISLANDS} i WHERE i.oid = f.oid AND i.fid = f.fid), 0) AS done FROM f) GROUP BY 1, 2""")
def unwritten_exhausted(spark, sf):
    """Bytes at the serve limit that were not written."""
    return I.unwritten_exhausted(V.serves(spark, sf), V.islands(spark, sf), KEYS)


@query(f"""SELECT r.id, min(CASE WHEN s.start IS NOT NULL THEN greatest(r.start, s.start) END) AS exhausted, CASE WHEN min(s.start) IS NULL THEN any_value(r."end") WHEN min(greatest(r.start, s.start)) > any_value(r.start) THEN min(greatest(r.start, s.start)) - 1 END AS granted_end
FROM {REQUESTS} r LEFT JOIN (SELECT * FROM {SERVES} WHERE count >= 2) s ON r.oid = s.oid AND r.fid = s.fid AND r.start <= s."end" AND s.start <= r."end" GROUP BY r.id""")
def truncated_requests(spark, sf):
    """Requests cut before their first exhausted byte."""
    return I.truncate_requests(V.requests(spark, sf), V.serves(spark, sf), KEYS).select("id", "exhausted", "granted_end")


@query(f"""SELECT id FROM {REQUESTS} r WHERE EXISTS (FROM {ISLANDS} i WHERE i.oid = r.oid AND i.fid = r.fid AND i.start <= r.start AND i."end" >= r."end")""")
def contained_requests(spark, sf):
    """Requests within one transmitted island."""
    return I.contained(V.requests(spark, sf), V.islands(spark, sf), KEYS).select("id")


_STATS = f"""(SELECT oid, fid, coalesce(n, 0) AS intervals, coalesce(b, 0)::BIGINT AS bytes, coalesce(m, 0) AS max_serve_count FROM (SELECT oid, fid, count(*) AS n, sum("end" - start + 1) AS b FROM {ISLANDS} GROUP BY ALL) FULL JOIN (SELECT oid, fid, max(count) AS m FROM {SERVES} GROUP BY ALL) USING (oid, fid))"""


@query(f"SELECT * FROM {_STATS}")
def interval_stats(spark, sf):
    """Intervals, bytes and serve counts."""
    return I.interval_stats(V.serves(spark, sf), V.islands(spark, sf), KEYS)


_SETTLE = f"""(SELECT *, start + 6 AS written_through, id % 4 = 0 AS crashed FROM {REQUESTS})"""


@query(f"""SELECT id, kept_through, greatest(start, kept_through + 1) AS returned_from, greatest(0, "end" - greatest(start, kept_through + 1) + 1) AS returned_bytes FROM (SELECT *, CASE WHEN crashed THEN least("end", written_through + 16) ELSE written_through END AS kept_through FROM {_SETTLE})""")
def settlements(spark, sf):
    """L4: what settled requests give back."""
    r = V.requests(spark, sf).withColumn("written_through", F.col("start") + 6).withColumn("crashed", F.col("id") % 4 == 0)
    return I.settle(r, window=16).select("id", "kept_through", "returned_from", "returned_bytes")


@query(f"""SELECT DISTINCT oid, fid FROM {SIZES} s WHERE size = 0 OR EXISTS (FROM {ISLANDS} i WHERE i.oid = s.oid AND i.fid = s.fid AND i.start = 0 AND i."end" >= s.size - 1)""")
def completions(spark, sf):
    """Complete files."""
    return I.completions(V.islands(spark, sf), V.sizes(spark, sf), KEYS)


@query(f"""SELECT oid, fid, coalesce(n, 0) AS intervals, coalesce(o, 0) AS open_requests, coalesce(n, 0) + coalesce(o, 0) + 1 > 12 AS refused FROM (SELECT oid, fid, count(*) AS n FROM {ISLANDS} GROUP BY ALL) FULL JOIN (SELECT oid, fid, count(*) AS o FROM {REQUESTS} WHERE id % 3 = 0 GROUP BY ALL) USING (oid, fid)""")
def fragmented_files(spark, sf):
    """The fragment cap."""
    return I.fragmented(V.islands(spark, sf), V.requests(spark, sf).where("id % 3 = 0"), KEYS, cap=12)


@query(f"""WITH f AS (SELECT * FROM {SERVES} WHERE count = 2), u AS (SELECT oid, fid, (sum(n) - sum(done))::BIGINT AS unwritten FROM (SELECT f.oid, f.fid, f."end" - f.start + 1 AS n, coalesce((SELECT sum(greatest(0, least(f."end", i."end") - greatest(f.start, i.start) + 1)) FROM {ISLANDS} i WHERE i.oid = f.oid AND i.fid = f.fid), 0) AS done FROM f) GROUP BY 1, 2),
i AS (SELECT oid, fid, sum("end" - start + 1)::BIGINT AS b, list([start, "end"] ORDER BY start) AS t FROM {ISLANDS} GROUP BY 1, 2),
p AS (SELECT oid, fid, list(DISTINCT jti ORDER BY jti) AS jtis, min(bound_at) AS first_at, max(closed_at) AS last_at FROM {PERMISSIONS} GROUP BY 1, 2)
SELECT oid, fid, size, coalesce(b, 0) AS transmitted_bytes, t AS transmitted, coalesce(unwritten, 0) AS exhausted_bytes, jtis, first_at, last_at, CASE WHEN coalesce(b, 0) = size THEN 'complete' ELSE 'in_progress' END AS outcome FROM {SIZES} LEFT JOIN p USING (oid, fid) LEFT JOIN i USING (oid, fid) LEFT JOIN u USING (oid, fid)""")
def receipts(spark, sf):
    """Receipts per order and file."""
    return ledger.receipts(V.permissions(spark, sf), V.serves(spark, sf), V.islands(spark, sf), V.sizes(spark, sf))
