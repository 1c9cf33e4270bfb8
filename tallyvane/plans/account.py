"""Registered queries over accounts: joins of the ledger, quotas, chains, queues, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.functions import values
from tallyvane.operators import ledger, validation
from tallyvane.operators import profile as P
from tallyvane.sources import text as T

from . import views as V
from .deliver import ID_KEY, _hmac, _Z
from .registry import query, table
from .views import ISLANDS, KEYS, MEMBERS, PERMISSIONS, REQUESTS, SERVES

FILES = "(SELECT DISTINCT event_type AS fid, sha256(event_type) AS sha256, (length(event_type) * 100)::BIGINT AS size, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS changed, 'src/' || event_type || '.csv' AS path FROM events)"
OFFERS = """(SELECT o_orderkey AS seq, o_custkey % 50 AS fid, o_orderkey % 7 AS iid, CASE o_orderstatus WHEN 'O' THEN 'offered' WHEN 'F' THEN 'withdrawn' ELSE 'pending' END AS state, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS approved_at, CASE WHEN o_orderkey % 3 = 0 THEN 'archive' ELSE 'listing' END AS key_class FROM orders)"""


def files(spark, sf):
    e = F.col("fid")
    return V.requests(spark, sf).select("fid").distinct().select(
        "fid", F.sha2(e.cast("binary"), 256).alias("sha256"), (F.length(e) * 100).cast("bigint").alias("size"),
        F.when(e == "click", 1).when(e == "view", 2).otherwise(0).alias("changed"), F.concat(F.lit("src/"), e, F.lit(".csv")).alias("path"),
    )


def offers(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("seq"), (F.col("o_custkey") % 50).alias("fid"), (k % 7).alias("iid"),
        F.when(F.col("o_orderstatus") == "O", "offered").when(F.col("o_orderstatus") == "F", "withdrawn").otherwise("pending").alias("state"),
        F.when(k % 5 == 0, F.col("o_orderdate")).alias("approved_at"), F.when(k % 3 == 0, "archive").otherwise("listing").alias("key_class"),
    )


def _jti(df):
    return df.withColumn("jti", F.concat_ws("-", F.col("oid").cast("string"), "fid", (F.col("id") % 3).cast("string")))


_R_JTI = f"(SELECT *, oid || '-' || fid || '-' || id % 3 AS jti FROM {REQUESTS})"


@query(f"""SELECT r.id, p.state, p.td, f.size, r."end" < f.size AS within FROM {_R_JTI} r JOIN {PERMISSIONS} p ON p.jti = r.jti JOIN {FILES} f ON f.fid = r.fid""")
def requests_with_files(spark, sf):
    """Requests with their permissions and files."""
    told = ledger.requests_with_permission(_jti(V.requests(spark, sf)), V.permissions(spark, sf))
    return ledger.requests_with_file(told, files(spark, sf)).select("id", "state", "td", "size", "within")


@query(f"""SELECT o.fid, count(*) AS pending FROM {OFFERS} o JOIN (SELECT DISTINCT doc_id AS fid FROM documents) f USING (fid) WHERE state = 'offered' AND approved_at IS NULL GROUP BY 1""")
def pending_approvals(spark, sf):
    """Offers that wait for local approval."""
    return ledger.pending_approvals(offers(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("fid")))


_INSTR = "(SELECT event_id AS seq, (event_id * 7919) % 4000 AS iid, event_type || value::INTEGER AS answer FROM events)"


def _instructions(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(e.alias("seq"), (e * 7919 % 4000).alias("iid"), F.concat("event_type", F.rint("value").cast("int").cast("string")).alias("answer"))


@query(f"SELECT iid, min(seq) AS seq FROM {_INSTR} WHERE iid NOT IN (SELECT event_id % 4000 FROM events WHERE event_id % 4000 % 3 = 0) GROUP BY 1")
def unseen_instructions(spark, sf):
    """Instructions not seen before, once each."""
    seen = table(spark, sf, "events").select((F.col("event_id") % 4000).alias("iid")).where("iid % 3 = 0")
    return ledger.unseen(_instructions(spark, sf), seen).select("iid", "seq")


@query(f"SELECT iid, arg_min(answer, seq) AS answer, count(*) - 1 AS repeats FROM {_INSTR} GROUP BY 1")
def first_answers(spark, sf):
    """Repeated instructions get the first answer."""
    return ledger.first_answer(_instructions(spark, sf))


@query("SELECT event_id AS seq FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_id % 10 = 3 AND event_id < 9000)")
def unaudited_rows(spark, sf):
    """Outbox rows beyond the audited high water."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"))
    return ledger.unaudited(e, e.where("seq % 10 = 3 and seq < 9000"))


@query("SELECT event_id AS seq, event_id % 4 <> 0 AND event_id + 5 <= 5000 AS delivered FROM events")
def delivered_marks(spark, sf):
    """Rows whose audit was acknowledged."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"))
    return ledger.mark_delivered(e, e.where("seq % 4 <> 0").select("seq", (F.col("seq") + 5).alias("audit_seq")), 5000)


_OLD = "(SELECT event_id, user_id, ts FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY)"


@query(f"SELECT event_id FROM {_OLD} WHERE user_id % 4 <> 0")
def orphan_rows(spark, sf):
    """Old rows without a live parent."""
    e = table(spark, sf, "events")
    at = e.agg(F.max("ts")).scalar()
    return ledger.orphans(e.withColumn("at", at), e.where("user_id % 4 = 0"), "user_id", F.col("at"), "ts", 10).select("event_id")


@query(f"SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM {_OLD} WHERE user_id % 4 <> 0)")
def retained_rows(spark, sf):
    """Rows that are young or have a live parent."""
    e = table(spark, sf, "events")
    e = e.withColumn("at", e.agg(F.max("ts")).scalar())
    return ledger.retained(e, e.where("user_id % 4 = 0"), "user_id", F.col("at"), "ts", 10).select("event_id")


@query(f"""SELECT m.doc_id FROM {MEMBERS} m JOIN (SELECT DISTINCT doc_id FROM labels) f USING (doc_id) WHERE EXISTS (FROM {OFFERS} o WHERE o.fid = m.doc_id % 50 AND o.state = 'offered' AND o.key_class = 'listing') AND NOT EXISTS (FROM {OFFERS} o WHERE o.fid = m.doc_id % 50 AND o.state = 'withdrawn' AND o.seq > 59000)""")
def eligible_members(spark, sf):
    """Snapshot members with a live file and offer that nothing supersedes."""
    from tallyvane.operators.listing import eligible_members

    m = V.members(spark, sf).select("doc_id", F.col("doc_id").alias("member_id"), (F.col("doc_id") % 50).alias("fid"))
    o = offers(spark, sf)
    return eligible_members(m, table(spark, sf, "labels").select(F.col("doc_id").alias("member_id")), o, o.where("state = 'withdrawn' and seq > 59000")).select("doc_id")


_OBJECT = _hmac(ID_KEY, f"encode('object') || {_Z} || encode('gateway_listing') || {_Z} || encode('gw') || {_Z} || encode(identity) || {_Z} || encode(sha256)")


@query(f"""SELECT m.doc_id, {_OBJECT} AS object_id FROM {MEMBERS} m JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)""")
def resolved_objects(spark, sf):
    """Objects of a report (the labelled documents'), found again by recomputed ids."""
    from tallyvane.functions import ids
    from tallyvane.operators.listing import resolve_objects

    m = V.members(spark, sf)
    labelled = m.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    reported = labelled.select(ids.object_id(ID_KEY, "gateway_listing", "gw", F.col("identity"), F.col("sha256")).alias("object_id"))
    return resolve_objects(reported, m, ID_KEY, "gateway_listing", "gw").select("doc_id", "object_id")


@query(f"SELECT * FROM {OFFERS} QUALIFY row_number() OVER (PARTITION BY fid ORDER BY seq DESC) = 1")
def latest_offers(spark, sf):
    """Latest state per key, as a fold."""
    return ledger.latest_state(offers(spark, sf), ["fid"], ["seq"])


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_events(spark, sf):
    """Latest row per key, as a window."""
    return ledger.latest_by(table(spark, sf, "events").select("user_id", "event_id", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) <= 10 AS admitted FROM events")
def quota_admissions(spark, sf):
    """The first ten rows per listing and day."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return ledger.admit_quota(e, ["event_type", "day"], ["ts", "event_id"]).select("event_id", "admitted")


@query("SELECT event_type, ts::DATE AS day, least(count(*), 10) AS accepted FROM events GROUP BY ALL")
def daily_quota_counts(spark, sf):
    """Daily counters."""
    return ledger.daily_counts(table(spark, sf, "events"), "event_type", "ts")


@query("""SELECT event_id, high, coalesce(s < high - 86400, false) AS late FROM (SELECT event_id, s, max(s) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM (SELECT event_id, event_type, floor(epoch(ts))::BIGINT - (event_id * 7919) % 100000 AS s FROM events))""")
def clock_high_water(spark, sf):
    """Rows too far behind the running maximum."""
    e = table(spark, sf, "events").select("event_id", "event_type", (F.unix_seconds(F.col("ts").cast("timestamp")) - F.col("event_id") * 7919 % 100_000).alias("s"))
    return ledger.clock_high_water(e, "event_type", "event_id", "s", skew=86_400).select("event_id", "high", "late")


@query("""SELECT event_id, a <= i AND i < x AND x - i <= 86400 AND i <= t + 300 AND i >= t - 86700 AND a >= t - 86700 AND x >= t - 300 AS ok FROM (SELECT event_id, floor(epoch(ts))::BIGINT AS t, floor(epoch(ts))::BIGINT - (event_id * 31) % 90000 AS i, floor(epoch(ts))::BIGINT - (event_id * 31) % 90000 - event_id % 3 AS a, floor(epoch(ts))::BIGINT - (event_id * 31) % 90000 + (event_id % 5) * 21700 AS x FROM events)""")
def consent_checks(spark, sf):
    """Consent windows."""
    e, t = F.col("event_id"), F.unix_seconds(F.col("ts").cast("timestamp"))
    i = t - e * 31 % 90_000
    return table(spark, sf, "events").select("event_id", ledger.consent_ok(i, i - e % 3, i + e % 5 * 21_700, t).alias("ok"))


@query(f"""WITH a AS (SELECT min(sd) + 10 * 86400 AS now FROM {PERMISSIONS}) SELECT jti, CASE WHEN oid % 5 = 0 OR state = 'revoked' THEN 'revoked' WHEN state = 'closed' THEN 'closed' WHEN td <= now THEN 'expired' WHEN state <> 'bound' AND sd <= now THEN 'late_start' ELSE state END AS effective FROM {PERMISSIONS}, a""")
def permission_states(spark, sf):
    """L2: permission states at a time."""
    p = V.permissions(spark, sf)
    at = p.agg(F.min("sd") + 10 * 86400).scalar()
    return ledger.permission_state(p, p.where("oid % 5 = 0").select("jti"), at).select("jti", "effective")


@query(f"""SELECT seq, CASE WHEN lag(iid) OVER w = iid OR state = 'withdrawn' THEN lag(approved_at) OVER w END AS kept_approval FROM {OFFERS} WINDOW w AS (PARTITION BY fid ORDER BY seq)""")
def offer_approvals(spark, sf):
    """Local approvals that an upsert keeps."""
    return ledger.offer_approval(offers(spark, sf), ["fid"], "seq").select("seq", "kept_approval")


_ORDERS = "(SELECT DISTINCT user_id AS oid, event_type AS fid, CASE WHEN user_id % 13 = 0 THEN 'stale' ELSE sha256(event_type) END AS sha256 FROM events UNION ALL SELECT 0, 'absent', 'x')"
_F_OFFERS = "(SELECT DISTINCT event_type AS fid, sha256(event_type) AS sha256, 'offered' AS state, CASE WHEN event_type = 'signup' THEN 'archive' ELSE 'listing' END AS key_class, CASE WHEN event_type <> 'error' THEN 1 END AS approved_at FROM events)"


@query(f"""WITH fu AS (SELECT s.oid, s.fid, bool_or(NOT EXISTS (FROM {ISLANDS} i WHERE i.oid = s.oid AND i.fid = s.fid AND i.start <= s.start AND i."end" >= s."end")) AS ex FROM {SERVES} s WHERE count = 2 GROUP BY 1, 2),
st AS (SELECT oid, fid, count(*) AS n, sum("end" - start + 1)::BIGINT AS b, max("end") FILTER (start <= 0) AS e0 FROM {ISLANDS} GROUP BY 1, 2), mx AS (SELECT oid, fid, max(count)::BIGINT AS m FROM {SERVES} GROUP BY 1, 2)
SELECT o.oid, o.fid, CASE WHEN f.fid IS NULL OR f.changed = 2 THEN 'file_missing' WHEN f.changed = 1 OR f.sha256 <> o.sha256 THEN 'file_changed' WHEN NOT regexp_full_match(f.path, 'src/[^/]*\\.csv') THEN 'outside_ceiling'
 WHEN q.fid IS NULL THEN 'not_offered' WHEN q.approved_at IS NULL THEN 'awaiting_local_approval' WHEN coalesce(fu.ex, false) THEN 'coverage_exhausted' WHEN f.size = 0 OR coalesce(b, 0) = f.size THEN 'complete' END AS refusal,
 coalesce(least(f.size, coalesce(e0 + 1, 0)), 0) AS "offset", coalesce(b, 0) AS bytes, coalesce(n, 0) AS intervals, coalesce(m, 0) AS max_serve_count
FROM {_ORDERS} o LEFT JOIN {FILES} f ON f.fid = o.fid LEFT JOIN (SELECT * FROM {_F_OFFERS} WHERE key_class = 'listing') q ON q.fid = o.fid AND q.sha256 = o.sha256 LEFT JOIN fu ON fu.oid = o.oid AND fu.fid = o.fid LEFT JOIN st ON st.oid = o.oid AND st.fid = o.fid LEFT JOIN mx ON mx.oid = o.oid AND mx.fid = o.fid""")
def readiness(spark, sf):
    """Why an order is not ready, by precedence."""
    sha = F.sha2(F.col("fid").cast("binary"), 256)
    o = V.requests(spark, sf).select("oid", "fid").distinct().select("oid", "fid", F.when(F.col("oid") % 13 == 0, "stale").otherwise(sha).alias("sha256"))
    o = o.unionAll(spark.range(1).select(F.lit(0).cast("bigint"), F.lit("absent"), F.lit("x")))
    q = files(spark, sf).select("fid", "sha256", F.lit("offered").alias("state"), F.when(F.col("fid") == "signup", "archive").otherwise("listing").alias("key_class"), F.when(F.col("fid") != "error", 1).alias("approved_at"))
    return ledger.readiness(o, files(spark, sf), q, V.serves(spark, sf), V.islands(spark, sf), ["src/*.csv"], approval=True)


_LINE = "'{\"seq\":' || seq || ',\"type\":\"' || event_type || '\"}'"
_LOG = f"(SELECT event_id AS seq, (event_id // 500)::VARCHAR AS part, {_LINE.replace('seq ||', 'event_id ||', 1)} AS line, CASE WHEN event_id % 997 = 5 THEN 'bad' ELSE coalesce((SELECT NULL), lag(sha256({_LINE.replace('seq ||', 'event_id ||', 1)})) OVER (ORDER BY event_id), '') END AS prev FROM events WHERE event_id % 1501 <> 7)"


def _log(spark, sf):
    line = F.concat(F.lit('{"seq":'), F.col("event_id").cast("string"), F.lit(',"type":"'), "event_type", F.lit('"}'))
    e = table(spark, sf, "events").where("event_id % 1501 <> 7").select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 500).cast("string").alias("part"), line.alias("line"))
    prev = F.when(F.col("seq") % 997 == 5, "bad").otherwise(F.coalesce("before", F.lit("")))
    return ledger.chained(e, "seq", "line", "part").select("seq", "part", "line", prev.alias("prev"))


@query(f"""SELECT part, seq, seq_broken, hash_broken FROM (SELECT part, seq, coalesce(seq <> lag(seq) OVER w + 1, false) AS seq_broken, coalesce(prev <> lag(sha256(line)) OVER w, false) AS hash_broken FROM {_LOG} WINDOW w AS (ORDER BY seq)) WHERE seq_broken OR hash_broken""")
def chain_breaks(spark, sf):
    """Breaks of a hash chain."""
    return ledger.check_chain(_log(spark, sf), "seq", "line", "prev", "part")


_EVENT = """(SELECT event_id, event_id // 500 AS part, concat(CASE WHEN event_id % 211 = 5 THEN '{ ' ELSE '{' END, CASE WHEN event_id % 307 = 9 THEN '"a":"' || event_type || '",' ELSE '' END, '"event_id":',
 CASE event_id % 401 WHEN 3 THEN event_id - 2 WHEN 7 THEN event_id + 5 ELSE event_id END, CASE WHEN event_id % 503 = 11 THEN '.5' ELSE '' END, ',"note":"', CASE WHEN event_id % 9 = 0 THEN '<b>' WHEN event_id % 3 = 0 THEN '\\u003cb\\u003e' ELSE 'é' END, '","prev_hash":"') AS head,
 concat('","refusal_code":"","result":"ok","sig":"', event_id, '","spec":"s', CASE WHEN event_id % 601 = 4 THEN '"}' ELSE '","time":"t"}' END) AS tail, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS n FROM events)"""


def _events(spark, sf):
    """Local event logs of five hundred lines, each with the digest of the one before, and every kind of break."""
    i = F.col("event_id")
    if_ = lambda condition, yes, no="": F.when(condition, yes).otherwise(no)
    note = F.when(i % 9 == 0, "<b>").when(i % 3 == 0, "\\u003cb\\u003e").otherwise("é")
    number = F.when(i % 401 == 3, i - 2).when(i % 401 == 7, i + 5).otherwise(i).cast("string")
    head = F.concat(if_(i % 211 == 5, "{ ", "{"), if_(i % 307 == 9, F.concat(F.lit('"a":"'), "event_type", F.lit('",'))), F.lit('"event_id":'), number, if_(i % 503 == 11, ".5"), F.lit(',"note":"'), note, F.lit('","prev_hash":"'))
    tail = F.concat(F.lit('","refusal_code":"","result":"ok","sig":"'), i.cast("string"), F.lit('","spec":"s'), if_(i % 601 == 4, '"}', '","time":"t"}'))
    bare = table(spark, sf, "events").select(F.floor(i / 500).alias("part"), F.struct("event_id", head.alias("head"), tail.alias("tail")).alias("e"))

    def append(made, e):
        line = F.concat(e["head"], F.when(e["event_id"] % 701 == 6, "x").otherwise(made["before"]), e["tail"])
        return F.struct(F.sha2(line, 256).alias("before"), F.concat(made["lines"], F.array(F.struct(e["event_id"].alias("pos"), line.alias("line")))).alias("lines"))

    none = F.struct(F.lit("").alias("before"), F.array().cast("array<struct<pos:bigint,line:string>>").alias("lines"))
    return bare.groupBy("part").agg(F.array_sort(F.collect_list("e")).alias("all")).select("part", F.inline(F.aggregate("all", none, append)["lines"]))


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_EVENT}), l AS (SELECT part, n, event_id AS pos, head || CASE WHEN event_id % 701 = 6 THEN 'x' ELSE '' END || tail AS line FROM e WHERE n = 1
 UNION ALL SELECT e.part, e.n, e.event_id, e.head || CASE WHEN e.event_id % 701 = 6 THEN 'x' ELSE sha256(l.line) END || e.tail FROM l JOIN e ON e.part = l.part AND e.n = l.n + 1),
k AS (SELECT part, pos, line, json_extract_string(line, '$.event_id') AS raw FROM l), w AS (SELECT *, lag(raw) OVER o AS raw_before, lag(sha256(line)) OVER o AS digest FROM k WINDOW o AS (ORDER BY pos)),
f AS (SELECT part, pos, starts_with(line, '{{ ') OR contains(line, '<b>') AS not_canonical, len(json_keys(line)) <> 8 AS fields_wrong, json_extract_string(line, '$.prev_hash') <> coalesce(digest, '') AS hash_broken,
 contains(raw, '.') OR coalesce(NOT contains(raw_before, '.') AND TRY_CAST(raw AS BIGINT) <= TRY_CAST(raw_before AS BIGINT), false) AS id_broken FROM w)
SELECT * FROM f WHERE not_canonical OR fields_wrong OR id_broken OR hash_broken""")
def event_chain_breaks(spark, sf):
    """Lines of local event logs that break their rules; every log but the first begins with a broken hash."""
    return ledger.check_event_chain(_events(spark, sf), "line", "pos", "part")


@query(f"""WITH l AS (SELECT * FROM {_LOG}), a AS (SELECT part, max(seq) - 100 AS s FROM l GROUP BY 1), k AS (SELECT a.part, a.s, l.line IS NOT NULL AND a.part <> '3' AS agrees FROM a LEFT JOIN l ON l.part = a.part AND l.seq = a.s)
SELECT l.part, l.seq, 'replay' AS action FROM l JOIN k USING (part) WHERE agrees AND l.seq > k.s UNION ALL SELECT part, s, 'divergence' FROM k WHERE NOT agrees""")
def replay_sets(spark, sf):
    """Entries to replay after the server's position, or divergence."""
    log = _log(spark, sf)
    at = log.groupBy("part").agg((F.max("seq") - 100).alias("seq"))
    own = log.select("part", "seq", F.sha2("line", 256).alias("h"))
    known = at.join(own, ["part", "seq"], "left").select("part", "seq", F.when(F.col("part") == "3", "other").otherwise(F.coalesce("h", F.lit("gone"))).alias("hash"))
    return ledger.replay_from(log, known)


@query(f"SELECT listing_id, pos, identity FROM (SELECT *, lag(identity) OVER (PARTITION BY listing_id ORDER BY pos) AS b FROM (SELECT listing_id, doc_id AS pos, substr(identity, 1, 1) AS identity FROM {MEMBERS})) WHERE identity <= b")
def order_breaks(spark, sf):
    """Identities out of order."""
    m = V.members(spark, sf).select("listing_id", F.col("doc_id").alias("pos"), F.substring("identity", 1, 1).alias("identity"))
    return ledger.check_order(m, ["listing_id"], "identity")


@query(f"SELECT listing_id, identity, 'table' AS kind FROM {MEMBERS} WHERE format IN ('csv', 'tsv', 'jsonl', 'parquet') UNION ALL SELECT listing_id, identity, 'census' FROM {MEMBERS} WHERE format NOT IN ('csv', 'tsv', 'jsonl', 'parquet')")
def all_members(spark, sf):
    """Tables and census members together, in order of identity."""
    from tallyvane.operators import listing

    m, t = V.members(spark, sf), listing.is_table(F.col("format"))
    return listing.all_members(m.where(t), m.where(~t))


@query(f"SELECT listing_id, identity FROM {MEMBERS} WHERE doc_id % 2 <> 0")
def members_outside_plan(spark, sf):
    """Planned against all."""
    from tallyvane.operators.listing import outside_plan

    m = V.members(spark, sf)
    return outside_plan(m.select("listing_id", "identity"), m.where("doc_id % 2 = 0").select("listing_id", "identity"))


@query("SELECT kid FROM (SELECT DISTINCT c_nationkey AS kid FROM customer WHERE c_nationkey < 15 UNION SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey > 10)")
def merged_keys(spark, sf):
    """Union of key sets."""
    a = table(spark, sf, "customer").where("c_nationkey < 15").select(F.col("c_nationkey").alias("kid"))
    return ledger.merge_keys(a, table(spark, sf, "supplier").where("s_nationkey > 10").select(F.col("s_nationkey").alias("kid")))


_RECEIPT_ROWS = """(SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'nope' ELSE regexp_replace(md5(event_id::VARCHAR), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') END AS order_id, CASE WHEN event_id % 5 = 0 THEN 'F' || substr(md5(event_type), 2) ELSE md5(event_type) END AS file_id, CASE WHEN event_id % 7 <> 0 THEN sha256(event_type) END AS sha256,
 CASE event_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'lost' END AS outcome, event_id % 100 AS transmitted_bytes, 90 AS size FROM events)"""


@query(f"""SELECT event_id, unnest(list_filter([CASE WHEN order_id IS NULL THEN 'order_id_missing' WHEN NOT regexp_matches(order_id, '{validation.UUID}') THEN 'order_id_malformed' END, CASE WHEN NOT regexp_matches(file_id, '{validation.HEX32}') THEN 'file_id_malformed' END, CASE WHEN sha256 IS NULL THEN 'sha256_missing' END, CASE WHEN outcome IS NULL OR outcome <> 'complete' THEN 'outcome_unknown' END, CASE WHEN transmitted_bytes > size THEN 'bytes_over_size' END], lambda x: x IS NOT NULL)) AS violation FROM {_RECEIPT_ROWS}""")
def receipt_violations(spark, sf):
    """Rows that break the receipt's rules."""
    e, md = F.col("event_id"), F.md5(F.col("event_id").cast("string").cast("binary"))
    uuid = F.regexp_replace(md, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    fid = F.md5(F.col("event_type").cast("binary"))
    rows = table(spark, sf, "events").select(
        "event_id", F.when(e % 4 == 0, None).when(e % 4 == 1, "nope").otherwise(uuid).alias("order_id"), F.when(e % 5 == 0, F.concat(F.lit("F"), F.substring(fid, 2, 31))).otherwise(fid).alias("file_id"),
        F.when(e % 7 != 0, F.sha2(F.col("event_type").cast("binary"), 256)).alias("sha256"), F.when(e % 3 == 0, "complete").when(e % 3 == 1, "lost").alias("outcome"), (e % 100).alias("transmitted_bytes"), F.lit(90).alias("size"),
    )
    return validation.validate_rows(rows, "receipt", "event_id")


@query("SELECT event_id, event_type IN ('click', 'view') AND event_id % 4 < 2 AS ok FROM events")
def description_checks(spark, sf):
    """P20: descriptions against the closed vocabulary: a foreign value, unsorted tags and a further field fail."""
    k = F.col("event_id") % 4
    domain = F.when(F.col("event_type").isin("click", "view"), "business_finance").otherwise(F.col("event_type"))
    tags = F.when(k == 0, '["analysis_reporting","benchmarking"]').when(k == 2, '["machine_learning","benchmarking"]').otherwise("[]")
    more = F.when(k == 3, ',"more":1').otherwise("")
    rest = '","record_granularity":"event","temporal_scope":"time_series","update_cadence":"daily","known_limitation_tags":["missing_values"],"intended_use_tags":'
    text = F.concat(F.lit('{"domain_class":"'), domain, F.lit(rest), tags, more, F.lit("}"))
    return table(spark, sf, "events").select("event_id", validation.valid_description(text).alias("ok"))


@query("SELECT user_id, CASE WHEN bool_or(value > 99 OR event_id % 50 = 0 OR event_type = 'error') THEN 'open' ELSE 'closed' END AS state FROM events GROUP BY 1")
def egress_states(spark, sf):
    """Roll-up of egress checks."""
    o = lambda c: F.when(c, "open").otherwise("closed")
    r = table(spark, sf, "events").select("user_id", o(F.col("value") > 99).alias("dns"), o(F.col("event_id") % 50 == 0).alias("tcp"), o(F.col("event_type") == "error").alias("proxy"))
    return validation.egress_state(r, "user_id")


@query("SELECT event_type, window_start, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT event_type, event_id, time_bucket(INTERVAL 10 MINUTE, ts) AS window_start FROM events) GROUP BY ALL")
def delivery_windows(spark, sf):
    """Tumbling delivery metrics."""
    from tallyvane.streaming.deliveries import delivery_windows as windows

    return windows(table(spark, sf, "events"), "10 minutes")


@query("""WITH e AS (SELECT user_id, event_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n, sum(event_id)::BIGINT AS ids FROM s GROUP BY user_id, session""")
def delivery_sessions(spark, sf):
    """Sessions of users, six hours apart."""
    from tallyvane.streaming.deliveries import delivery_sessions as sessions

    return sessions(table(spark, sf, "events"), "user_id", "6 hours")


@query("""SELECT event_type, w AS window_start, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT event_type, event_id, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS w FROM events) GROUP BY ALL""")
def delivery_windows_sliding(spark, sf):
    """Sliding delivery metrics."""
    from tallyvane.streaming.deliveries import delivery_windows as windows

    return windows(table(spark, sf, "events"), "10 minutes", "5 minutes")


@query("SELECT key, min(event_id) AS first_pos, count(*) AS n FROM (SELECT event_id, unnest(json_keys(CASE WHEN event_id % 3 = 0 THEN props ELSE '{\"e' || event_id % 5 || '\":1,\"k\":2}' END)) AS key FROM events) GROUP BY 1")
def discovered_schema(spark, sf):
    """Keys of JSON rows by first appearance."""
    e = F.col("event_id")
    line = F.when(e % 3 == 0, F.col("props")).otherwise(F.concat(F.lit('{"e'), (e % 5).cast("string"), F.lit('":1,"k":2}')))
    return T.discover_schema(table(spark, sf, "events").select(e.alias("pos"), line.alias("line")), "line", "pos")


@query("""WITH l AS (SELECT event_id, props, sum(strlen(props) + 1) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS upto FROM events) SELECT count(*) AS n, max(event_id) AS last, 'integer' AS type FROM l WHERE upto <= 50000""")
def first_bytes_type(spark, sf):
    """Type by the records that end within the first bytes."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.octet_length("props").alias("size"), F.get_json_object("props", "$.k").alias("value"))
    head = T.within_first_bytes(e, "pos", "size", 50_000)
    return head.agg(F.count("*").alias("n"), F.max("pos").alias("last"), values.promoted(values.fact_type(F.col("value")), "unknown").alias("type"))


_PARTS = "SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1"


@query(_PARTS)
def flat_scan(spark, sf):
    """A flat table scan; nested tables are refused."""
    docs = table(spark, sf, "documents")
    if not P.is_flat(docs):
        raise ValueError("a nested table")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
