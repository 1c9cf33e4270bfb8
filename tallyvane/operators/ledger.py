"""Delivery accounting over event tables: permissions, offers, receipts, quotas, chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as I
from .scans import hot_keys, scan

QUOTA = 10
SKEW = 300
CONSENT = 86_400
#: Fixed value: the fields of a local event.
FIELDS = 8


def latest_state(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by the order columns, as a fold (no sort, map-side combined)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("row")).select(*keys, "row.*")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by the order columns, as a window: row number 1 from the end."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def admit_quota(df: DataFrame, keys: list[str], order: list[str], limit: int = QUOTA) -> DataFrame:
    """df with `admitted`: the first `limit` rows per key in order, which tells all rows of a key apart.

    Only the least `limit` orders of a key are ranked, in every task and then per key; all
    other rows are compared with the last of them.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = df.select(*keys, *order).withColumn("_rank", rank).where(F.col("_rank") <= limit)
    last = first.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(F.struct(*order)).alias("_last"))
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(last[f"_{k}"]) for k in keys])
    return df.join(last, same).select(*[df[c] for c in df.columns], (F.struct(*[df[c] for c in order]) <= last["_last"]).alias("admitted"))


def daily_counts(df: DataFrame, key: str, ts: str, limit: int = QUOTA) -> DataFrame:
    """(key, day, accepted): accepted rows per key and UTC day, at most the limit."""
    return df.groupBy(key, F.to_date(ts).alias("day")).agg(F.least(F.count("*"), F.lit(limit)).alias("accepted"))


def clock_high_water(df: DataFrame, key: str, order: str, seconds: str, skew: int = SKEW) -> DataFrame:
    """df with `high` (largest second before the row, in order) and `late` (over `skew` behind it)."""
    found = scan(df, [key], [order], hot_keys(df, [key]), high=("max_before", F.col(seconds)))
    return found.withColumn("late", F.coalesce(F.col(seconds) < F.col("high") - skew, F.lit(False)))


def requests_with_permission(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """requests (jti, ...) with the state and deadline of their permission (jti, state, td); those without one are left out."""
    return requests.join(permissions.select("jti", "state", "td"), "jti")


def requests_with_file(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests (fid, end, ...) with their file's size (fid, size) and whether they end within it."""
    return requests.join(files.select("fid", "size"), "fid").withColumn("within", F.col("end") < F.col("size"))


def pending_approvals(offers: DataFrame, files: DataFrame) -> DataFrame:
    """(fid, pending): open offers without local approval, per file that there is."""
    waiting = offers.where("state = 'offered' and approved_at is null")
    return waiting.join(files.select("fid").distinct(), "fid", "left_semi").groupBy("fid").agg(F.count("*").alias("pending"))


def merge_keys(a: DataFrame, b: DataFrame, key: str = "kid") -> DataFrame:
    """Keys of either set, once each."""
    return a.select(key).unionByName(b.select(key)).distinct()


def chained(log: DataFrame, seq: str, line: str, part: str) -> DataFrame:
    """log with `before`: the digest of the line before, by seq; null for the first.

    Lines are numbered within their part, and only the parts' last lines meet; parts follow
    one another by seq.
    """
    digest = F.sha2(F.col(line), 256)
    within = F.lag(digest).over(Window.partitionBy(part).orderBy(seq))
    last = log.groupBy(F.col(part).alias("_part")).agg(F.min(seq).alias("_first"), F.max_by(digest, F.col(seq)).alias("_last"))
    ends = last.select("_part", F.lag("_last").over(Window.orderBy("_first")).alias("_carried"))  # one row per part
    joined = log.withColumn("before", within).join(ends, F.col(part) == F.col("_part"))
    return joined.select(*log.columns, F.coalesce("before", "_carried").alias("before"))


def consent_ok(issued: Column, accepted: Column, expires: Column, at: Column, last: Column | None = None) -> Column:
    """Whether an authorisation may be used at a time (all in seconds)."""
    ok = (accepted <= issued) & (issued < expires) & (expires - issued <= CONSENT) & (issued <= at + SKEW)
    ok = ok & (issued >= at - CONSENT - SKEW) & (accepted >= at - CONSENT - SKEW) & (expires >= at - SKEW)
    return ok & (at >= last - SKEW) if last is not None else ok


def permission_state(permissions: DataFrame, revocations: DataFrame, at: Column) -> DataFrame:
    """permissions (jti, state, sd, td in seconds) with `effective`: revoked, closed, expired, late_start, bound or issued."""
    revoked = revocations.select("jti").distinct().withColumn("_revoked", F.lit(True))
    state = (
        F.when(F.col("_revoked") | (F.col("state") == "revoked"), "revoked").when(F.col("state") == "closed", "closed")
        .when(F.col("td") <= at, "expired").when((F.col("state") != "bound") & (F.col("sd") <= at), "late_start").otherwise(F.col("state"))
    )
    return permissions.join(revoked, "jti", "left").withColumn("effective", state).drop("_revoked")


def offer_approval(offers: DataFrame, keys: list[str], order: str) -> DataFrame:
    """offers with `approved_at` carried from the row before if the offer is the same, or is a withdrawal."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = (F.lag("iid").over(w) == F.col("iid")) | (F.col("state") == "withdrawn")
    return offers.withColumn("kept_approval", F.when(same, F.lag("approved_at").over(w)))


def first_answer(instructions: DataFrame) -> DataFrame:
    """(iid, answer, repeats): the first answer per instruction, by seq."""
    return instructions.groupBy("iid").agg(F.min_by("answer", "seq").alias("answer"), (F.count("*") - 1).alias("repeats"))


def receipts(permissions: DataFrame, serves: DataFrame, islands: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per (oid, fid): size, transmitted bytes and intervals, exhausted bytes, jtis, first and last time, outcome."""
    keys = ["oid", "fid"]
    sent = islands.groupBy(*keys).agg(
        F.sum(F.col("end") - F.col("start") + 1).alias("transmitted_bytes"), F.array_sort(F.collect_list(F.array("start", "end"))).alias("transmitted")
    )
    told = permissions.groupBy(*keys).agg(F.array_sort(F.collect_set("jti")).alias("jtis"), F.min("bound_at").alias("first_at"), F.max("closed_at").alias("last_at"))
    out = sizes.join(told, keys, "left").join(sent, keys, "left").join(I.unwritten_exhausted(serves, islands, keys), keys, "left")
    bytes_ = F.coalesce("transmitted_bytes", F.lit(0))
    return out.select(
        *keys, "size", bytes_.alias("transmitted_bytes"), "transmitted", F.coalesce("unwritten", F.lit(0)).alias("exhausted_bytes"), "jtis", "first_at", "last_at",
        F.when(bytes_ == F.col("size"), "complete").otherwise("in_progress").alias("outcome"),
    )


def within_ceiling(path: Column, globs: list[str]) -> Column:
    """Whether a path is under a ceiling: `x/**` takes a whole tree, `*` and `?` stay within a part; no globs take all."""
    import re

    if not globs:
        return F.lit(True)
    one = lambda g: "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in g)
    tests = [path.startswith(g[:-2]) if g.endswith("/**") else path.rlike(f"^{one(g)}$") for g in globs]
    return reduce(lambda a, b: a | b, tests)


def readiness(orders: DataFrame, files: DataFrame, offers: DataFrame, serves: DataFrame, islands: DataFrame, globs: list[str], approval: bool) -> DataFrame:
    """orders (oid, fid, sha256) with the refusal that comes first, resume offset, intervals and serve counts.

    files: fid, sha256, size, changed (0, 1, 2 missing), path. offers: fid, sha256, state, key_class, approved_at.
    """
    keys = ["oid", "fid"]
    open_offers = offers.where("state = 'offered' and key_class = 'listing'").groupBy("fid", "sha256").agg(F.bool_or(F.col("approved_at").isNotNull()).alias("approved"))
    full = serves.where("count = 2")
    covered = I.contained(full, islands, keys).groupBy(*keys).agg(F.count("*").alias("n_covered"))
    exhausted = full.groupBy(*keys).agg(F.count("*").alias("n_full")).join(covered, keys, "left").select(*keys, (F.col("n_full") > F.coalesce("n_covered", F.lit(0))).alias("exhausted"))
    f = files.select("fid", F.col("sha256").alias("now_sha"), "size", "changed", "path")
    base = orders.join(f, "fid", "left").join(open_offers, ["fid", "sha256"], "left").join(exhausted, keys, "left").join(I.interval_stats(serves, islands, keys), keys, "left")
    base = base.join(I.resume_offset(islands, orders.select(*keys).distinct().join(f.select("fid", "size"), "fid"), keys).select(*keys, "offset"), keys, "left")
    refusal = (
        F.when(F.col("size").isNull() | (F.col("changed") == 2), "file_missing")
        .when((F.col("changed") == 1) | (F.col("now_sha") != F.col("sha256")), "file_changed")
        .when(~within_ceiling(F.col("path"), globs), "outside_ceiling")
        .when(F.col("approved").isNull(), "not_offered")
        .when(F.lit(approval) & ~F.col("approved"), "awaiting_local_approval")
        .when(F.coalesce("exhausted", F.lit(False)), "coverage_exhausted")
        .when((F.col("size") == 0) | (F.coalesce("bytes", F.lit(0)) == F.col("size")), "complete")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return base.select(*keys, refusal.alias("refusal"), zero("offset"), zero("bytes"), zero("intervals"), zero("max_serve_count"))


def check_chain(log: DataFrame, seq: str, line: str, prev: str, part: str) -> DataFrame:
    """Rows that break a chain: seq not one more than before, or prev not the digest of the line before.

    The chain is cut at `part` (its file): each part is a window of its own, and only the
    parts' first and last rows meet, so no task takes the whole log.
    """
    hashed = log.select(part, seq, prev, F.sha2(F.col(line), 256).alias("digest"))
    w = Window.partitionBy(part).orderBy(seq)
    within = hashed.withColumn("before_seq", F.lag(seq).over(w)).withColumn("before_digest", F.lag("digest").over(w))
    last = hashed.groupBy(part).agg(F.min(seq).alias("first_seq"), F.max(F.struct(F.col(seq).alias("s"), F.col("digest").alias("d"))).alias("last"))
    chain = Window.orderBy("first_seq")  # one row per file of the log
    ends = last.select(F.col(part).alias("_part"), F.lag("last").over(chain).alias("_before"))
    joined = within.join(ends, within[part] == ends["_part"])
    b_seq, b_digest = F.coalesce("before_seq", "_before.s"), F.coalesce("before_digest", "_before.d")
    seq_bad = b_seq.isNotNull() & (F.col(seq) != b_seq + 1)
    prev_bad = b_digest.isNotNull() & ~F.col(prev).eqNullSafe(b_digest)
    return joined.where(seq_bad | prev_bad).select(F.col(part), F.col(seq), seq_bad.alias("seq_broken"), prev_bad.alias("hash_broken"))


def canonical_json(line: Column) -> Column:
    """The canonical text of a JSON line: sorted keys, no white space, signs of markup and line separators escaped; null if it is no JSON."""
    text = F.to_json(F.try_parse_json(line))
    for sign, code in {"<": "003c", ">": "003e", "&": "0026", "\u2028": "2028", "\u2029": "2029"}.items():
        text = F.replace(text, F.lit(sign), F.lit(f"\\u{code}"))
    for code in (c for c in range(32) if f"{c:02x}" != f"{c:02X}"):  # control signs by small letters
        text = F.replace(text, F.lit(f"\\u00{code:02X}"), F.lit(f"\\u00{code:02x}"))
    return text


def check_event_chain(log: DataFrame, line: str, pos: str, part: str, fields: int = FIELDS) -> DataFrame:
    """Rows of a local event log that break its rules: (part, pos, not_canonical, fields_wrong, id_broken, hash_broken).

    A line is canonical JSON with exactly `fields` fields; event_id is a whole number above
    that of the line before (not one more), prev_hash the digest of the raw line before, empty
    for the first. Lines stand by pos; parts (files) follow one another, and only their last
    lines meet. A line whose predecessor has no id is not out of order.
    """
    told = F.try_parse_json(F.col(line))
    number = F.schema_of_variant(F.try_variant_get(told, "$.event_id", "variant")) == "BIGINT"
    prev = F.when(F.schema_of_variant(F.try_variant_get(told, "$.prev_hash", "variant")) == "STRING", F.try_variant_get(told, "$.prev_hash", "string"))
    read = log.select(
        part, pos, F.coalesce(canonical_json(F.col(line)) == F.col(line), F.lit(False)).alias("canonical"), F.size(F.json_object_keys(line)).alias("n"),
        F.when(number, F.try_variant_get(told, "$.event_id", "bigint")).alias("event_id"), prev.alias("prev"), F.sha2(F.col(line), 256).alias("digest"),
    )
    own = F.struct("event_id", "digest")
    within = read.withColumn("within", F.lag(own).over(Window.partitionBy(part).orderBy(pos)))
    last = read.groupBy(F.col(part).alias("_part")).agg(F.min(pos).alias("_first"), F.max_by(own, F.col(pos)).alias("_last"))
    ends = last.select("_part", F.lag("_last").over(Window.orderBy("_first")).alias("_carried"))  # one row per part
    joined = within.join(ends, within[part].eqNullSafe(ends["_part"])).withColumn("before", F.coalesce("within", "_carried"))
    id_broken = F.col("event_id").isNull() | F.coalesce(F.col("event_id") <= F.col("before.event_id"), F.lit(False))
    hash_broken = ~F.coalesce("prev", F.lit("")).eqNullSafe(F.coalesce("before.digest", F.lit("")))
    flags = joined.select(part, pos, (~F.col("canonical")).alias("not_canonical"), (~F.col("n").eqNullSafe(F.lit(fields))).alias("fields_wrong"), id_broken.alias("id_broken"), hash_broken.alias("hash_broken"))
    return flags.where("not_canonical or fields_wrong or id_broken or hash_broken")


def check_order(manifest: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """Identities that do not come strictly after the one before them, by position, per key; (keys, pos, identity)."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return manifest.withColumn("_before", F.lag(identity).over(w)).where(F.col(identity) <= F.col("_before")).select(*keys, "pos", identity)


def replay_from(log: DataFrame, at: DataFrame) -> DataFrame:
    """Entries after the server's position (at: part, seq, hash), or one row `divergence` per part that disagrees."""
    here = log.select("part", "seq", F.sha2("line", 256).alias("digest"))
    asked = at.select("part", F.col("seq").alias("_seq"), F.col("hash").alias("_hash"))
    found = asked.join(here, (asked["part"] == here["part"]) & (F.col("_seq") == F.col("seq")), "left").select(asked["part"], "_seq", F.when(F.col("_seq") == 0, F.lit("")).otherwise(F.coalesce("digest", F.lit("absent"))).eqNullSafe(F.col("_hash")).alias("agrees"))
    after = log.select("part", "seq").join(found, "part").where("agrees and seq > _seq").select("part", "seq", F.lit("replay").alias("action"))
    return after.unionByName(found.where("not agrees").select("part", F.col("_seq").alias("seq"), F.lit("divergence").alias("action")))


def unseen(instructions: DataFrame, seen: DataFrame, key: str = "iid") -> DataFrame:
    """First row of every instruction that was not seen before."""
    fresh = instructions.join(seen.select(key).distinct(), key, "left_anti")
    return latest_state(fresh.withColumn("_order", -F.col("seq")), [key], ["_order"]).drop("_order")


def unaudited(outbox: DataFrame, audited: DataFrame) -> DataFrame:
    """Outbox rows beyond the audited high water, in seq order."""
    return outbox.where(F.col("seq") > audited.agg(F.coalesce(F.max("seq"), F.lit(0))).scalar()).orderBy("seq")


def mark_delivered(outbox: DataFrame, audited: DataFrame, ack: int) -> DataFrame:
    """outbox with `delivered`: an audited row at or before the acknowledged position."""
    done = audited.where(F.col("audit_seq") <= ack).select("seq").distinct().withColumn("_done", F.lit(True))
    return outbox.join(done, "seq", "left").withColumn("delivered", F.coalesce("_done", F.lit(False))).drop("_done")


def retained(rows: DataFrame, parents: DataFrame, key: str, at: Column, ts: str, days: int = 30) -> DataFrame:
    """rows that are young enough, or have a live parent."""
    live = parents.select(key).distinct()
    old = F.col(ts) < at - F.expr(f"interval {days} days")
    return rows.where(~old).unionByName(rows.where(old).join(live, key, "left_semi").select(*rows.columns))


def orphans(rows: DataFrame, parents: DataFrame, key: str, at: Column, ts: str, days: int = 30) -> DataFrame:
    """rows past retention without a live parent."""
    return rows.where(F.col(ts) < at - F.expr(f"interval {days} days")).join(parents.select(key).distinct(), key, "left_anti")
