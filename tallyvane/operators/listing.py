"""Listings of members: scope, admission, read plans, bindings, estimates."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions import content as C
from tallyvane.functions import ids
from tallyvane.session import shared_path

TABLES = ["csv", "tsv", "jsonl", "parquet"]
#: Admission limits (bytes), member cap, rates and report sizes.
TEXT_MAX, PARQUET_MAX, MEMBERS_MAX = 6_000_000_000, 1_000_000_000, 17_033
ESTIMATE_SECONDS, OVERHEAD_SECONDS, REPORT_MAX = 720, 120, 2_097_152
#: Bytes of a report without members, and of a member's row.
REPORT_FIXED, MEMBER_ROW = 955_904, 67
TOKEN_CAP = 8192
#: Members whose parts are joined before a listing's digest passes over them.
RUN = 64
#: Members of a listing that one task may fold; larger listings are planned by rounds first.
FOLD_MAX = 10_000


def in_scope(key: Column, keys: list[str], prefixes: list[str], whole: bool = False) -> Column:
    """Exact keys and slash-bounded prefixes, or the whole bucket."""
    if whole:
        return (key != "") & ~key.contains("\x00")
    tests = [key.isin(*keys)] if keys else []
    tests += [key.startswith(p.rstrip("/") + "/") for p in prefixes if p]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_table(fmt: Column) -> Column:
    return fmt.isin(*TABLES)


def name_check(schemas: DataFrame, max_columns: int = 1000) -> DataFrame:
    """(object_id, valid) of schemas (object_id, name): 1 to 256 characters, unique, not too many."""
    n = F.length("name")
    return schemas.groupBy("object_id").agg(
        ((F.count("*") <= max_columns) & (F.count_distinct("name") == F.count("*")) & (F.min(n) >= 1) & (F.max(n) <= 256)).alias("valid")
    )


def affected_members(schemas: DataFrame, rules: DataFrame) -> DataFrame:
    """Members of schemas (object_id, name) with an original column that rules (name) rename or drop."""
    return schemas.join(rules.select("name").distinct(), "name", "left_semi").select("object_id").distinct()


def coverage(members: DataFrame) -> DataFrame:
    """(listing_id, discovered, scanned, in_census, skipped): skipped is a map of reason to count.

    members: listing_id, format, reason (null: read).
    """
    per = members.groupBy("listing_id", "reason").agg(F.count("*").alias("n"), F.count_if(is_table(F.col("format"))).alias("t"))
    none = F.col("reason").isNull()
    entries = F.collect_list(F.when(~none, F.struct("reason", "n")))
    return per.groupBy("listing_id").agg(
        F.sum("n").alias("discovered"), F.coalesce(F.sum(F.when(none, F.col("t"))), F.lit(0)).alias("scanned"),
        F.coalesce(F.sum(F.when(none, F.col("n") - F.col("t"))), F.lit(0)).alias("in_census"), F.map_from_entries(F.array_sort(entries)).alias("skipped"),
    )


def fold_objects(facts: DataFrame) -> DataFrame:
    """(object_id, names, types): columns of an object as arrays in their order (at most 1,000 each)."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "name", "type")))
    folded = facts.groupBy("object_id").agg(ordered.alias("c"))
    return folded.select("object_id", F.transform("c", lambda x: x["name"]).alias("names"), F.transform("c", lambda x: x["type"]).alias("types"))


def _digest_in_order(rows: DataFrame, name: str) -> DataFrame:
    """(listing_id, name): SHA-256 of the parts of rows (listing_id, at, part) by at and part, null parts left out.

    Ranges are sorted and joined to runs in parallel. SHA-256 is a chain, so one task then
    passes over a listing's runs; it holds one batch of them, whatever the listing's size.
    """
    kind = rows.schema["listing_id"].dataType.simpleString()

    def join(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            listings, parts = batch.column("listing_id").to_pylist(), batch.column("part").to_pylist()
            starts = [0]
            for i in range(1, len(parts)):
                if listings[i] != listings[i - 1] or i - starts[-1] == RUN:
                    starts.append(i)
            runs = [b"".join(p for p in parts[i:j] if p is not None) for i, j in zip(starts, [*starts[1:], len(parts)], strict=True)] if parts else []
            firsts = batch.column("listing_id").take(pa.array(starts[: len(runs)], pa.int64()))
            numbers = pa.array(range(number, number + len(runs)), pa.int64())
            yield pa.RecordBatch.from_arrays([firsts, pa.array([task] * len(runs), pa.int32()), numbers, pa.array(runs, pa.binary())], ["listing_id", "task", "number", "run"])
            number += len(runs)

    def fold(batches):
        at, digest = None, None
        done = lambda: pa.RecordBatch.from_pydict({"listing_id": pa.array([at], listing_type), name: pa.array([digest.hexdigest()])})
        for batch in batches:
            listing_type = batch.schema.field("listing_id").type
            for listing, run in zip(batch.column("listing_id").to_pylist(), batch.column("run"), strict=True):
                if digest is None or listing != at:
                    if digest is not None:
                        yield done()
                    at, digest = listing, hashlib.sha256()
                digest.update(run.as_buffer())
        if digest is not None:
            yield done()

    ranges = rows.repartitionByRange("listing_id", "at").sortWithinPartitions("listing_id", "at", "part")
    runs = ranges.select("listing_id", "part").mapInArrow(join, f"listing_id {kind}, task int, number long, run binary")
    return runs.repartition("listing_id").sortWithinPartitions("listing_id", "task", "number").mapInArrow(fold, f"listing_id {kind}, {name} string")


def fingerprint(folded: DataFrame) -> DataFrame:
    """(listing_id, fingerprint) of folded (listing_id, object_id, names, types): digest of the rows' digests in order."""
    rows = folded.select("listing_id", F.col("object_id").alias("at"), ids.row_digest("object_id", "names", "types").cast("binary").alias("part"))
    return _digest_in_order(rows, "fingerprint")


def _u64(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("bigint")), 16, "0")


def _framed(text: Column) -> Column:
    return F.concat(_u64(F.octet_length(text)), F.hex(text.cast("binary")))


def _ordered_digest(members: DataFrame, part: Column) -> DataFrame:
    """(listing_id, digest): SHA-256 of the members' parts (hex), in order of identity."""
    return _digest_in_order(members.select("listing_id", F.col("identity").alias("at"), F.unhex(part).alias("part")), "digest")


def ordered_digest(members: DataFrame) -> DataFrame:
    """Digest over identity, size and content digest of all members."""
    return _ordered_digest(members, F.concat(_framed(F.col("identity")), _u64(F.col("size")), F.upper("sha256")))


def unread_binding(members: DataFrame, plan: DataFrame) -> DataFrame:
    """Digest over identity, size, etag and version of census members outside the plan (listing_id, identity)."""
    outside = members.where(~is_table(F.col("format"))).join(plan, ["listing_id", "identity"], "left_anti")
    return _ordered_digest(outside, F.concat(_framed(F.col("identity")), _metadata()))


def _metadata() -> Column:
    etag = F.regexp_replace(F.coalesce("etag", F.lit("")), '^"+|"+$', "")
    return F.concat(_u64(F.col("size")), _framed(etag), _framed(F.coalesce("version_id", F.lit(""))))


def member_commitment(results: DataFrame) -> DataFrame:
    """results (listing_id, identity, state, size, sha256, etag, version_id, prefix) with a tag and a digest."""
    unread = F.sha2(F.unhex(_metadata()), 256)
    prefix = F.coalesce("prefix", F.lit(""))
    decoded = F.sha2(F.unhex(F.concat(_u64(F.octet_length(prefix)), F.hex(F.lit("decoded_prefix").cast("binary")), F.hex(prefix.cast("binary")))), 256)
    tag = F.when(F.col("state") == "fully_read", "full").when(F.col("state") == "partly_read", "decoded_prefix").otherwise("unread")
    return results.select("listing_id", "identity", tag.alias("tag"), F.when(tag == "full", F.col("sha256")).when(tag == "decoded_prefix", decoded).otherwise(unread).alias("digest"))


def all_members(tables: DataFrame, census: DataFrame) -> DataFrame:
    """(listing_id, identity, kind): members told as tables and members of the census together, in order of identity."""
    told = lambda df, kind: df.select("listing_id", "identity", F.lit(kind).alias("kind"))
    return told(tables, "table").unionByName(told(census, "census")).orderBy("listing_id", "identity")


def eligible_members(snapshot: DataFrame, files: DataFrame, offers: DataFrame, superseding: DataFrame) -> DataFrame:
    """Members of a snapshot (fid, member_id, ...) that have a live file (member_id), an open listing offer (fid, state, key_class) and no superseding offer (fid)."""
    live = snapshot.join(files.select("member_id").distinct(), "member_id", "left_semi")
    offered = live.join(offers.where("state = 'offered' and key_class = 'listing'").select("fid").distinct(), "fid", "left_semi")
    return offered.join(superseding.select("fid").distinct(), "fid", "left_anti")


def resolve_objects(reported: DataFrame, members: DataFrame, key_hex: str, kind: str, source: str) -> DataFrame:
    """members (identity, sha256, ...) of the reported object_ids, found again by computing every member's id."""
    named = members.withColumn("object_id", ids.object_id(key_hex, kind, source, F.col("identity"), F.col("sha256")))
    return named.join(reported.select("object_id").distinct(), "object_id", "left_semi")


def outside_plan(members: DataFrame, plan: DataFrame) -> DataFrame:
    return members.join(plan, ["listing_id", "identity"], "left_anti")


def token_estimate(schemas: DataFrame) -> DataFrame:
    """(listing_id, tokens, over) of schemas (listing_id, object_id, name): the report's upper bound in tokens."""
    per = schemas.groupBy("listing_id", "object_id").agg(F.sum(F.octet_length("name") * 6 + 768).alias("n"))
    bound = F.lit(512) + F.sum(F.col("n") + 512)
    tokens = F.greatest(F.lit(1), F.floor((bound + 2) / 3)).cast("bigint")
    return per.groupBy("listing_id").agg(tokens.alias("tokens")).withColumn("over", F.col("tokens") > TOKEN_CAP)


def admit_size(members: DataFrame) -> DataFrame:
    """(listing_id, members, text, parquet, verdict): the size and throughput inequalities."""
    t, p, n = F.col("text"), F.col("parquet"), F.col("members")
    sums = members.groupBy("listing_id").agg(
        F.count("*").alias("members"), F.coalesce(F.sum(F.when(F.col("format").isin("csv", "tsv", "jsonl"), F.col("size"))), F.lit(0)).alias("text"),
        F.coalesce(F.sum(F.when(F.col("format") == "parquet", F.col("size"))), F.lit(0)).alias("parquet"), F.min("size").alias("least"),
    )
    verdict = (
        F.when(n > MEMBERS_MAX, "member_count_exceeded").when(REPORT_FIXED + MEMBER_ROW * n > REPORT_MAX, "refused").when(F.col("least") < 0, "refused")
        .when((t > TEXT_MAX) | (p > PARQUET_MAX) | (t + 6 * p > TEXT_MAX), "refused")
        .when(9 * t + 50 * p > (ESTIMATE_SECONDS - OVERHEAD_SECONDS) * 90_000_000, "refused").otherwise("admitted")
    )
    return sums.withColumn("verdict", verdict).drop("least")


def keyed_rank(members: DataFrame, seed_hex: str) -> DataFrame:
    """members with `rank_key`, a reproducible random order."""
    return members.withColumn("rank_key", ids.hmac_sha256(seed_hex, F.col("identity").cast("binary")))


def _written(df: DataFrame, label: str) -> DataFrame:
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned_read_set(members: DataFrame, seed_hex: str, budget: int, allowance: int) -> DataFrame:
    """(listing_id, identity) to read: census members in keyed order while they fit; those that do not are passed over.

    What costs nothing is read, and what costs more than is left never fits. A round takes
    the members before the first that does not fit, by running sums within ranges of the key
    and over the ranges' sums, then drops all that cost more than what remains. When no
    listing has over FOLD_MAX members left, each is folded in one task.
    """
    cost = F.when(C.archive_format(F.col("format")).isNotNull(), F.lit(allowance)).otherwise(F.col("size"))
    ranked = keyed_rank(members.where(~is_table(F.col("format"))), seed_hex).select("listing_id", "identity", "rank_key", cost.cast("bigint").alias("cost"))
    taken = ranked.where((F.col("cost") == 0) & F.lit(budget >= 0)).select("listing_id", "identity")
    rest = ranked.where(F.col("cost").between(1, budget)).withColumn("left", F.lit(budget).cast("bigint"))
    span = F.substring("rank_key", 1, 2)
    inside = Window.partitionBy("listing_id", "span").orderBy("rank_key", "identity", "cost").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("listing_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # 256 spans at most
    while rest.groupBy("listing_id").count().where(F.col("count") > FOLD_MAX).head(1):
        rest = rest.withColumn("span", span)
        sums = rest.groupBy("listing_id", "span").agg(F.sum("cost").alias("sum"))
        before = sums.select(F.col("listing_id").alias("_listing"), F.col("span").alias("_span"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
        same = F.col("listing_id").eqNullSafe(F.col("_listing"))
        upto = rest.withColumn("sum", F.sum("cost").over(inside)).join(before, same & (F.col("span") == F.col("_span")))
        met = _written(upto.select("listing_id", "identity", "rank_key", "cost", "left", (F.col("before") + F.col("sum") <= F.col("left")).alias("fits")), "reads")
        taken = taken.unionByName(met.where("fits").select("listing_id", "identity"))
        used = met.where("fits").groupBy(F.col("listing_id").alias("_listing")).agg(F.sum("cost").alias("used"))
        left = F.col("left") - F.coalesce("used", F.lit(0))
        rest = met.where("not fits").join(used, same, "left").select("listing_id", "identity", "rank_key", "cost", left.alias("left")).where("cost <= left")
        rest = _written(rest, "unread")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, taken = rows.sort_values(["rank_key", "identity", "cost"]), []
        left = rows["left"].iloc[0]
        for cost in rows["cost"]:
            fits = cost <= left
            taken.append(fits)
            left -= cost if fits else 0
        return rows.loc[taken, ["listing_id", "identity"]]

    kinds = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in ("listing_id", "identity"))
    return taken.unionByName(rest.groupBy("listing_id").applyInPandas(fold, kinds))


#: Depth classes, and the classes of cells that count as read.
COMPLETE, SAMPLED = "content_census_complete_v1", "content_census_sampled_v1"
READ_CLASSES = ("fully_read", "partly_read", "other")


def check_coverage(report: DataFrame, members: DataFrame, plan: DataFrame) -> DataFrame:
    """Violations of a report (listing_id, members, fully_read, unread) against its members and plan."""
    m = members.groupBy("listing_id").agg(F.count("*").alias("n"))
    p = plan.groupBy("listing_id").agg(F.count("*").alias("planned"))
    x = report.join(m, "listing_id", "left").join(p, "listing_id", "left").na.fill(0, ["n", "planned"])
    rules = {"members": F.col("members") != F.col("n"), "read_over_plan": F.col("fully_read") > F.col("planned"), "unread_short": F.col("unread") < F.col("n") - F.col("planned")}
    flags = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return x.select("listing_id", F.explode(flags).alias("violation"))


def _holds(told, n):
    """Whether a count told as a number or a band (text) can be n; false if it is neither."""
    bands = {"0": n == 0, "1-9": (n >= 1) & (n <= 9), "10-99": (n >= 10) & (n <= 99), "100-999": (n >= 100) & (n <= 999), "1000+": n >= 1000}
    out = F.when(told.rlike("^[0-9]+$"), told.try_cast("bigint") == n)
    for band, fits in list(bands.items())[1:]:
        out = out.when(told == band, fits)
    return F.coalesce(out, F.lit(False))


def check_census(reports: DataFrame, members: DataFrame, plan: DataFrame) -> DataFrame:
    """(listing_id, violation): published census reports against the exact members and plan, all rules that each breaks.

    reports: listing_id; members, members_total and population as numbers or bands (text);
    depth_class, sampled; state of the read states and its cells (class, members as text).
    Bands must contain the exact counts, the depth class go with the plan, and the cells of a
    checked partition be exact, known, once each, sum up, and leave room for the plan.
    """
    n = members.groupBy("listing_id").agg(F.count("*").alias("_n"))
    p = plan.groupBy("listing_id").agg(F.count("*").alias("_planned"))
    x = reports.join(n, "listing_id", "left").join(p, "listing_id", "left").na.fill(0, ["_n", "_planned"])
    total, planned, cells = F.col("_n"), F.col("_planned"), F.coalesce("cells", F.array())
    exact = F.transform(cells, lambda c: F.when(c["members"].rlike("^[0-9]+$"), c["members"].try_cast("bigint")))
    summed = lambda kinds: F.aggregate(
        F.filter(F.arrays_zip(cells.getField("class").alias("kind"), exact.alias("n")), lambda c: c["kind"].isin(*kinds)), F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(c["n"], F.lit(0))
    )
    kinds, checked = cells.getField("class"), F.col("state") == "checked"
    read, unread = summed(READ_CLASSES), summed(("unread",))
    complete, sampled = F.col("depth_class") == COMPLETE, F.coalesce("sampled", F.lit(False))
    rules = {
        "plan_over_members": planned > total,
        "members_outside_band": ~_holds(F.col("members"), total) | ~_holds(F.col("members_total"), total),
        "depth_class_unknown": ~F.coalesce(F.col("depth_class").isin(COMPLETE, SAMPLED), F.lit(False)),
        "complete_but_sampled": complete & ((planned != total) | sampled),
        "sampled_but_complete": (F.col("depth_class") == SAMPLED) & ~sampled,
        "state_unknown": ~F.coalesce(F.col("state").isin("checked", "suppressed", "not_checked"), F.lit(False)),
        "population_outside_band": checked & ~_holds(F.col("population"), total),
        "cell_not_exact": checked & F.exists(exact, lambda c: c.isNull()),
        "cell_repeated": checked & (F.size(F.array_distinct(kinds)) != F.size(kinds)),
        "cell_unknown": checked & F.exists(kinds, lambda k: ~F.coalesce(k.isin(*READ_CLASSES, "unread"), F.lit(False))),
        "cells_do_not_sum_up": checked & (read + unread != total),
        "read_over_plan": checked & (read > planned),
        "unread_short": checked & (unread < total - planned),
    }
    flags = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return x.select("listing_id", F.explode(flags).alias("violation"))


def zip_plan(entries: DataFrame, max_entries: int, allowance: int) -> DataFrame:
    """entries (member, i, offset, compressed, size, cd_offset) with `selected` and `valid`.

    Selected: the entries before the first one over the cap or the allowance. Valid: the
    extent up to the next entry's offset holds header and data, and the one before does not reach in.
    """
    upto = Window.partitionBy("member").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (F.col("offset") >= 0) & (F.col("offset") <= F.col("cd_offset") - 30)
    by_offset = Window.partitionBy("member", "_inside").orderBy("offset", "i")
    marked = entries.withColumn("_inside", inside).withColumn("_sum", F.sum("size").over(upto)).withColumn("selected", (F.col("i") < max_entries) & (F.col("_sum") <= allowance))
    bound = F.coalesce(F.lead("offset").over(by_offset), F.col("cd_offset"))
    short = (F.col("compressed") > F.greatest(F.lit(0), bound - F.col("offset") - 30)) | (bound - F.col("offset") < 30)
    fits = marked.withColumn("_short", short).withColumn("_hit", F.coalesce(F.lag("_short").over(by_offset), F.lit(False)))
    return fits.withColumn("valid", F.col("_inside") & ~F.col("_short") & ~F.col("_hit")).drop("_sum", "_short", "_hit", "_inside")
