"""Byte intervals with inclusive ends, per key columns, as window jobs.

Lists of disjoint ranges (serves of one count, islands) meet others by one pass over the
merged order of their ends, so a long range makes no pairs; the rows of a hot key go in
segments of many tasks (`scans`). `overlapping`
gives the pairs themselves for any two tables: an interval is listed under every cell of
`cell` bytes it touches, and a pair counts in its first common cell only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import hot_keys, scan

CELL = 1 << 20


def range_overlap(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(b1, b2) - F.greatest(a1, a2) + 1)


def serve_counts(ranges: DataFrame, keys: list[str], delta: str | None = None) -> DataFrame:
    """(keys, start, end, count): how often each byte was asked for; equal neighbours merged.

    ranges has start and end, and delta (+1 where None). Counts of zero and less are left out.
    """
    step = F.col(delta) if delta else F.lit(1)
    points = F.array(F.struct(F.col("start").alias("pos"), step.cast("bigint").alias("d")), F.struct((F.col("end") + 1).alias("pos"), (-step).cast("bigint").alias("d")))
    # Equal points are summed before the shuffle.
    given = ranges.where("start <= end")
    steps = given.select(*keys, F.inline(points)).groupBy(*keys, "pos").agg(F.sum("d").alias("d")).where("d <> 0")
    found = scan(steps, keys, ["pos"], hot_keys(given, keys, times=2), level=("sum", F.col("d")), after=("next", F.col("pos")))
    # Points of no change are gone, so neighbours differ and nothing is left to merge.
    runs = found.select(*keys, F.col("pos").alias("start"), (F.col("after") - 1).alias("end"), F.col("level").alias("count"))
    return runs.where("count > 0 and end is not null")


def coverage_islands(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): union of the ranges; adjacent ones join."""
    given = ranges.where("start <= end")
    hot = hot_keys(given, keys)
    reached = scan(given.groupBy(*keys, "start").agg(F.max("end").alias("end")), keys, ["start"], hot, reach=("max_before", F.col("end")))
    fresh = F.col("reach").isNull() | (F.col("start") > F.col("reach") + 1)
    found = scan(reached, keys, ["start"], hot, island=("max", F.when(fresh, F.col("start"))))
    return found.groupBy(*keys, "island").agg(F.max("end").alias("end")).select(*keys, F.col("island").alias("start"), "end")


def resume_offset(islands: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, size, offset): first byte not transmitted, at most the size. sizes has keys and size."""
    first = islands.where("start <= 0 and end >= 0").select(*keys, (F.col("end") + 1).alias("next"))
    return sizes.join(first, keys, "left").select(*keys, "size", F.least("size", F.coalesce("next", F.lit(0))).alias("offset"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """left x right with equal keys and common bytes; right's ends come as start2, end2.

    Columns of right other than keys, start and end must not clash with left's.
    """
    cells = lambda df: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell))))
    other = right.withColumnsRenamed({"start": "start2", "end": "end2"})
    other = other.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start2") / cell), F.floor(F.col("end2") / cell))))
    met = cells(left).join(other, [*keys, "cell"]).where("start <= end2 and start2 <= end")
    return met.where(F.col("cell") == F.floor(F.greatest("start", "start2") / cell)).drop("cell")


def contained(ranges: DataFrame, islands: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges that one island holds: the island of a range's start must reach its end.

    Islands are disjoint, so an as-of lookup on the merged order of starts finds it: one
    sort per key and no pairs.
    """
    marks = islands.select(*keys, F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("end").alias("reach")).alias("island"))
    asked = ranges.select("*", F.col("start").alias("at"), F.lit(1).alias("kind"))
    both = asked.unionByName(marks, allowMissingColumns=True)
    # Islands come in order, so the last one's end is the largest so far.
    held = scan(both, keys, ["at", "kind"], hot_keys(both, keys), reach=("max", F.col("island")["reach"]))
    return held.where((F.col("kind") == 1) & (F.col("reach") >= F.col("end"))).select(*ranges.columns)


def first_exhausted(requests: DataFrame, serves: DataFrame, keys: list[str], limit: int = 2) -> DataFrame:
    """requests with `exhausted`: first byte of theirs already served `limit` times, or null.

    serves are disjoint. The range before a request's start may hold it; else the next one's
    start counts, if it is not beyond the request's end.
    """
    full = serves.where(F.col("count") >= limit)
    marks = full.select(*keys, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("end").alias("_reach"))
    asked = requests.select("*", F.col("start").alias("_at"), F.lit(1).alias("_kind"))
    both = asked.unionByName(marks, allowMissingColumns=True)
    found = scan(both, keys, ["_at", "_kind"], hot_keys(both, keys), _held=("max", F.col("_reach")), _next=("min_from", F.when(F.col("_kind") == 0, F.col("_at"))))
    exhausted = F.when(F.col("_held") >= F.col("start"), F.col("start")).when(F.col("_next") <= F.col("end"), F.col("_next"))
    return found.where("_kind = 1").select(*requests.columns, F.when(F.col("start") <= F.col("end"), exhausted).alias("exhausted"))


def truncate_requests(requests: DataFrame, serves: DataFrame, keys: list[str], limit: int = 2) -> DataFrame:
    """requests with `granted_end` (before the first exhausted byte), null where refused."""
    found = first_exhausted(requests, serves, keys, limit)
    return found.withColumn("granted_end", F.when(F.col("exhausted").isNull(), F.col("end")).when(F.col("exhausted") > F.col("start"), F.col("exhausted") - 1))


def unwritten_exhausted(serves: DataFrame, islands: DataFrame, keys: list[str], limit: int = 2) -> DataFrame:
    """(keys, unwritten): bytes at the serve limit that were never transmitted; one row per key with such serves.

    Serves and islands are disjoint each. Both go along the file as steps; what lies in a
    serve and in no island is summed between neighbouring steps.
    """
    full = serves.where(F.col("count") == limit)

    def steps(df: DataFrame, name: str, other: str) -> DataFrame:
        step = lambda at, by: F.struct(at.alias("pos"), F.lit(by).alias(name), F.lit(0).alias(other))
        return df.select(*keys, F.inline(F.array(step(F.col("start").cast("bigint"), 1), step((F.col("end") + 1).cast("bigint"), -1))))

    points = steps(full, "served", "written").unionByName(steps(islands, "written", "served")).groupBy(*keys, "pos").agg(F.sum("served").alias("served"), F.sum("written").alias("written"), F.max(F.col("served") != 0).alias("asked"))
    levels = scan(points, keys, ["pos"], hot_keys(points, keys), after=("next", F.col("pos")), in_serves=("sum", F.col("served")), in_islands=("sum", F.col("written")))
    levels = levels.select(*keys, "asked", (F.col("after") - F.col("pos")).alias("size"), F.col("in_serves").alias("served"), F.col("in_islands").alias("written"))
    missing = F.sum(F.when((F.col("served") > 0) & (F.col("written") == 0), F.col("size")).otherwise(0))
    return levels.groupBy(*keys).agg(missing.alias("unwritten"), F.bool_or("asked").alias("asked")).where("asked").drop("asked")


def interval_stats(serves: DataFrame, islands: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, intervals, bytes, max_serve_count)."""
    a = islands.groupBy(*keys).agg(F.count("*").alias("intervals"), F.sum(F.col("end") - F.col("start") + 1).alias("bytes"))
    b = serves.groupBy(*keys).agg(F.max("count").alias("max_serve_count"))
    return a.join(b, keys, "full_outer").na.fill(0, ["intervals", "bytes", "max_serve_count"])


def settle(requests: DataFrame, window: int = 8 << 20) -> DataFrame:
    """Returned ranges of settled requests: what was reserved beyond what is kept.

    requests: start, end, written_through, crashed. A crash keeps one window past progress.
    """
    keep = F.when(F.col("crashed"), F.least(F.col("end"), F.col("written_through") + window)).otherwise(F.col("written_through"))
    back = requests.withColumn("kept_through", keep).withColumn("returned_from", F.greatest(F.col("start"), F.col("kept_through") + 1))
    return back.withColumn("returned_bytes", F.greatest(F.lit(0).cast("bigint"), F.col("end") - F.col("returned_from") + 1))


def completions(islands: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose whole file is covered; empty files are complete at once. sizes has keys and size."""
    whole = islands.where("start = 0").select(*keys, "end")
    return sizes.join(whole, keys, "left").where("size = 0 or end >= size - 1").select(*keys).distinct()


def fragmented(islands: DataFrame, open_isolated: DataFrame, keys: list[str], cap: int = 1024) -> DataFrame:
    """(keys, intervals, open_requests, refused): whether one more isolated request passes the cap."""
    a = islands.groupBy(*keys).agg(F.count("*").alias("intervals"))
    b = open_isolated.groupBy(*keys).agg(F.count("*").alias("open_requests"))
    both = a.join(b, keys, "full_outer").na.fill(0, ["intervals", "open_requests"])
    return both.withColumn("refused", F.col("intervals") + F.col("open_requests") + 1 > cap)
