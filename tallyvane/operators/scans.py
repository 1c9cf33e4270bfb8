"""Running values along an order within keys, where one key may hold most rows.

A key of few rows is one window. The rows of a key of many are cut into segments of about
SEGMENT rows at positions that a hash of the position itself picks, so the cuts follow the
data and come out the same on any partitioning. Values run within segments; only the
segments' totals meet, and what they carry is joined back. Keys of many rows, their cuts and
their segments' totals are at most one row in SEGMENT each, which bounds what is broadcast.

Rows of one position stay together. Null keys are one key. Null values are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.session import shared_path

SEGMENT = 1 << 20
#: Steps of the search for a row's segment: as many cuts of one key as can be told apart.
STEPS = [1 << k for k in range(24, -1, -1)]


def hot_keys(df: DataFrame, keys: list[str], rows: int | None = None, times: int = 1) -> DataFrame | None:
    """The keys with more than SEGMENT rows (a row of df makes `times` rows at most), written; None if there are none."""
    found = df.groupBy(*keys).agg((F.count("*") * times).alias("_n")).where(F.col("_n") > (rows or SEGMENT)).select(*keys)
    path = shared_path(df.sparkSession, "hot-keys")
    found.write.parquet(path)
    hot = df.sparkSession.read.schema(found.schema).parquet(path)
    return None if hot.isEmpty() else hot


def _same(df: DataFrame, other: DataFrame, names: list[str]):
    """Condition: equal names, nulls too; other's are prefixed with an underscore."""
    condition = F.lit(True)
    for n in names:
        condition = condition & df[n].eqNullSafe(other[f"_{n}"])
    return condition


def _prefixed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({n: f"_{n}" for n in names})


def segmented(df: DataFrame, keys: list[str], at: str, hot: DataFrame, rows: int | None = None) -> DataFrame:
    """df with _segment: numbers that rise with `at` within a hot key; null for other keys."""
    named = _prefixed(hot, keys)
    picked = F.pmod(F.xxhash64(at), F.lit(rows or SEGMENT)) == 0
    some = df.where(picked).join(F.broadcast(named), _same(df, named, keys), "left_semi")
    cuts = _prefixed(some.groupBy(*keys).agg(F.array_sort(F.collect_set(at)).alias("cuts")), keys)
    # A hot key whose positions are all the same has no cuts: one segment.
    cuts = named.alias("h").join(cuts.alias("c"), _all_same("h", "c", keys), "left")
    cuts = cuts.select(*[F.col(f"h._{k}").alias(f"_{k}") for k in keys], F.coalesce("c.cuts", F.array().cast(f"array<{dict(df.dtypes)[at]}>")).alias("_cuts"))
    search = F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda n, step: F.when(F.get("_cuts", n + step - 1) <= F.col(at), n + step).otherwise(n))
    met = df.join(F.broadcast(cuts), _same(df, cuts, keys), "left")
    return met.select(*[df[c] for c in df.columns], F.when(F.col("_cuts").isNotNull(), search).alias("_segment"))


def _all_same(a: str, b: str, keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"{a}._{k}").eqNullSafe(F.col(f"{b}._{k}"))
    return condition


def scan(df: DataFrame, keys: list[str], order: list[str], hot: DataFrame | None = None, rows: int | None = None, **wanted: tuple[str, Column]) -> DataFrame:
    """df with a column per wanted name = (how, value), run along `order` within keys.

    sum and max include the row, max_before does not; next is the following row's value,
    min_from the least from the row on. hot: keys whose rows are cut at the first column
    of order (see hot_keys).
    """
    values = {f"_v_{name}": value for name, (_, value) in wanted.items()}
    df = df.select("*", *[v.alias(n) for n, v in values.items()])
    if hot is not None:
        path = shared_path(df.sparkSession, "scan")  # read more than once
        df.write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
        df = segmented(df, keys, order[0], hot, rows)
    within = [*keys, "_segment"] if hot is not None else keys
    along, back = Window.partitionBy(*within).orderBy(*order), Window.partitionBy(*within).orderBy(*[F.desc(c) for c in order])
    upto, before = along.rowsBetween(Window.unboundedPreceding, Window.currentRow), along.rowsBetween(Window.unboundedPreceding, -1)
    local = {
        "sum": lambda v: F.sum(v).over(upto), "max": lambda v: F.max(v).over(upto), "max_before": lambda v: F.max(v).over(before), "next": lambda v: F.lead(v).over(along),
        "min_from": lambda v: F.min(v).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    }
    out = df.select("*", *[local[how](F.col(f"_v_{name}")).alias(f"_l_{name}") for name, (how, _) in wanted.items()])
    kept = [c for c in df.columns if c not in values and c != "_segment"]
    if hot is None:
        return out.select(*kept, *[F.col(f"_l_{name}").alias(name) for name in wanted])
    first = F.struct(*order)
    total = {"sum": F.sum, "max": F.max, "max_before": F.max, "next": lambda v: F.min_by(v, first), "min_from": F.min}
    tops = df.where("_segment is not null").groupBy(*keys, "_segment").agg(*[total[how](F.col(f"_v_{name}")).alias(f"_t_{name}") for name, (how, _) in wanted.items()])
    segments = Window.partitionBy(*keys).orderBy("_segment")
    earlier, later = segments.rowsBetween(Window.unboundedPreceding, -1), segments.rowsBetween(1, Window.unboundedFollowing)
    carry = {"sum": lambda v: F.sum(v).over(earlier), "max": lambda v: F.max(v).over(earlier), "max_before": lambda v: F.max(v).over(earlier), "next": lambda v: F.lead(v).over(segments), "min_from": lambda v: F.min(v).over(later)}
    carried = _prefixed(tops.select(*keys, "_segment", *[carry[how](F.col(f"_t_{name}")).alias(f"_c_{name}") for name, (how, _) in wanted.items()]), [*keys, "_segment"])
    met = out.join(F.broadcast(carried), _same(out, carried, [*keys, "_segment"]), "left")
    both = {
        "sum": lambda a, b: F.when(b.isNull(), a).otherwise(F.coalesce(a, F.lit(0)) + b), "max": lambda a, b: F.greatest(a, b), "max_before": lambda a, b: F.greatest(a, b),
        "next": lambda a, b: F.coalesce(a, b), "min_from": lambda a, b: F.least(a, b),
    }
    return met.select(*[out[c] for c in kept], *[both[how](F.col(f"_l_{name}"), F.col(f"_c_{name}")).alias(name) for name, (how, _) in wanted.items()])
