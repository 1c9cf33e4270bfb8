"""Column profiles and verification facts of whole tables.

Both are a few aggregates over all columns at once. Distinct counts are register maxima:
a table is unpivoted to (column, register, rank) and only the maxima are shuffled, at most
registers x columns rows from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.functions import values as V
from tallyvane.session import shared_path, spread

PROFILE_REGISTERS = 1 << 14
FACT_REGISTERS = 1 << 7
K = 10


def is_flat(df: DataFrame) -> bool:
    """Whether no column is nested; nested tables get an opaque description."""
    return not any(isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) for f in df.schema)


def declared_type(kind: T.DataType) -> str:
    """Profile type of a declared column type."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.FloatType | T.DoubleType):
        return "float"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return "timestamp"
    return "string"


def fact_kind(kind: T.DataType) -> str:
    """Facts type of a declared column type."""
    if isinstance(kind, T.NullType):
        return "unknown"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, T.BinaryType):
        return "binary"
    told = declared_type(kind)
    return "datetime" if told == "timestamp" else told


def ruled(df: DataFrame, rename: dict[str, str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """df without dropped columns, others renamed; dropped columns are never read."""
    return df.drop(*(drop or [])).withColumnsRenamed(rename or {})


def cells(df: DataFrame, canonical: bool = False) -> DataFrame:
    """(ordinal, name, value): one row per cell, values as text or as canonical bytes of their type."""
    structs = []
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        value = V.canonical_scalar(c, f.dataType) if canonical else c.cast("string")
        structs.append(F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("name"), value.alias("value")))
    return df.select(F.inline(F.array(*structs)))


def null_counts(df: DataFrame) -> DataFrame:
    """(ordinal, name, rows, nulls), from one aggregate over all columns."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    structs = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("name"), F.col("rows"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)]
    return one.select(F.inline(F.array(*structs))) if df.columns else one.select(F.lit(0).alias("ordinal"), F.lit("").alias("name"), "rows", F.lit(0).alias("nulls")).limit(0)


def profile_registers(long: DataFrame) -> DataFrame:
    """(ordinal, register, rank) maxima of 2**14 registers over the non-null values of `cells`."""
    word = V.hash_word(F.col("value").cast("binary"))
    # Projections on one another, so that a cell is hashed and read as a number once.
    numbers = long.where("value is not null").select("ordinal", F.conv(word, 16, -10).cast("bigint").alias("word"))
    parts = numbers.select("ordinal", F.shiftrightunsigned("word", 50).cast("int").alias("register"), F.col("word").bitwiseAND(F.lit((1 << 50) - 1)).alias("rest"))
    return parts.groupBy("ordinal", "register").agg(F.max(51 - V.bit_length(F.col("rest"), 50)).alias("rank"))


def profile_estimate(registers: DataFrame) -> DataFrame:
    """(ordinal, estimate): the raw estimate, or linear counting up to 2.5 m while registers are empty."""
    m = PROFILE_REGISTERS
    per = registers.groupBy("ordinal").agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("part"), F.count("*").alias("full"))
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("part") + (m - F.col("full")))
    linear = m * F.log(m / (m - F.col("full")))
    return per.select("ordinal", F.when((raw <= 2.5 * m) & (F.col("full") < m), linear).otherwise(raw).alias("estimate"))


def profile(df: DataFrame, rename: dict[str, str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """(ordinal, name, type, row_count, null_rate_pct, distinct_bucket): one row per kept column.

    A table with nested columns gives no rows.
    """
    kept = ruled(df, rename, drop)
    kept = spread(kept) if kept.columns else kept
    if not is_flat(df):
        kept = kept.select().limit(0)
    types = df.sparkSession.createDataFrame([(i, declared_type(f.dataType)) for i, f in enumerate(kept.schema)], "ordinal int, type string")
    counts, estimates = null_counts(kept), profile_estimate(profile_registers(cells(kept))) if kept.columns else None
    if estimates is None:
        return counts.select("ordinal", "name", F.lit("").alias("type"), F.col("rows").alias("row_count"), F.lit(0).alias("null_rate_pct"), F.lit("1").alias("distinct_bucket")).limit(0)
    return (
        counts.join(F.broadcast(types), "ordinal")
        .join(estimates, "ordinal", "left")
        .select(
            "ordinal",
            "name",
            "type",
            F.col("rows").alias("row_count"),
            V.null_rate_5pct(F.col("nulls"), F.col("rows")).alias("null_rate_pct"),
            V.distinct_bucket(F.coalesce("estimate", F.lit(0.0))).alias("distinct_bucket"),
        )
    )


def first_values_type(df: DataFrame, order: list[str], n: int = 10_000) -> DataFrame:
    """(name, type): promoted type of each column's first n non-null text values, in the order of a row key.

    The first n rows by key of each column come from a top-n per column over narrow rows.
    """
    kinds = []
    for c in [c for c in df.columns if c not in order]:
        first = df.select(*order, F.col(f"`{c}`").cast("string").alias("value")).where("value is not null").orderBy(*order).limit(n)
        kinds.append(first.agg(V.promoted(V.profile_type(F.col("value")), "string").alias("type")).select(F.lit(c).alias("name"), "type"))
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionAll(k)
    return out


def fact_registers(long: DataFrame, seed_hex: str) -> DataFrame:
    """(ordinal, register, rank) maxima of 128 registers over seed, column, 0 and the canonical bytes of `cells`."""
    preimage = F.concat(F.unhex(F.lit(seed_hex)), F.unhex(F.lpad(F.hex(F.col("ordinal").cast("bigint")), 8, "0")), F.unhex(F.lit("00")), F.col("value").cast("binary"))
    numbers = long.where("value is not null").select("ordinal", F.conv(V.hash_word(preimage), 16, -10).cast("bigint").alias("word"))
    # The lowest seven bits name the register, the 57 above them are ranked.
    parts = numbers.select("ordinal", F.col("word").bitwiseAND(F.lit(127)).cast("int").alias("register"), F.shiftrightunsigned("word", 7).alias("rest"))
    return parts.groupBy("ordinal", "register").agg(F.max(58 - V.bit_length(F.col("rest"), 57)).alias("rank"))


def fact_estimate(registers: DataFrame) -> DataFrame:
    """(ordinal, estimate LONG, full): linear counting while any register is empty; ties to even."""
    m = FACT_REGISTERS
    per = registers.groupBy("ordinal").agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("part"), F.count("*").alias("full"))
    raw = F.lit(0.7213 / (1 + 1.079 / 128) * 128 * 128) / F.col("part")
    linear = m * F.log(m / (m - F.col("full")))
    return per.select("ordinal", F.bround(F.when(F.col("full") < m, linear).otherwise(raw)).cast("bigint").alias("estimate"), "full")


def distinct_gate(df: DataFrame, registers: DataFrame, k: int = K) -> DataFrame:
    """(ordinal, exact): distinct values, capped at k. k full registers prove k values; only the
    other columns, named by a bounded list, are counted exactly."""
    full = {r["ordinal"]: r["n"] for r in registers.groupBy("ordinal").agg(F.count("*").alias("n")).collect()}
    counts = [F.lit(k) if full.get(i, 0) >= k else F.least(F.lit(k), F.count_distinct(F.col(f"`{c}`"))) for i, c in enumerate(df.columns)]
    one = df.agg(*[c.cast("int").alias(f"e{i}") for i, c in enumerate(counts)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.col(f"e{i}").alias("exact")) for i in range(len(counts))])))


def column_aggregates(df: DataFrame) -> DataFrame:
    """(ordinal, name, rows, nulls, lengths, numeric): counts and histograms of all columns in one aggregate.

    lengths for text and binary, numeric for numbers, null otherwise.
    """
    aggs, structs = [], []
    for i, f in enumerate(df.schema):
        kind, c = fact_kind(f.dataType), F.col(f"`{f.name}`")
        lengths, numeric = F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<bigint>")
        aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
        if kind in ("string", "binary"):
            bucket = V.length_bucket(F.octet_length(c))
            aggs += [F.count_if(c.isNotNull() & (bucket == b)).alias(f"l{i}_{b}") for b in range(10)]
            lengths = F.array(*[F.col(f"l{i}_{b}") for b in range(10)])
        elif kind in ("integer", "float", "decimal"):
            bucket = V.numeric_bucket(c)
            aggs += [F.count_if(c.isNotNull() & (bucket == b)).alias(f"m{i}_{b}") for b in range(8)]
            numeric = F.array(*[F.col(f"m{i}_{b}") for b in range(8)])
        told = [F.lit(i).alias("ordinal"), F.lit(f.name).alias("name"), F.col("rows"), F.col(f"n{i}").alias("nulls")]
        structs.append(F.struct(*told, lengths.alias("lengths"), numeric.alias("numeric")))
    return df.agg(F.count("*").alias("rows"), *aggs).select(F.inline(F.array(*structs)))


def histograms(df: DataFrame) -> DataFrame:
    """(ordinal, lengths, numeric): counts per bucket of text and binary, and of numeric columns."""
    return column_aggregates(df).select("ordinal", "lengths", "numeric")


def facts(df: DataFrame, seed_hex: str, k: int = K) -> DataFrame:
    """Publishable facts per column: what could tell a group smaller than k is null.

    (ordinal, name, type, rows, null_rate, estimate, lengths, numeric)
    """
    types = df.sparkSession.createDataFrame([(i, fact_kind(f.dataType)) for i, f in enumerate(df.schema)], "ordinal int, type string")
    df = spread(df)
    # At most 128 rows per column; written so that gate and estimate share one scan.
    path = shared_path(df.sparkSession, "registers")
    fact_registers(cells(df, canonical=True), seed_hex).write.parquet(path)
    registers = df.sparkSession.read.schema("ordinal int, register int, rank int").parquet(path)
    joined = (
        column_aggregates(df)
        .join(F.broadcast(types), "ordinal")
        .join(fact_estimate(registers), "ordinal", "left")
        .join(distinct_gate(df, registers, k), "ordinal")
    )
    return suppressed(joined, k)


def suppressed(raw: DataFrame, k: int = K) -> DataFrame:
    """Facts with low-occupancy values nulled."""
    rows, nulls, estimate = F.col("rows"), F.col("nulls"), F.coalesce("estimate", F.lit(0)).cast("bigint")
    few = lambda n: (n > 0) & (n < k)
    rate_ok = (rows >= k) & ~few(nulls) & ~few(rows - nulls) & ~V.rate_ambiguous(nulls, rows)
    distinct_ok = (rows >= k) & F.col("exact").isin(0, k) & ~((estimate > 0) & (estimate < k))
    clear = lambda h: F.when((rows >= k) & ~F.exists(h, few), h)
    return raw.select(
        "ordinal",
        "name",
        "type",
        "rows",
        F.when(rate_ok, V.rate_text(V.rate_ppm(nulls, rows))).alias("null_rate"),
        F.when(distinct_ok, estimate).alias("estimate"),
        clear(F.col("lengths")).alias("lengths"),
        clear(F.col("numeric")).alias("numeric"),
    )
