"""Scalar rules for profiles and facts, as Column factories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for null in typed cells of the facts.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null"]
#: Upper bounds of the length histogram, lower-inclusive bounds of the numeric one.
LENGTH_BOUNDS = [0, 1, 4, 8, 16, 32, 64, 128, 256]
NUMERIC_BOUNDS = [-1000, -100, -10, 0, 10, 100, 1000]

INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan)|0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+)$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.,][0-9]+)?(Z|[+-]([01][0-9]|2[0-4]):[0-5][0-9])$"
NAIVE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.,][0-9]+)?$"


def _is_date(text: Column) -> Column:
    return F.coalesce(text.rlike(DATE) & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def _is_int64(text: Column) -> Column:
    return F.coalesce(text.rlike(INTEGER) & text.try_cast("bigint").isNotNull(), F.lit(False))


def _dated(text: Column, pattern: str) -> Column:
    return text.rlike(pattern) & _is_date(F.substring(text, 1, 10))


def _in_range(text: Column) -> Column:
    """A decimal float that a double can hold (overflow refuses)."""
    value = text.try_cast("double")
    named = F.lower(text).rlike("inf|nan") | F.lower(text).contains("0x")
    return named | (value.isNotNull() & (F.abs(value) != F.lit(float("inf"))))


def profile_type(text: Column) -> Column:
    """Type of a text cell in a column profile; null stays null."""
    return (
        F.when(text.isNull(), None)
        .when(text.isin("true", "false"), "boolean")
        .when(_is_int64(text), "integer")
        .when(text.rlike(FLOAT) & _in_range(text), "float")
        .when(_is_date(text), "date")
        .when(_dated(text, RFC3339), "timestamp")
        .otherwise("string")
    )


def fact_type(text: Column) -> Column:
    """Type of a delimited cell in the facts; null tokens are unknown."""
    v = F.trim(text)
    return (
        F.when(text.isNull() | text.isin(*NULL_TOKENS), "unknown")
        .when(v.isin("true", "false", "True", "False", "TRUE", "FALSE"), "boolean")
        .when(_is_int64(v) & ~v.startswith("+"), "integer")
        .when(v.rlike(FLOAT), "float")
        .when(_is_date(v), "date")
        .when(_dated(v, RFC3339) | _dated(v, NAIVE), "datetime")
        .otherwise("string")
    )


def promoted(kind: Column, empty: str) -> Column:
    """Aggregate: the promoted type of many cells' types. `empty` if none has one."""
    kinds = F.array_sort(F.collect_set(F.when(kind != "unknown", kind)))
    return (
        F.when(F.size(kinds) == 0, empty)
        .when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))
        .when(kinds == F.array(F.lit("float"), F.lit("integer")), "float")
        .otherwise("string")
    )


def null_rate_5pct(nulls: Column, rows: Column) -> Column:
    """Null rate in per cent, rounded to the nearest 5; null for no rows."""
    return F.when(rows > 0, 5 * F.floor((40 * nulls + rows) / (2 * rows))).cast("int")


def rate_ppm(nulls: Column, rows: Column) -> Column:
    """Null rate in millionths, ties to even (exact in decimals)."""
    scaled = (nulls.cast("decimal(20,0)") * 1_000_000).cast("decimal(38,0)")
    rest = scaled % rows.cast("decimal(20,0)")
    q = ((scaled - rest) / rows.cast("decimal(20,0)")).cast("bigint")
    twice = 2 * rest - rows.cast("decimal(20,0)")
    return q + F.when((twice > 0) | ((twice == 0) & (q % 2 != 0)), 1).otherwise(0)


def rate_text(ppm: Column) -> Column:
    return F.concat(F.floor(ppm / 1_000_000).cast("string"), F.lit("."), F.lpad((ppm % 1_000_000).cast("string"), 6, "0"))


def rate_ambiguous(nulls: Column, rows: Column) -> Column:
    """Whether a count of 1 to 9 nulls or 1 to 9 values would print the same rate."""
    told = rate_ppm(nulls, rows)
    few = [F.lit(k).cast("bigint") for k in range(1, 10)]
    same = F.lit(False)
    for k in few:
        same = same | ((k <= rows) & (rate_ppm(k, rows) == told)) | ((rows - k >= 0) & (rate_ppm(rows - k, rows) == told))
    return same


def length_bucket(n: Column) -> Column:
    """Bucket 0 to 9 of a length in bytes."""
    return sum((F.when(n > b, 1).otherwise(0) for b in LENGTH_BOUNDS[1:]), F.when(n > LENGTH_BOUNDS[0], 1).otherwise(0))


def numeric_bucket(value: Column) -> Column:
    """Bucket 0 to 7 of a number."""
    return sum((F.when(value >= b, 1).otherwise(0) for b in NUMERIC_BOUNDS[1:]), F.when(value >= NUMERIC_BOUNDS[0], 1).otherwise(0))


def distinct_bucket(estimate: Column) -> Column:
    return F.when(estimate <= 1.5, "1").when(estimate <= 10.5, "2-10").when(estimate <= 100.5, "11-100").when(estimate <= 1000.5, "101-1000").otherwise(">1000")


def hash_word(bytes_: Column) -> Column:
    """First 16 hex digits of a SHA-256."""
    return F.substring(F.sha2(bytes_, 256), 1, 16)


def bit_length(value: Column, most: int) -> Column:
    """Bits of a number of at most `most` bits, by comparisons from the top: two on average if its bits are random."""
    told = F.when(value >= 1 << (most - 1), most)
    for n in range(most - 1, 0, -1):
        told = told.when(value >= 1 << (n - 1), n)
    return told.otherwise(0)


def _float_text(value: Column) -> Column:
    """Shortest text of a double: plain from 1e-4 up to 1e16 (with a point), else with an exponent of two digits or more."""
    short = value.cast("string")
    plain = F.regexp_replace(short.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(short, "E", 1), r"\.0$", "")
    power = F.substring_index(short, "E", -1).try_cast("int")
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    size = F.abs(value)
    return F.when((size != 0) & ((size < 1e-4) | (size >= 1e16)), F.concat(mantissa, exponent)).otherwise(plain)


def _quoted(text: Column) -> Column:
    """JSON text; control characters without a short escape are written in lower-case hex."""
    json = F.to_json(F.struct(text.alias("v")))
    out = json.substr(F.lit(6), F.length(json) - 6)
    lowered = out
    for c in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        lowered = F.replace(lowered, F.lit(f"\\u{c:04X}"), F.lit(f"\\u{c:04x}"))
    return F.when(text.rlike(r"[\x0B\x0E\x0F\x1A-\x1F]"), lowered).otherwise(out)


def canonical_scalar(value: Column, data_type: T.DataType) -> Column:
    """Canonical bytes of a typed value, as facts hash them; null stays null. NaN and infinities become null."""
    if isinstance(data_type, T.BinaryType):
        return F.concat(F.lit("bytes:").cast("binary"), value)
    if isinstance(data_type, T.FloatType | T.DoubleType):
        number = value.cast("double")
        text = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), _float_text(number))
    elif isinstance(data_type, T.DecimalType):
        text = F.concat(F.lit("decimal:"), value.cast("string"))
    elif isinstance(data_type, T.DateType):
        text = F.concat(F.lit("time:"), F.date_format(value, "yyyy-MM-dd"))
    elif isinstance(data_type, T.TimestampType | T.TimestampNTZType):
        micros = F.date_format(value, "SSSSSS")
        zone = "+00:00" if isinstance(data_type, T.TimestampType) else ""
        fraction = F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise("")
        text = F.concat(F.lit("time:"), F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit(zone))
    elif isinstance(data_type, T.StringType):
        text = F.when(value.isNotNull(), _quoted(value))
    else:
        text = value.cast("string")
    return text.cast("binary")
