"""Registered queries over profiles, facts and the content census."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.functions import content as C
from tallyvane.functions import values as V
from tallyvane.operators import census, profile
from tallyvane.session import spread

from .registry import query, table

SEED = "11" * 32
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def _long_sql(table_name: str, columns: list[str], shown: dict[str, str] | None = None) -> str:
    parts = [f"SELECT {i} AS ordinal, '{(shown or {}).get(c, c)}' AS name, {c}::VARCHAR AS value FROM {table_name}" for i, c in enumerate(columns)]
    return "\n UNION ALL ".join(parts)


def _profile_sql(table_name: str, columns: list[str], types: dict[str, str], shown: dict[str, str] | None = None) -> str:
    kinds = " ".join(f"WHEN {i} THEN '{types[c]}'" for i, c in enumerate(columns))
    return f"""
WITH long AS ({_long_sql(table_name, columns, shown)}),
h AS (SELECT ordinal, sha256(value) AS x FROM long WHERE value IS NOT NULL),
r AS (SELECT ordinal, ('0x' || substr(x, 1, 4))::INTEGER >> 2 AS reg, ('0x' || substr(x, 4, 13))::BIGINT & 1125899906842623 AS rest FROM h),
m AS (SELECT ordinal, reg, max(51 - CASE WHEN rest = 0 THEN 0 ELSE length(bin(rest)) END) AS rank FROM r GROUP BY ALL),
p AS (SELECT ordinal, sum(pow(2.0, -rank)) + 16384 - count(*) AS s, count(*) AS nz FROM m GROUP BY 1),
e AS (SELECT ordinal, CASE WHEN {0.7213 / (1 + 1.079 / 16384) * 16384 * 16384!r} / s <= 40960 AND nz < 16384 THEN 16384 * ln(16384.0 / (16384 - nz)) ELSE {0.7213 / (1 + 1.079 / 16384) * 16384 * 16384!r} / s END AS est FROM p),
c AS (SELECT ordinal, name, count(*) AS row_count, count(*) - count(value) AS nulls FROM long GROUP BY ALL)
SELECT ordinal, name, CASE ordinal {kinds} END AS type, row_count, (5 * ((40 * nulls + row_count) // (2 * row_count)))::INTEGER AS null_rate_pct,
  CASE WHEN coalesce(est, 0) <= 1.5 THEN '1' WHEN est <= 10.5 THEN '2-10' WHEN est <= 100.5 THEN '11-100' WHEN est <= 1000.5 THEN '101-1000' ELSE '>1000' END AS distinct_bucket
FROM c LEFT JOIN e USING (ordinal)"""


LINE_TYPES = dict(zip(LINE_COLUMNS, ["integer"] * 4 + ["float"] * 4 + ["string", "string", "timestamp"], strict=True))
ORDER_TYPES = dict(zip(ORDER_COLUMNS, ["integer", "integer", "string", "float", "timestamp", "string"], strict=True))


@query(_profile_sql("lineitem", LINE_COLUMNS, LINE_TYPES))
def profile_lineitem(spark, sf):
    """The column profile."""
    return profile.profile(table(spark, sf, "lineitem"))


_KEPT = [c for c in ORDER_COLUMNS if c != "o_totalprice"]


@query(_profile_sql("orders", _KEPT, ORDER_TYPES, {"o_orderstatus": "status"}))
def profile_orders_ruled(spark, sf):
    """The profile of a table with a dropped and a renamed column."""
    return profile.profile(table(spark, sf, "orders"), rename={"o_orderstatus": "status"}, drop=["o_totalprice"])


@query("SELECT ordinal, name, count(*) AS rows, count(*) - count(value) AS nulls FROM (" + _long_sql("(SELECT * REPLACE (CASE WHEN l_orderkey % 11 <> 0 THEN l_partkey END AS l_partkey, CASE WHEN l_orderkey % 7 = 0 THEN l_returnflag END AS l_returnflag) FROM lineitem)", LINE_COLUMNS) + ") GROUP BY ALL")
def null_counts_lineitem(spark, sf):
    """Rows and nulls per column."""
    return profile.null_counts(_with_nulls(table(spark, sf, "lineitem")))


def _with_nulls(df):
    return df.withColumn("l_partkey", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_partkey"))).withColumn("l_returnflag", F.when(F.col("l_orderkey") % 7 == 0, F.col("l_returnflag")))


@query("SELECT l_returnflag, l_linestatus, CASE WHEN nulls IS NULL THEN NULL ELSE (5 * ((40 * nulls + n) // (2 * n)))::INTEGER END AS pct FROM (SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_orderkey % 11 = 0) AS nulls FROM lineitem GROUP BY ALL)")
def null_rate_by_flag(spark, sf):
    """null rate to the nearest 5%, per group."""
    df = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_orderkey") % 11 == 0).alias("nulls"))
    return df.select("l_returnflag", "l_linestatus", V.null_rate_5pct(F.col("nulls"), F.col("n")).alias("pct"))


_TEXT_CELLS = """
(SELECT l_orderkey, l_linenumber, CASE l_orderkey % 14 WHEN 0 THEN l_quantity::BIGINT::VARCHAR WHEN 1 THEN '-' || l_partkey WHEN 2 THEN l_discount::VARCHAR WHEN 3 THEN strftime(l_shipdate, '%Y-%m-%d')
  WHEN 4 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 5 THEN 'true' WHEN 6 THEN ' 5' WHEN 7 THEN 'NaN' WHEN 8 THEN l_returnflag WHEN 9 THEN '9223372036854775808' WHEN 10 THEN '+7' WHEN 11 THEN '2023-02-30' WHEN 12 THEN 'N/A' ELSE 'TRUE' END AS v FROM lineitem)"""


def _text_cells(spark, sf):
    k = F.col("l_orderkey") % 14
    v = (
        F.when(k == 0, F.col("l_quantity").cast("bigint").cast("string")).when(k == 1, F.concat(F.lit("-"), F.col("l_partkey").cast("string")))
        .when(k == 2, F.col("l_discount").cast("string")).when(k == 3, F.date_format("l_shipdate", "yyyy-MM-dd"))
        .when(k == 4, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 5, "true").when(k == 6, " 5").when(k == 7, "NaN")
        .when(k == 8, F.col("l_returnflag")).when(k == 9, "9223372036854775808").when(k == 10, "+7").when(k == 11, "2023-02-30").when(k == 12, "N/A").otherwise("TRUE")
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))


_INT, _FLOAT = r"^[+-]?[0-9]+$", r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
_DATE_SQL = "(regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({v} AS DATE) IS NOT NULL)"
_STAMP_SQL = "(regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]+)?Z') AND try_cast(left({v}, 10) AS DATE) IS NOT NULL)"
_PROFILE_TYPE = f"CASE WHEN v IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(v, '{_INT}') AND try_cast(v AS BIGINT) IS NOT NULL THEN 'integer' WHEN regexp_matches(v, '{_FLOAT}') THEN 'float' WHEN {_DATE_SQL.format(v='v')} THEN 'date' WHEN {_STAMP_SQL.format(v='v')} THEN 'timestamp' ELSE 'string' END"
_TOKENS = ", ".join(f"'{t}'" for t in V.NULL_TOKENS)
_FACT_TYPE = f"CASE WHEN v IN ({_TOKENS}) THEN 'unknown' WHEN trim(v) IN ('true', 'false', 'True', 'False', 'TRUE', 'FALSE') THEN 'boolean' WHEN regexp_matches(trim(v), '{_INT}') AND try_cast(trim(v) AS BIGINT) IS NOT NULL AND NOT starts_with(trim(v), '+') THEN 'integer' WHEN regexp_matches(trim(v), '{_FLOAT}') THEN 'float' WHEN {_DATE_SQL.format(v='trim(v)')} THEN 'date' WHEN {_STAMP_SQL.format(v='trim(v)')} THEN 'datetime' ELSE 'string' END"


@query(f"SELECT {_PROFILE_TYPE} AS profile_type, {_FACT_TYPE} AS fact_type, count(*) AS n FROM {_TEXT_CELLS} GROUP BY ALL")
def cell_types(spark, sf):
    """inferred types of text cells."""
    v = F.col("v")
    return _text_cells(spark, sf).groupBy(V.profile_type(v).alias("profile_type"), V.fact_type(v).alias("fact_type")).agg(F.count("*").alias("n"))


@query(f"""WITH k AS (SELECT l_linenumber AS grp, {_PROFILE_TYPE} AS t FROM {_TEXT_CELLS} WHERE l_orderkey % 14 IN (0, 2, 12) AND (l_linenumber > 2 OR l_orderkey % 14 = 0) AND (l_linenumber <> 4 OR l_orderkey % 14 <> 12))
SELECT grp, CASE WHEN count(DISTINCT t) = 1 THEN min(t) WHEN count(DISTINCT t) = count(DISTINCT t) FILTER (t IN ('integer', 'float')) THEN 'float' ELSE 'string' END AS type FROM k GROUP BY 1""")
def promoted_types(spark, sf):
    """types of groups of cells, promoted."""
    k, g = F.col("l_orderkey") % 14, F.col("l_linenumber")
    some = _text_cells(spark, sf).where(k.isin(0, 2, 12) & ((g > 2) | (k == 0)) & ((g != 4) | (k != 12)))
    return some.groupBy(g.alias("grp")).agg(V.promoted(V.profile_type(F.col("v")), "string").alias("type"))


@query("""WITH p AS (SELECT 'o_custkey' AS name, o_custkey::VARCHAR AS v, o_orderkey FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_orderkey FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus, o_orderkey FROM orders UNION ALL SELECT 'mixed', CASE WHEN o_orderkey > (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 1 OFFSET 9999) THEN 'x' ELSE o_custkey::VARCHAR END, o_orderkey FROM orders),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY name ORDER BY o_orderkey) <= 10000)
SELECT name, CASE WHEN bool_and(regexp_matches(v, '^[0-9]+$')) THEN 'integer' ELSE 'string' END AS type FROM f GROUP BY 1""")
def first_values_types(spark, sf):
    """Types by each column's first 10,000 values in key order."""
    orders = table(spark, sf, "orders")
    last = orders.orderBy("o_orderkey").limit(10_000).agg(F.max("o_orderkey")).scalar()
    mixed = F.when(F.col("o_orderkey") > last, "x").otherwise(F.col("o_custkey").cast("string"))
    return profile.first_values_type(orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", mixed.alias("mixed")), ["o_orderkey"])


_PPM = "CASE WHEN 2 * ((c * 1000000) % n) > n OR (2 * ((c * 1000000) % n) = n AND ((c * 1000000) // n) % 2 = 1) THEN (c * 1000000) // n + 1 ELSE (c * 1000000) // n END"


def _ppm(c: str, n: str = "n") -> str:
    return "(" + _PPM.replace("c *", f"({c}) *").replace("% n)", f"% {n})").replace("> n ", f"> {n} ").replace("= n ", f"= {n} ").replace("// n", f"// {n}") + ")"


@query(f"""WITH g AS (SELECT l_suppkey AS grp, count(*)::HUGEINT AS n, count(*) FILTER (l_orderkey % 11 = 0)::HUGEINT AS c FROM lineitem GROUP BY 1),
r AS (SELECT grp, n, c, {_ppm('c')} AS ppm, list_bool_or(list_transform(range(1, 10), lambda k: (k <= n AND {_ppm('k')} = {_ppm('c')}) OR (n - k >= 0 AND {_ppm('n - k')} = {_ppm('c')}))) AS ambiguous FROM g)
SELECT grp, n::BIGINT AS rows, c::BIGINT AS nulls, (ppm // 1000000)::VARCHAR || '.' || lpad((ppm % 1000000)::VARCHAR, 6, '0') AS rate, ambiguous FROM r""")
def null_rates_ppm(spark, sf):
    """Null rates in millionths, and whether they give a small group away."""
    n, c = F.col("rows"), F.col("nulls")
    df = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("grp")).agg(F.count("*").alias("rows"), F.count_if(F.col("l_orderkey") % 11 == 0).alias("nulls"))
    return df.select("grp", "rows", "nulls", V.rate_text(V.rate_ppm(c, n)).alias("rate"), V.rate_ambiguous(c, n).alias("ambiguous"))


_FACT_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_FACT_LONG = _long_sql("(SELECT * REPLACE ('\"' || o_orderstatus || '\"' AS o_orderstatus, '\"' || o_orderpriority || '\"' AS o_orderpriority) FROM orders)", _FACT_COLUMNS)


@query(f"""WITH long AS ({_FACT_LONG}),
h AS (SELECT ordinal, sha256(unhex('{SEED}' || lpad(hex(ordinal), 8, '0') || '00') || encode(value)) AS x FROM long),
r AS (SELECT ordinal, ('0x' || substr(x, 15, 2))::INTEGER & 127 AS reg, ('0x' || substr(x, 1, 14))::BIGINT * 2 + (('0x' || substr(x, 15, 2))::INTEGER >> 7) AS rest FROM h),
m AS (SELECT ordinal, reg, max(58 - CASE WHEN rest = 0 THEN 0 ELSE length(bin(rest)) END) AS rank FROM r GROUP BY ALL),
e AS (SELECT ordinal, count(*) AS nz, CASE WHEN count(*) < 128 THEN 128 * ln(128.0 / (128 - count(*))) ELSE {0.7213 / (1 + 1.079 / 128) * 128 * 128!r} / sum(pow(2.0, -rank)) END AS est FROM m GROUP BY 1),
d AS (SELECT ordinal, least(10, count(DISTINCT value)) AS exact FROM long GROUP BY 1)
SELECT ordinal, round_even(est, 0)::BIGINT AS estimate, nz AS "full", exact::INTEGER AS exact FROM e JOIN d USING (ordinal)""")
def fact_sketches(spark, sf):
    """Seeded 128-register sketches and the capped exact count."""
    df = spread(table(spark, sf, "orders").select(*_FACT_COLUMNS))
    registers = profile.fact_registers(profile.cells(df, canonical=True), SEED)
    return profile.fact_estimate(registers).join(profile.distinct_gate(df, registers), "ordinal")


_LEN = " ".join(f"WHEN strlen(v) <= {b} THEN {i}" for i, b in enumerate(V.LENGTH_BOUNDS))
_NUM = " ".join(f"WHEN v < {b} THEN {i}" for i, b in enumerate(V.NUMERIC_BOUNDS))


@query("""SELECT kind, v, count(*) AS n FROM (SELECT 'float' AS kind, l_extendedprice::VARCHAR AS v FROM lineitem UNION ALL SELECT 'integer', l_suppkey::VARCHAR FROM lineitem UNION ALL SELECT 'time', 'time:' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') FROM lineitem UNION ALL SELECT 'text', '"' || replace(props, '"', '\\"') || '"' FROM events) GROUP BY ALL""".replace("\\\\", "\\"))
def canonical_values(spark, sf):
    """canonical bytes of typed values."""
    line, events = table(spark, sf, "lineitem"), table(spark, sf, "events")
    line = line.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    parts = []
    for kind, df, name in (("float", line, "l_extendedprice"), ("integer", line, "l_suppkey"), ("time", line, "l_shipdate"), ("text", events, "props")):
        parts.append(df.select(F.lit(kind).alias("kind"), V.canonical_scalar(F.col(name), df.schema[name].dataType).cast("string").alias("v")))
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).groupBy("kind", "v").agg(F.count("*").alias("n"))


@query(f"""SELECT bucket, sum(lengths)::BIGINT AS lengths, sum(numeric)::BIGINT AS numeric FROM (
SELECT CASE {_LEN} ELSE 9 END AS bucket, 1 AS lengths, 0 AS numeric FROM (SELECT text AS v FROM documents)
UNION ALL SELECT CASE {_NUM} ELSE 7 END, 0, 1 FROM (SELECT c_acctbal AS v FROM customer)) GROUP BY 1""")
def value_buckets(spark, sf):
    """Length and numeric buckets."""
    lengths = table(spark, sf, "documents").select(V.length_bucket(F.octet_length("text")).alias("bucket"), F.lit(1).alias("lengths"), F.lit(0).alias("numeric"))
    numbers = table(spark, sf, "customer").select(V.numeric_bucket(F.col("c_acctbal")).alias("bucket"), F.lit(0).alias("lengths"), F.lit(1).alias("numeric"))
    return lengths.unionAll(numbers).groupBy("bucket").agg(F.sum("lengths").alias("lengths"), F.sum("numeric").alias("numeric"))


def _counts(expr: str, n: int) -> str:
    return "[" + ", ".join(f"count(*) FILTER ({expr} = {i})" for i in range(n)) + "]"


@query(f"""SELECT 0 AS ordinal, NULL::BIGINT[] AS lengths, {_counts(f"CASE {_NUM.replace('v <', 'c_acctbal <')} ELSE 7 END", 8)} AS numeric FROM customer
UNION ALL SELECT 1, {_counts(f"CASE {_LEN.replace('(v)', '(c_mktsegment)')} ELSE 9 END", 10)}, NULL FROM customer""")
def histograms_customer(spark, sf):
    """Length and numeric histograms as arrays."""
    return profile.histograms(table(spark, sf, "customer").select("c_acctbal", "c_mktsegment"))


@query(f"""WITH base AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS a, c_nationkey AS b, CASE WHEN c_custkey % 400 = 1 THEN 1 END AS c FROM customer),
long AS ({_long_sql('base', ['a', 'b', 'c'])}),
h AS (SELECT ordinal, sha256(unhex('{SEED}' || lpad(hex(ordinal), 8, '0') || '00') || encode(CASE ordinal WHEN 0 THEN '"' || value || '"' ELSE value END)) AS x FROM long WHERE value IS NOT NULL),
r AS (SELECT ordinal, ('0x' || substr(x, 15, 2))::INTEGER & 127 AS reg, ('0x' || substr(x, 1, 14))::BIGINT * 2 + (('0x' || substr(x, 15, 2))::INTEGER >> 7) AS rest FROM h),
e AS (SELECT ordinal, round_even(128 * ln(128.0 / (128 - count(DISTINCT reg))), 0)::BIGINT AS est FROM r GROUP BY 1),
s AS (SELECT ordinal, name, count(*)::HUGEINT AS n, (count(*) - count(value))::HUGEINT AS c, count(DISTINCT value) AS d FROM long GROUP BY ALL),
q AS (SELECT *, {_ppm('c')} AS ppm, list_bool_or(list_transform(range(1, 10), lambda k: (k <= n AND {_ppm('k')} = {_ppm('c')}) OR (n - k >= 0 AND {_ppm('n - k')} = {_ppm('c')}))) AS amb FROM s LEFT JOIN e USING (ordinal)),
hist AS (SELECT 0 AS ordinal, {_counts(f"CASE WHEN a IS NOT NULL THEN CASE {_LEN.replace('(v)', '(a)')} ELSE 9 END END", 10)} AS lengths, NULL::BIGINT[] AS numeric FROM base
 UNION ALL SELECT 1, NULL, {_counts(f"CASE {_NUM.replace('v <', 'b <')} ELSE 7 END", 8)} FROM base
 UNION ALL SELECT 2, NULL, {_counts(f"CASE WHEN c IS NOT NULL THEN CASE {_NUM.replace('v <', 'c <')} ELSE 7 END END", 8)} FROM base)
SELECT ordinal, name, CASE ordinal WHEN 0 THEN 'string' ELSE 'integer' END AS type, n::BIGINT AS rows,
 CASE WHEN n >= 10 AND NOT (c > 0 AND c < 10) AND NOT (n - c > 0 AND n - c < 10) AND NOT amb THEN (ppm // 1000000)::VARCHAR || '.' || lpad((ppm % 1000000)::VARCHAR, 6, '0') END AS null_rate,
 CASE WHEN n >= 10 AND (d = 0 OR d >= 10) AND NOT (coalesce(est, 0) BETWEEN 1 AND 9) THEN coalesce(est, 0) END AS estimate,
 CASE WHEN n >= 10 AND len(list_filter(lengths, lambda x: x > 0 AND x < 10)) = 0 THEN lengths END AS lengths,
 CASE WHEN n >= 10 AND len(list_filter(numeric, lambda x: x > 0 AND x < 10)) = 0 THEN numeric END AS numeric
FROM q JOIN hist USING (ordinal)""")
def facts_customer(spark, sf):
    """Facts with low-occupancy suppression."""
    k = F.col("c_custkey")
    df = table(spark, sf, "customer").select(
        F.when(k % 3 == 0, F.col("c_mktsegment")).alias("a"), F.col("c_nationkey").alias("b"), F.when(k % 400 == 1, F.lit(1)).alias("c")
    )
    return profile.facts(df, SEED)


_DOC_CLASS = """CASE WHEN length(t) = 0 THEN 'empty' WHEN starts_with(s, '<') THEN 'html_xml'
 WHEN json_valid(line) AND (starts_with(line, '{') OR starts_with(line, '[')) THEN CASE WHEN contains(s, chr(10)) THEN 'table_like_jsonl' ELSE 'json_document' END
 WHEN contains(line, chr(9)) THEN 'table_like_tsv' WHEN contains(line, ',') THEN 'table_like_csv'
 WHEN starts_with(s, '# ') OR starts_with(s, '## ') THEN 'markdown'
 WHEN regexp_matches(s, '^(package |import |def |function |#include|//|#!/)') THEN 'source_code' ELSE 'plain_text' END"""
_DOCS = r"(SELECT *, split_part(s, chr(10), 1) AS line FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') AS s FROM documents))"
_LET = r"length(regexp_replace(t, '[^\p{L}]', '', 'g'))"


def _script_n(names: list[str]) -> str:
    inner = "".join(r"\p{" + n + "}" for n in names)
    return rf"length(regexp_replace(t, '[^{inner}]', '', 'g'))"


_SCRIPT = f"""CASE WHEN greatest(la, cy, cj, ar, ot) = 0 THEN 'other' WHEN la >= greatest(cy, cj, ar, ot) THEN 'latin' WHEN cy >= greatest(cj, ar, ot) THEN 'cyrillic' WHEN cj >= greatest(ar, ot) THEN 'cjk' WHEN ar >= ot THEN 'arabic' ELSE 'other' END
FROM (SELECT *, le - la - cy - cj - ar AS ot FROM (SELECT *, {_LET} AS le, {_script_n(['Latin'])} AS la, {_script_n(['Cyrillic'])} AS cy, {_script_n(['Han', 'Hiragana', 'Katakana', 'Hangul'])} AS cj, {_script_n(['Arabic'])} AS ar FROM {_DOCS}))"""


@query(f"SELECT doc_id AS id, {_DOC_CLASS} AS class, 'utf8' AS encoding, {_SCRIPT.replace('FROM (SELECT *, le', 'AS script FROM (SELECT *, le', 1)}")
def content_labels(spark, sf):
    """Class, encoding and script of every document."""
    return census.findings(table(spark, sf, "documents")).select("id", "class", "encoding", "script")


@query("""WITH x AS (SELECT 'documents' AS src, text AS t FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'events', props FROM events),
y AS (SELECT src, coalesce(t, '') AS t, rtrim(split_part(coalesce(t, ''), chr(10), 1), chr(13)) AS line FROM x)
SELECT src, CASE WHEN length(line) = 0 THEN 'application/octet-stream' WHEN json_valid(line) AND regexp_matches(line, '^\\s*[{\\[]') THEN 'application/x-ndjson' WHEN contains(line, chr(9)) THEN 'text/tab-separated-values' WHEN contains(line, ',') THEN 'text/csv' ELSE 'application/octet-stream' END AS media_type, count(*) AS n FROM y GROUP BY ALL""".replace("\\\\", "\\"))
def media_types(spark, sf):
    """Media types by content."""
    each = [table(spark, sf, t).select(F.lit(t).alias("src"), F.coalesce(c, F.lit("")).alias("t")) for t, c in (("documents", "text"), ("pages", "html"), ("events", "props"))]
    return each[0].unionAll(each[1]).unionAll(each[2]).groupBy("src", C.media_type(F.col("t")).alias("media_type")).agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, CASE WHEN NOT contains(line, ',') AND NOT contains(line, chr(9)) AND length(s) > 0 AND ({_DOC_CLASS}) = 'plain_text' AND doc_id % 3 < 2 THEN CASE doc_id % 3 WHEN 0 THEN 'text/csv' ELSE 'text/tab-separated-values' END
 WHEN contains(split_part(t, chr(10), 1), chr(9)) THEN 'text/tab-separated-values' WHEN contains(split_part(t, chr(10), 1), ',') THEN 'text/csv' ELSE 'application/octet-stream' END AS media_type FROM {_DOCS}""")
def media_types_named(spark, sf):
    """Names decide only for plain text."""
    name = F.concat(F.lit("f."), F.element_at(F.array(F.lit("csv"), F.lit("TSV"), F.lit("dat")), (F.col("doc_id") % 3 + 1).cast("int")))
    return table(spark, sf, "documents").select("doc_id", C.media_type_named(F.coalesce("text", F.lit("")), name).alias("media_type"))


_EMAIL = r"""SELECT doc_id, len(list_filter(range(1, len(p)), lambda i: regexp_extract(p[i], '([A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]{1,64})$', 1) <> '' AND NOT (length(p[i]) > 64 AND length(regexp_extract(p[i], '([A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]{1,64})$', 1)) = 64 AND regexp_matches(p[i][-65], '[A-Za-z0-9_]')) AND regexp_matches(left(p[i + 1], 186), '^[A-Za-z0-9][A-Za-z0-9.-]{0,180}\.(?i:com|org|net|edu|gov|mil|io|ai|co|uk|de|fr|es|info|biz|dev|app|me)\b'))) AS email FROM (SELECT doc_id, string_split(coalesce(text, ''), '@') AS p FROM documents)"""


@query(_EMAIL)
def email_hits(spark, sf):
    """Addresses per document."""
    return table(spark, sf, "documents").select("doc_id", C.emails(F.coalesce("text", F.lit(""))).cast("bigint").alias("email"))


def _tagged_sql(source: str, pattern: str) -> str:
    """(key, match) of leftmost matches of pattern in column v whose neighbours are no word characters."""
    return rf"""(SELECT key, split_part(p[i], chr(2), 1) AS m FROM (SELECT key, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT key, string_split(regexp_replace(v, '({pattern})', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM {source}))
 WHERE NOT regexp_matches(right(replace(p[i - 1], chr(2), ''), 1), '[A-Za-z0-9_]') AND NOT regexp_matches(left(split_part(p[i], chr(2), 2) || coalesce(p[i + 1], ''), 1), '[A-Za-z0-9_]'))"""


_PHONE_EX = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\b[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]|\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|\b0x[0-9a-f]+\b)"
_LINES = rf"(SELECT doc_id AS key, v FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS v FROM documents) WHERE NOT regexp_matches(v, '{_PHONE_EX}'))"


@query(rf"""SELECT key AS doc_id, count(*) AS phone FROM {_tagged_sql(_LINES, C.PHONE)} WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 AND regexp_matches(m, '^\+|[ ().-]') GROUP BY 1""")
def phone_hits(spark, sf):
    """Phone numbers per document that has any."""
    n = C.phones(F.coalesce("text", F.lit(""))).cast("bigint")
    return table(spark, sf, "documents").select("doc_id", n.alias("phone")).where("phone > 0")


_CRED = r"""(?:\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|-----BEGIN (?:RSA |EC |OPENSSH |DSA |ENCRYPTED )?PRIVATE KEY-----|\b(?:ghp_|github_pat_|sk_live_|sk_test_|sk-proj-|xoxb-|xoxp-|glpat-)[A-Za-z0-9_-]{16,200}|\b(?i:key|secret|token|password)\b[ \t]{0,16}[=:][ \t"'']{0,16}[A-Za-z0-9_+/=-]{20,200})"""
_CRED_HITS = rf"""(SELECT key, m FROM {_tagged_sql('(SELECT doc_id AS key, text AS v FROM documents WHERE text IS NOT NULL)', _CRED)}
 WHERE NOT regexp_matches(m, '[=:]') OR list_entropy(string_split(trim(substr(m, CASE WHEN contains(m, '=') THEN instr(m, '=') ELSE instr(m, ':') END + 1), ' ' || chr(9) || '"'''), '')) >= 3.5)"""


@query(f"SELECT key AS doc_id, count(*) AS credential_like FROM {_CRED_HITS} GROUP BY 1")
def credential_hits(spark, sf):
    """Credentials per document that has any."""
    n = C.credentials(F.coalesce("text", F.lit(""))).cast("bigint")
    return spread(table(spark, sf, "documents")).select("doc_id", n.alias("credential_like")).where("credential_like > 0")


_LIC = "list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(t, '(?i){p.replace('(?<!\\w)', chr(92) + 'b').replace('(?!\\w)', chr(92) + 'b')}') THEN '{k}' END" for k, p in C.LICENCES.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT * FROM (SELECT doc_id, unnest({_LIC}) AS family FROM {_DOCS})")
def licence_hits(spark, sf):
    """Licence families per document."""
    text = F.coalesce("text", F.lit(""))
    docs = spread(table(spark, sf, "documents")).select("doc_id", text.alias("text"), F.lower(text).alias("low"))
    return docs.select("doc_id", F.explode(C.licence_families(F.col("text"), F.col("low"))).alias("family"))


_CLASS_COUNTS = f"SELECT 'class' AS part, {_DOC_CLASS} AS class, count(*) AS n FROM {_DOCS} WHERE length(t) > 0 GROUP BY ALL UNION ALL SELECT 'encoding', 'utf8', count(*) FROM {_DOCS} WHERE length(t) > 0 UNION ALL SELECT 'script', script, count(*) FROM (SELECT t, {_SCRIPT.replace('FROM (SELECT *, le', 'AS script FROM (SELECT *, le', 1)}) WHERE length(t) > 0 GROUP BY script"


@query(_CLASS_COUNTS)
def file_totals(spark, sf):
    """Files per class, encoding and script."""
    return census.file_totals(census.findings(table(spark, sf, "documents")))


_TOTALS = f"""(SELECT 'email' AS detector, coalesce(sum(email), 0)::BIGINT AS hits, count(*) FILTER (email > 0) AS files FROM ({_EMAIL})
UNION ALL SELECT 'phone', count(*), count(DISTINCT key) FROM {_tagged_sql(_LINES, C.PHONE)} WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 AND regexp_matches(m, '^\\+|[ ().-]')
UNION ALL SELECT 'credential_like', count(*), count(DISTINCT key) FROM {_CRED_HITS})"""


@query(f"SELECT * FROM {_TOTALS}")
def detector_totals(spark, sf):
    """Hits and files with hits per detector."""
    return census.detector_totals(census.findings(table(spark, sf, "documents")))


def _publish_sql(counts: str) -> str:
    return f"""pub AS (WITH c AS (SELECT part, class, n, coalesce(sum(n) FILTER (n < 10) OVER (PARTITION BY part), 0) AS small, row_number() OVER (PARTITION BY part ORDER BY n < 10, n, class) AS rk FROM {counts} WHERE n > 0),
 m AS (SELECT part, CASE WHEN n < 10 OR (small > 0 AND small < 10 AND rk = 1) THEN 'other' ELSE class END AS class, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
 s AS (SELECT *, sum(n) OVER (PARTITION BY part)::BIGINT AS total, count(*) OVER (PARTITION BY part) AS cells FROM m)
 SELECT DISTINCT part, CASE WHEN total >= 10 AND cells > 1 THEN 'checked' ELSE 'suppressed' END AS state, CASE WHEN total < 10 THEN '1-9' ELSE total::VARCHAR END AS population, CASE WHEN cells > 1 AND total >= 10 THEN class END AS class, CASE WHEN cells > 1 AND total >= 10 THEN n END AS n FROM s)"""


_PART_COUNTS = "(SELECT event_type || '/' || (user_id % 37)::VARCHAR AS part, floor(value / 10)::INTEGER::VARCHAR AS class, count(*) AS n FROM events GROUP BY ALL)"


@query(f"WITH {_publish_sql(_PART_COUNTS)} SELECT * FROM pub")
def published_partitions(spark, sf):
    """Cells that can be told, over many partitions."""
    part = F.concat("event_type", F.lit("/"), (F.col("user_id") % 37).cast("string"))
    cls = F.floor(F.col("value") / 10).cast("int").cast("string")
    return census.publish_partition(table(spark, sf, "events").groupBy(part.alias("part"), cls.alias("class")).agg(F.count("*").alias("n")))


@query(f"SELECT * FROM {_PART_COUNTS} WHERE n > 0")
def exact_partitions(spark, sf):
    """All cells, in order."""
    part = F.concat("event_type", F.lit("/"), (F.col("user_id") % 37).cast("string"))
    cls = F.floor(F.col("value") / 10).cast("int").cast("string")
    return census.exact_partition(table(spark, sf, "events").groupBy(part.alias("part"), cls.alias("class")).agg(F.count("*").alias("n")))


@query(f"""WITH cnt AS ({_CLASS_COUNTS}), {_publish_sql('cnt')}, low AS (SELECT bool_or(n > 0 AND n < 10) AS low FROM cnt)
SELECT DISTINCT part, CASE WHEN low AND part <> 'class' THEN 'suppressed' ELSE state END AS state, population, CASE WHEN NOT low OR part = 'class' THEN class END AS class, CASE WHEN NOT low OR part = 'class' THEN n END AS n FROM pub, low""")
def published_content(spark, sf):
    """The three content partitions with cross suppression."""
    counts = census.file_totals(census.findings(table(spark, sf, "documents")))
    return census.cross_suppress(census.publish_partition(counts), counts)


_BAND = "CASE WHEN {n} = 0 THEN '0' WHEN {n} < 10 THEN '1-9' WHEN {n} < 100 THEN '10-99' WHEN {n} < 1000 THEN '100-999' ELSE '1000+' END"
_FILE_BAND = "CASE WHEN o = 10 AND files BETWEEN 1 AND 10 THEN '1+' WHEN o = 100 AND files BETWEEN 10 AND 100 THEN '10+' WHEN o = 1000 AND files BETWEEN 100 AND 1000 THEN '100+' ELSE " + _BAND.format(n="files") + " END"


@query(f"""WITH lic AS (SELECT unnest({_LIC}) AS family FROM {_DOCS} WHERE length(t) > 0), fam AS (SELECT unnest([{', '.join(repr(k) for k in C.LICENCES)}]) AS family),
r AS (SELECT 'detector' AS kind, detector AS name, files, hits FROM {_TOTALS} UNION ALL SELECT 'licence', fam.family, count(lic.family), NULL FROM fam LEFT JOIN lic USING (family) GROUP BY fam.family),
o AS (SELECT count(*) AS o FROM documents WHERE length(text) > 0)
SELECT kind, name, CASE WHEN o >= 10 THEN 'checked' ELSE 'suppressed' END AS state, CASE WHEN o >= 10 THEN {_FILE_BAND} END AS files_band, CASE WHEN o >= 10 AND hits IS NOT NULL THEN {_BAND.format(n='hits')} END AS hits_band FROM r, o""")
def findings_table(spark, sf):
    """Banded findings, always 3 + 14 rows."""
    return census.findings_table(census.findings(table(spark, sf, "documents")))


@query("SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS copies, max(strlen(coalesce(text, ''))) AS bytes FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_files(spark, sf):
    """Contents held more than once."""
    text = F.coalesce("text", F.lit(""))
    return census.duplicate_groups(table(spark, sf, "documents").select(F.sha2(text.cast("binary"), 256).alias("sha256"), F.octet_length(text).cast("bigint").alias("size")))
