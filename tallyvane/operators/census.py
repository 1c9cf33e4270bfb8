"""Content census: what a corpus holds, in counts that give no small group away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions import content as C
from tallyvane.session import spread

DETECTORS = ["email", "phone", "credential_like"]
K = 10


def findings(docs: DataFrame, id_col="doc_id", text_col="text", name: Column | None = None) -> DataFrame:
    """One row per document: class, encoding, script, size, hits per detector, licence families. Only small inputs are dealt out anew."""
    text, label = F.col("_text"), F.col("encoding")
    read = spread(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), (name if name is not None else F.lit("")).alias("_name"))
    # One projection on the other, so that what several conditions read is worked out once.
    read = read.withColumn("_trimmed", C.trimmed(text)).withColumn("_line", C.first_line(F.col("_trimmed")))
    read = read.withColumn("class", C.content_class(text, F.col("_name"), F.col("_trimmed"), F.col("_line")))
    read = read.withColumn("encoding", C.encoding(text.cast("binary"), F.col("class"))).withColumn("_letters", C.letters(text)).withColumn("_low", F.lower(text))
    return read.select(
        "id",
        F.octet_length(text).cast("bigint").alias("size"),
        "class",
        "encoding",
        C.script(text, label, F.col("_letters")).alias("script"),
        C.emails(text).alias("email"),
        C.phones(text).alias("phone"),
        C.credentials(text, F.col("_low")).alias("credential_like"),
        C.licence_families(text, F.col("_low")).alias("licences"),
    )


def classified(files: DataFrame, content_col="content", name: Column | None = None) -> DataFrame:
    """files with the class of their first bytes and the encoding of all; characters that the prefix cuts are left out.

    A file may be ASCII for longer than the prefix, so its bytes beyond it are only checked for UTF-8.
    """
    content, text = F.col("_content"), F.col("_text")
    read = spread(files).withColumn("_content", C.whole_characters(F.substring(F.col(content_col), 1, C.PREFIX))).withColumn("_name", name if name is not None else F.lit(""))
    read = read.withColumn("_wide", C.wide_text(content)).withColumn("_text", F.coalesce("_wide", C.narrow_text(content)))
    read = read.withColumn("_trimmed", C.trimmed(text)).withColumn("_line", C.first_line(F.col("_trimmed")))
    read = read.withColumn("_told", C.content_class(text, F.col("_name"), F.col("_trimmed"), F.col("_line")))
    read = read.withColumn("class", F.coalesce(F.when(F.col("_wide").isNotNull(), F.col("_told")), C.magic_class(content), F.col("_told")))
    return read.withColumn("encoding", C.encoding(F.col(content_col), F.col("class"))).select(*files.columns, "class", "encoding")


def file_totals(found: DataFrame) -> DataFrame:
    """(part, class, n): non-empty files per content class, encoding and script, in one pass."""
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col(c).alias("class")) for p, c in (("class", "class"), ("encoding", "encoding"), ("script", "script"))])
    return found.where("size > 0").select(F.inline(parts)).groupBy("part", "class").agg(F.count("*").alias("n"))


def detector_totals(found: DataFrame) -> DataFrame:
    """(detector, hits, files) over non-empty files; always one row per detector."""
    live = found.where("size > 0")
    one = live.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(f"h_{d}") for d in DETECTORS], *[F.count_if(F.col(d) > 0).alias(f"f_{d}") for d in DETECTORS])
    rows = [F.struct(F.lit(d).alias("detector"), F.col(f"h_{d}").alias("hits"), F.col(f"f_{d}").alias("files")) for d in DETECTORS]
    return one.select(F.inline(F.array(*rows)))


def licence_totals(found: DataFrame) -> DataFrame:
    """(family, files): always one row per licence family."""
    one = found.where("size > 0").agg(*[F.count_if(F.array_contains("licences", f)).alias(f) for f in C.LICENCES])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("files")) for f in C.LICENCES])))


def population(n: Column) -> Column:
    return F.when(n < K, C.count_band(n)).otherwise(n.cast("string"))


def finding_state(n: Column) -> Column:
    return F.when(n == 0, "not_checked").when(n < K, "suppressed").otherwise("checked")


def file_count_band(n: Column, of: Column) -> Column:
    """count_band of n files out of `of`, coarser where a band's edge would be the whole."""
    return (
        F.when((of == 10) & n.between(1, 10), "1+").when((of == 100) & n.between(10, 100), "10+").when((of == 1000) & n.between(100, 1000), "100+").otherwise(C.count_band(n))
    )


def publish_partition(counts: DataFrame, k: int = K) -> DataFrame:
    """(part, state, population, class, n): cells that can be told, per part of counts (part, class, n).

    Cells under k merge into `other`; if that is still under k the smallest other cell joins
    it (one is enough, as it has k). A part that would leave one cell is suppressed: one row
    with null class. Input is a few rows per part.
    """
    live = counts.where("n > 0")
    part = Window.partitionBy("part")
    small = F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))).over(part), F.lit(0))
    rank = F.row_number().over(part.orderBy((F.col("n") < k).cast("int"), "n", "class"))
    marked = live.withColumn("small", small).withColumn("rank", rank)
    joins = (F.col("n") < k) | ((F.col("small") > 0) & (F.col("small") < k) & (F.col("rank") == 1))
    merged = marked.groupBy("part", F.when(joins, "other").otherwise(F.col("class")).alias("class")).agg(F.sum("n").alias("n"))
    sized = merged.withColumn("total", F.sum("n").over(part)).withColumn("cells", F.count("*").over(part))
    told = (F.col("cells") > 1) & (F.col("total") >= k)
    state = F.when(F.col("total") < k, finding_state(F.col("total"))).when(told, "checked").otherwise("suppressed")
    return sized.select(
        "part", state.alias("state"), population(F.col("total")).alias("population"), F.when(told, F.col("class")).alias("class"), F.when(told, F.col("n")).alias("n")
    ).distinct()


def exact_partition(counts: DataFrame) -> DataFrame:
    """Cells with members, in order of part and class."""
    return counts.where("n > 0").orderBy("part", "class")


def cross_suppress(published: DataFrame, counts: DataFrame, opened: Column | None = None) -> DataFrame:
    """published without encodings and scripts if any cell of counts is 1 to 9 (or archives were opened)."""
    low = counts.agg(F.coalesce(F.bool_or((F.col("n") > 0) & (F.col("n") < K)), F.lit(False)) | (opened if opened is not None else F.lit(False))).scalar()
    hide = low & F.col("part").isin("encoding", "script")
    return published.select(
        "part", F.when(hide, "suppressed").otherwise(F.col("state")).alias("state"), "population",
        F.when(~hide, F.col("class")).alias("class"), F.when(~hide, F.col("n")).alias("n"),
    ).distinct()


def findings_table(found: DataFrame) -> DataFrame:
    """(kind, name, state, files_band, hits_band): three detectors and fourteen licence families, from one aggregate."""
    one = found.where("size > 0").agg(
        F.count("*").alias("of"), *[F.coalesce(F.sum(d), F.lit(0)).alias(f"h_{d}") for d in DETECTORS], *[F.count_if(F.col(d) > 0).alias(f"f_{d}") for d in DETECTORS],
        *[F.count_if(F.array_contains("licences", f)).alias(f"l_{f}") for f in C.LICENCES],
    )
    row = lambda kind, name, files, hits: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), files.alias("files"), hits.cast("bigint").alias("hits"))
    rows = [row("detector", d, F.col(f"f_{d}"), F.col(f"h_{d}")) for d in DETECTORS] + [row("licence", f, F.col(f"l_{f}"), F.lit(None)) for f in C.LICENCES]
    many = F.col("of") >= K
    return one.select("of", F.inline(F.array(*rows))).select(
        "kind", "name", F.when(many, "checked").otherwise("suppressed").alias("state"),
        F.when(many, file_count_band(F.col("files"), F.col("of"))).alias("files_band"),
        F.when(many & F.col("hits").isNotNull(), C.count_band(F.col("hits"))).alias("hits_band"),
    )


def inventory_counts(members: DataFrame) -> DataFrame:
    """(part, class, n): members per extension class and size bucket, archives, and totals."""
    cell = lambda part, cls, n: F.struct(F.lit(part).alias("part"), cls.alias("class"), n.cast("bigint").alias("n"))
    cells = F.array(
        cell("extension", C.extension_class(F.col("format")), F.lit(1)),
        cell("size", C.size_bucket(F.col("size")), F.lit(1)),
        cell("archives", F.coalesce(C.archive_format(F.col("format")), F.lit("none")), F.lit(1)),
        cell("stored_bytes", F.lit("all"), F.col("size")),
    )
    return members.select(F.inline(cells)).groupBy("part", "class").agg(F.sum("n").alias("n"))


def read_states(results: DataFrame) -> DataFrame:
    """(state, reason, members, bytes) of member results."""
    return results.groupBy("state", "reason").agg(F.count("*").alias("members"), F.sum("size").alias("bytes"))


def limited_coverage(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: whether under a tenth of the readable and unreadable bytes is readable."""
    r, u = F.col("readable"), F.col("unreadable")
    return results.groupBy(*keys).agg(F.sum("readable").alias("readable"), F.sum("unreadable").alias("unreadable")).withColumn(
        "limited", (u > 0) & (r < F.floor((r + u + 9) / 10))
    )


def preflight(totals: DataFrame, memory=128 << 20, reserve=16 * (4 << 20)) -> DataFrame:
    """totals (total, known, unknown, members, possible, requests) with the 10% floor, admission and request band."""
    floor = F.ceil(F.col("total") / 10)
    available = memory - reserve
    over = (F.col("requests") >= 1_024_000) | (F.col("members") > available // 1024) | (F.col("possible") > F.floor((available - F.col("members") * 1024) / 384))
    return totals.select(
        "*",
        F.when(F.col("known") >= floor, "meets_floor").when(F.col("known") + F.col("unknown") >= floor, "meets_floor_unknown_expansion").otherwise("below_floor").alias("floor_result"),
        F.when(over, "over_bound").otherwise("within_bounds").alias("admission_result"),
        C.request_band(F.col("requests")).alias("requests_band"),
    )


def duplicate_groups(members: DataFrame) -> DataFrame:
    """(sha256, copies, bytes) of contents held more than once."""
    return members.groupBy("sha256").agg(F.count("*").alias("copies"), F.max("size").alias("bytes")).where("copies > 1")


def census_report(members: DataFrame, found: DataFrame) -> DataFrame:
    """One row: JSON of the published inventory, classes and findings; complete if every member was read."""
    def cells(df):
        return df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("json")).scalar()

    counts = file_totals(found)
    inventory = publish_partition(inventory_counts(members).where("part in ('extension', 'size')"))
    return members.agg(
        F.count("*").alias("members"),
        F.sum("size").alias("stored_bytes"),
        F.when(F.count("*") == found.agg(F.count("*")).scalar(), "complete").otherwise("sampled").alias("depth_class"),
    ).select("*", cells(inventory).alias("inventory"), cells(cross_suppress(publish_partition(counts), counts)).alias("inspected"), cells(findings_table(found)).alias("findings"))
