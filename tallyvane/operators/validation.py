"""Row checks of wire tables: what does not fit is returned, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
HEX32, HEX64 = r"^[0-9a-f]{32}$", r"^[0-9a-f]{64}$"
#: Outcomes of a receipt.
OUTCOMES = ["in_progress", "complete", "aborted_block_mismatch", "aborted_deadline"]
#: The closed vocabulary of a description, one value per field or sorted tags.
DESCRIPTION_ENUMS = {
    "domain_class": ["education_learning", "software_technology", "business_finance", "health_life_sciences", "public_social", "physical_environment"],
    "record_granularity": ["entity", "event", "measurement", "document", "relationship", "aggregate"],
    "temporal_scope": ["current_snapshot", "historical_period", "time_series", "mixed_periods", "not_time_based"],
    "update_cadence": ["one_time", "irregular", "continuous", "daily", "weekly", "monthly", "quarterly", "yearly"],
}
DESCRIPTION_TAGS = {
    "intended_use_tags": ["analysis_reporting", "research_education", "machine_learning", "benchmarking", "reference_lookup", "operations_planning"],
    "known_limitation_tags": ["incomplete_coverage", "missing_values", "estimated_fields", "historical_cutoff", "sampled_source", "known_duplicates", "source_defined_categories"],
}
DESCRIPTION_BYTES = 2048
#: Patterns of required columns per kind of row.
REQUIRED = {
    "receipt": {"order_id": UUID, "file_id": HEX32, "sha256": HEX64},
    "inventory": {"file_id": HEX32, "content_commitment": HEX64},
    "description": {"file_id": HEX32, "sha256": HEX64},
}


def validate_rows(df: DataFrame, kind: str, key: str) -> DataFrame:
    """(key, violation): one row per broken rule of every row."""
    flags = []
    for name, pattern in REQUIRED[kind].items():
        c = F.col(name)
        flags.append(F.when(c.isNull(), F.lit(f"{name}_missing")).when(~c.rlike(pattern), F.lit(f"{name}_malformed")))
    if kind == "receipt":
        flags.append(F.when(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)), F.lit("outcome_unknown")))
        flags.append(F.when(F.col("transmitted_bytes") > F.col("size"), F.lit("bytes_over_size")))
    return df.select(key, F.explode(F.array_compact(F.array(*flags))).alias("violation"))


def valid_tags(tags: Column, allowed: list[str], most: int = 5) -> Column:
    """Whether tags are sorted, unique, at most `most`, and all allowed."""
    same = (F.array_sort(F.array_distinct(tags)) == tags) & (F.size(tags) <= most)
    return F.coalesce(same & (F.size(F.array_except(tags, F.array(*map(F.lit, allowed)))) == 0), F.lit(False))


def valid_description(text: Column, enums: dict[str, list[str]] | None = None, tag_lists: dict[str, list[str]] | None = None) -> Column:
    """Whether a JSON description has just the fields named, each enum in its set, each tag list valid, and is short enough."""
    enums = DESCRIPTION_ENUMS if enums is None else enums
    tag_lists = DESCRIPTION_TAGS if tag_lists is None else tag_lists
    names = F.array(*map(F.lit, sorted([*enums, *tag_lists])))
    ok = (F.octet_length(text) <= DESCRIPTION_BYTES) & F.coalesce(F.array_sort(F.json_object_keys(text)) == names, F.lit(False))
    for name, allowed in enums.items():
        ok = ok & F.coalesce(F.get_json_object(text, f"$.{name}").isin(*allowed), F.lit(False))
    for name, allowed in tag_lists.items():
        ok = ok & valid_tags(F.from_json(F.get_json_object(text, f"$.{name}"), "array<string>"), allowed)
    return F.coalesce(ok, F.lit(False))


def egress_state(results: DataFrame, key: str) -> DataFrame:
    """(key, state): open if any of dns, tcp or proxy is open."""
    return results.groupBy(key).agg(F.bool_or((F.col("dns") == "open") | (F.col("tcp") == "open") | (F.col("proxy") == "open")).alias("_open")).select(
        key, F.when(F.col("_open"), "open").otherwise("closed").alias("state")
    )
