"""URL filtering against (host, path, verdict) rules, in DataFrame functions only.

A URL is expanded into its host's suffixes, whole labels each. Those meet the rules' hosts
in an equi-join on a 32-bit prefix of their SHA-256, confirmed by the host itself; a host
brings the lengths of its rules' paths, and for these alone the URL's path prefixes are
formed. Host and path prefix together meet the rules in a second equi-join on 32 bits of
their SHA-256; the full digest confirms, and the longest rule wins.

Defined cases: a null URL, or one without "://", has an empty host and path and fits no
rule. An empty path fits no rule whose path is "/". Repeated rows stay repeated. Of rules
with equal text and different verdicts, block wins. Rules with a null host or path are
none. Without rules every verdict is the default. Other columns of the input are ignored,
so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rules up to this many are broadcast (under 40 MB at 256 characters each and two digests).
BROADCAST_RULES = 100_000


def url_parts(url):
    """(host, path) Columns of a URL."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def expression(host, path):
    """Digest of a host suffix and a path prefix."""
    return F.sha2(F.concat_ws("\n", host, path), 256)


def short(digest):
    return F.substring(digest, 1, 8)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row per host and path with its text, verdict, digest and digest prefix."""
    told = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
    rule = F.concat("host", "path")
    return told.select("host", F.length("path").alias("chars"), F.length(rule).alias("rule_chars"), rule.alias("rule"), "verdict", expression(F.col("host"), F.col("path")).alias("digest")).withColumn("prefix", short(F.col("digest")))


def host_suffixes(host):
    """Array of a host's suffixes of whole labels, itself first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col="page_id", url_col="url", default="allow") -> DataFrame:
    """id, host, path, rule, verdict for every row of pages.

    rules: columns host, path, verdict ("allow" or "block").
    """
    host, path = url_parts(F.col(url_col))
    # A row repeated n times is judged once and returned n times.
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    ready = prepared_rules(rules)
    n = ready.count()
    small = F.broadcast if n <= BROADCAST_RULES else lambda df: df
    hosts = ready.groupBy(F.col("host").alias("rule_host")).agg(F.array_sort(F.collect_set("chars")).alias("lengths"))
    hosts = small(hosts.withColumn("host_prefix", short(F.sha2("rule_host", 256))))
    posed = urls.select("id", "host", "path", F.posexplode(host_suffixes(F.col("host"))).alias("nth", "suffix")).withColumn("suffix_prefix", short(F.sha2("suffix", 256)))
    known = posed.join(hosts, (F.col("suffix_prefix") == F.col("host_prefix")) & (F.col("suffix") == F.col("rule_host")), "left")
    prefixes = F.filter("lengths", lambda chars: chars <= F.length("path"))
    expressions = F.transform(prefixes, lambda chars: expression(F.col("suffix"), F.substring(F.col("path"), F.lit(1), chars)))
    wanted = known.select("id", "host", "path", "nth", F.posexplode_outer(expressions).alias("mth", "wanted")).withColumn("wanted_prefix", short(F.col("wanted")))
    side = small(ready.select("prefix", "digest", "rule_chars", "rule", "verdict"))
    met = wanted.join(side, (F.col("wanted_prefix") == F.col("prefix")) & (F.col("wanted") == F.col("digest")), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("rule_chars", "rule", "verdict"))).alias("best")
    # Rows of one URL come from one task, so the partial aggregate sends on one row each.
    first = F.count(F.when((F.col("nth") == 0) & (F.coalesce("mth", F.lit(0)) == 0), 1)).alias("times")
    judged = met.groupBy("id", "host", "path").agg(best, first)
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"),
    ).drop("copy")
