"""File inventories: incremental diff, tombstones, batches, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.session import shared_path


def diff_inventory(cur: DataFrame, prev: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, status): added, removed, changed or same, by size and modification time."""
    c = cur.select(key, F.struct("size", "mtime").alias("now"))
    p = prev.select(key, F.struct("size", "mtime").alias("was"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("was"), "same").otherwise("changed")
    return c.join(p, key, "full_outer").select(key, status.alias("status"))


def to_hash(cur: DataFrame, prev: DataFrame, key: str = "file_id") -> DataFrame:
    """Files of cur whose content must be read: new, or of another size or time."""
    return cur.join(prev.select(key, "size", "mtime"), [key, "size", "mtime"], "left_anti")


def inventory_update(cur: DataFrame, prev: DataFrame, now: Column, key: str = "file_id") -> DataFrame:
    """(key, size, mtime, sha256, first_seen_at, changed_at, present): the next inventory.

    cur: key, size, mtime, sha256. prev has the same and first_seen_at, changed_at, present.
    Files that are gone stay once, as not present; those gone before are left out.
    """
    live = prev.where("present").select(key, *[F.col(c).alias(f"p_{c}") for c in ("size", "mtime", "sha256", "first_seen_at", "changed_at")])
    both = cur.withColumn("_here", F.lit(True)).join(live, key, "full_outer")
    here, known = F.col("_here").isNotNull(), F.col("p_first_seen_at").isNotNull()
    same = known & (F.col("size") == F.col("p_size")) & (F.col("mtime") == F.col("p_mtime"))
    keep = lambda c: F.when(here & ~same, F.col(c)).otherwise(F.col(f"p_{c}")).alias(c)
    return both.select(
        key, F.coalesce("size", "p_size").alias("size"), F.coalesce("mtime", "p_mtime").alias("mtime"), keep("sha256"),
        F.coalesce("p_first_seen_at", now).alias("first_seen_at"), F.when(here & ~same, now).otherwise(F.col("p_changed_at")).alias("changed_at"), here.alias("present"),
    )


def tombstones(cur: DataFrame, prev: DataFrame, key: str = "file_id") -> DataFrame:
    """Previously present and now missing, once, in order."""
    return prev.where("present").join(cur.select(key), key, "left_anti").withColumn("present", F.lit(False)).orderBy(key)


def batches(df: DataFrame, order: str, size: int = 1000, part: Column | None = None) -> DataFrame:
    """df with `batch`, `size` rows each in order; the batch number of a row is its rank over size.

    Rows are ranked within ranges of the order, and the ranges by their counts, so that no
    task ranks the whole table. part: a Column that never falls as order rises (default: the
    range that a range partitioning of the written keys gives). `order` must be unique.
    """
    if part is None:
        path = shared_path(df.sparkSession, "ranges")
        df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()).write.parquet(path)
        parted = df.sparkSession.read.parquet(path)
    else:
        parted = df.withColumn("_part", part)
    local = parted.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = parted.groupBy("_part").count()
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    before = sizes.select("_part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"))
    return local.join(before, "_part").withColumn("batch", F.floor((F.col("_before") + F.col("_rank") - 1) / size)).select(*df.columns, "batch")


def enforce_cap(df: DataFrame, cap: int, code: str) -> DataFrame:
    """df if it has at most cap rows, else nothing; with a column `refusal` of the code. Never a silent cut."""
    n = df.agg(F.count("*")).scalar()
    refused = df.sparkSession.range(1).select(F.lit(code).alias("refusal")).where(n > cap)
    return df.where(n <= cap).withColumn("refusal", F.lit(None).cast("string")).unionByName(refused, allowMissingColumns=True)


def drift(pinned: DataFrame, observed: DataFrame, key: str = "identity") -> DataFrame:
    """(key, status): missing, unexpected, or which pinned property differs; null-safe."""
    cols = ["sha256", "size", "etag"]
    both = pinned.select(key, F.struct(*cols).alias("a")).join(observed.select(key, F.struct(*cols).alias("b")), key, "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected")
    for c in ("size", "etag", "sha256"):
        status = status.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), f"{c}_changed")
    return both.select(key, status.otherwise("same").alias("status"))


def block_digests(df: DataFrame, content: Column, block: int, *keep: str) -> DataFrame:
    """(keep, block, digest): SHA-256 of every block of a binary column; empty content has none."""
    n = F.ceil(F.octet_length(content) / block).cast("int")
    blocks = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # Digests are made in the row, so that the content is not carried once per block.
    digests = F.transform(blocks, lambda i: F.sha2(F.substring(content, i * block + 1, F.lit(block)), 256))
    return df.select(*keep, F.posexplode(digests).alias("block", "digest"))
