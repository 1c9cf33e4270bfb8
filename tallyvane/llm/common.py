"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.session import shared_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read again: lineage ends there."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text):
    """A-Z lower-cased, all else kept. Pure ASCII takes the fast path of lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def crc32_mod(id_col: str, modulus: int):
    """crc32 of the id written as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def shuffle_width(spark: SparkSession, n_bytes: int, per_task: int, most: int | None = None) -> int:
    """Partitions so that each holds about per_task bytes (but at most `most`), and no fewer than the session's."""
    wanted = -(-n_bytes // per_task)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(wanted, most or wanted), 1)


def slices(batches, rows: int = 500):
    """Record batches of at most so many rows: what a task makes of a batch is held for these alone."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def hashed(tally: Counter, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers below 2**bits of the keys (bytes), and their summed counts."""
    mask = (1 << bits) - 1
    digest = xxhash.xxh3_64_intdigest
    index = np.fromiter((digest(w) & mask for w in tally), np.int64, len(tally))
    count = np.fromiter(tally.values(), np.float64, len(tally))
    order, where = np.unique(index, return_inverse=True)
    return order, np.bincount(where, count, len(order))


def hashed_counts(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bag of words."""
    return hashed(Counter(words), bits)
