"""Queries over files that Spark derives, on inputs of other shapes than the given tables'."""

import pytest
from pyspark.sql import functions as F

from tallyvane.plans import QUERIES


@pytest.fixture
def conf(spark):
    """Sets options of the session for one test."""
    was = {}

    def put(**options):
        for name, value in options.items():
            name = f"spark.sql.{name}"
            was[name] = spark.conf.get(name)
            spark.conf.set(name, value)

    yield put
    for name, value in was.items():
        spark.conf.set(name, value)


def test_a_part_of_the_log_is_one_file(spark, tmp_path, conf):
    """Rows of a part come from many tasks, and small tables are told by their real sizes only."""
    spark.range(4000).select(F.col("id").alias("event_id")).repartition(8).write.parquet(str(tmp_path / "events.parquet"))
    conf(autoBroadcastJoinThreshold="4k")
    got = sorted((r.part, r.torn, r.bad_lines) for r in QUERIES["torn_tails"](spark, str(tmp_path)).collect())
    bad = [sum(i % 7 == 3 for i in range(500 * p, 500 * p + 500)) for p in range(8)]
    assert got == [(f"part={p}", True, bad[p] - ((500 * p + 499) % 7 == 3)) for p in range(8)]


def test_the_last_line_alone_is_torn(spark, tmp_path):
    """An id may come twice; only the file's last line has no end."""
    spark.createDataFrame([(i,) for i in [*range(18), 17]], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in QUERIES["torn_tails"](spark, str(tmp_path)).collect()] == [("part=0", True, 3)]


def test_letters_beyond_the_prefix_have_an_encoding(spark, tmp_path):
    """The first letter beyond ASCII may be anywhere in a text, and end it, also at the prefix's last byte."""
    texts = [(4 * n + k, "x" * n + "é") for n in (10, 4094, 4095, 4096, 9000) for k in range(4)]
    spark.createDataFrame([*texts, (50_002, "é" + "x" * 9000), (60_002, "plain"), (70_002, "x" * 9000 + "€é")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.encoding for r in QUERIES["byte_encodings"](spark, str(tmp_path)).collect()}
    assert got == {i: ["utf8_bom", "utf16", "latin1_like", "utf8"][i % 4] for i in [*(i for i, _ in texts), 50_002]}
