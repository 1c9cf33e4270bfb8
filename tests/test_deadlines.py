"""Expiry and delivery that happen after a row's batch."""

import datetime
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyvane.plans import exchange
from tallyvane.streaming import deadlines as d

START = datetime.datetime(2024, 1, 1)
REQUESTS = "id long, kind string, at timestamp, deadline timestamp"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def batches(spark, tmp_path, name, schema, parts):
    """A stream of one file per batch, in order."""
    path = str(tmp_path / name)
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, stream, tmp_path, name="out"):
    out = str(tmp_path / name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect()


def test_requests_expire_after_their_batch_unless_closed(spark, tmp_path):
    parts = [
        [(1, "open", at(0), at(50)), (2, "open", at(0), at(50)), (3, "open", at(1), at(500)), (4, "open", at(2), at(30)), (5, "close", at(3), None), (8, "open", at(3), None)],
        [(2, "close", at(20), None), (5, "open", at(10), at(60)), (6, "open", at(20), at(5)), (8, "close", at(21), None)],
        [(4, "close", at(45), None), (7, "open", at(60), at(90)), (1, "open", at(60), at(70))],  # 4 closes too late
        [(0, "open", at(200), at(900))],
    ]
    got = drained(spark, d.stream_expiry(batches(spark, tmp_path, "in", REQUESTS, parts), "15 minutes"), tmp_path)
    found = {r.id: (r.outcome, r.at) for r in got}
    assert len(got) == len(found)
    assert found == {
        1: ("expired", at(50)), 2: ("closed", at(20)), 4: ("expired", at(30)), 5: ("closed", at(3)), 6: ("expired", at(5)), 7: ("expired", at(90)), 8: ("closed", at(21)),
    }


def test_a_restart_keeps_the_timers(spark, tmp_path):
    path = str(tmp_path / "in")
    out = str(tmp_path / "out")
    seen = []
    for rows in ([(1, "open", at(0), at(30)), (2, "open", at(0), at(300))], [(3, "open", at(100), at(110))], [(9, "open", at(400), at(900))]):
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(path)
        stream = d.stream_expiry(spark.readStream.schema(REQUESTS).parquet(path), "0 seconds")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-check").trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted(r.id for r in spark.read.schema(stream.schema).parquet(out).collect()))
    assert seen == [[], [1], [1, 2, 3]]


def test_any_order_within_the_delay(spark, tmp_path):
    """Random requests, shuffled within the delay, against their rule."""
    r = random.Random(4)
    rows = []
    for i in range(120):
        opened, length = r.randrange(0, 600), r.randrange(5, 200)
        rows.append((i, "open", at(opened), at(opened + length)))
        if r.random() < 0.6:
            rows += [(i, "close", at(opened + r.randrange(0, 250)), None)] * r.choice([1, 1, 2])
    rows.sort(key=lambda x: x[2])
    parts = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    late = max(x[2] for x in rows) - datetime.timedelta(minutes=60)
    for part in parts:
        r.shuffle(part)
    want = {}
    for i, kind, _, deadline in rows:
        if kind == "open":
            ends = [t for j, k, t, _ in rows if j == i and k == "close"]
            if ends and min(ends) < deadline:
                want[i] = ("closed", min(ends))
            elif ends or deadline < late:
                want[i] = ("expired", deadline)
    got = drained(spark, d.stream_expiry(batches(spark, tmp_path, "in", REQUESTS, parts), "60 minutes"), tmp_path)
    assert len(got) == len(want) and {x.id: (x.outcome, x.at) for x in got} == want


@pytest.mark.parametrize("audits_first", [False, True])
def test_an_audit_three_batches_later_delivers_once(spark, tmp_path, audits_first):
    day = 1440
    outbox = [[(1, at(0)), (2, at(0))], [(3, at(day))], [(4, at(2 * day))], [(5, at(3 * day))], [(6, at(60 * day))], [(7, at(61 * day))]]
    audits = [[(3, 10, at(day))], [(99, 11, at(2 * day))], [(5, 12, at(3 * day))], [(1, 13, at(3 * day + 5)), (1, 14, at(3 * day + 9))], [(1, 15, at(4 * day)), (2, 16, at(60 * day))], [(6, 17, at(61 * day))]]
    if audits_first:  # the audits' stream is read ahead: all of it in its first batch
        audits = [sum(audits, [])]
    a = batches(spark, tmp_path, "outbox", "seq long, at timestamp", outbox)
    b = batches(spark, tmp_path, "audits", "seq long, audit_seq long, at timestamp", audits)
    got = drained(spark, d.stream_outbox(a, b, "30 days", "1 day"), tmp_path)
    found = {r.seq: (r.delivered, r.audit_seq) for r in got}
    assert len(got) == len(found)
    assert found == {1: (True, 13), 2: (False, None), 3: (True, 10), 4: (False, None), 5: (True, 12), 6: (True, 17)}


def test_empty_stream(spark, tmp_path):
    assert drained(spark, d.stream_expiry(batches(spark, tmp_path, "in", REQUESTS, [[]])), tmp_path) == []


def test_null_ids_are_one(spark, tmp_path):
    parts = [[(None, "open", at(0), at(9))], [(None, "close", at(5), None), (1, "open", at(99), None)]]
    got = drained(spark, d.stream_expiry(batches(spark, tmp_path, "in", REQUESTS, parts)).select("id", "outcome", F.col("at")), tmp_path)
    assert [(r.id, r.outcome, r.at) for r in got] == [(None, "closed", at(5))]


def test_many_ids_are_settled_together(spark, tmp_path):
    """Python is called for groups of ids: a call an id took over 150 s for these. References keep all their digits."""
    n, big, began = 20_000, (1 << 60) + 1, time.monotonic()
    day = "timestamp'2024-01-01' + make_dt_interval(id % 3)"
    a, b = str(tmp_path / "outbox"), str(tmp_path / "audits")
    spark.range(n).selectExpr(f"id + {big} AS seq", f"{day} AS at").write.parquet(a)
    spark.range(n).where("id % 2 = 0").selectExpr(f"id + {big} AS seq", f"id + {big + 7} AS audit_seq", f"{day} AS at").write.parquet(b)
    for path, rest in ((a, []), (b, [f"{big} AS audit_seq"])):
        spark.range(1).selectExpr("CAST(NULL AS bigint) AS seq", "timestamp'2024-06-01' AS at", *rest).write.mode("append").parquet(path)
    read = lambda path, more="": spark.readStream.schema(f"seq long, at timestamp{more}").parquet(path)
    got = drained(spark, d.stream_outbox(read(a), read(b, ", audit_seq long"), "7 days", "1 day"), tmp_path)
    want = {i + big: i + big + 7 if i % 2 == 0 else None for i in range(n)} | {None: big}
    assert len(got) == n + 1 and {r.seq: r.audit_seq for r in got} == want
    assert all(r.delivered == (r.audit_seq is not None) for r in got)
    assert time.monotonic() - began < 100


def test_numbers_are_held_as_longs_and_text_as_text(spark, tmp_path):
    assert [str(d._held("bigint", "string").field(c).type) for c in ("id", "ref")] == ["int64", "string"]
    rows = "id string, kind string, at timestamp, deadline timestamp, ref int"
    parts = [[("a", "open", at(0), at(50), 5), (None, "open", at(0), at(50), None), ("", "open", at(0), at(50), None)], [("a", "close", at(5), None, None), (None, "close", at(60), None, 7), ("", "close", at(6), None, 0)]]
    settled = d.stream_settled(batches(spark, tmp_path, "in", rows, parts).withWatermark("at", "1 hour"))
    assert dict(settled.dtypes)["ref"] == "int"
    got = sorted(((r.id, r.outcome, r.at, r.ref) for r in drained(spark, settled, tmp_path)), key=str)
    assert got == [("", "closed", at(6), 0), ("a", "closed", at(5), None), (None, "expired", at(50), None)]


def test_batches_load_few_state_stores(spark, tmp_path, monkeypatch):
    """Each of 200 shuffle partitions was a store to load and commit in every batch."""
    monkeypatch.setattr(exchange, "shared_path", lambda _, label: str(tmp_path / label))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        df = spark.createDataFrame([(1, "open", at(0), at(50)), (1, "close", at(9), None)], REQUESTS)
        got = exchange._batched(spark, [df], lambda s: d.stream_expiry(s, "1 hour"), "few", parts=1).collect()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r.id, r.outcome) for r in got] == [(1, "closed")]
    assert len([x for x in os.listdir(tmp_path / "few-check" / "state" / "0") if x.isdigit()]) == exchange.STORES
