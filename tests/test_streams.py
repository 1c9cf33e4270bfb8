"""Streams drained once, against the same logic step by step."""

import random

from pyspark.sql import functions as F

from tallyvane.operators.ledger import mark_delivered
from tallyvane.streaming import state
from tallyvane.streaming.deliveries import delivery_sessions, delivery_windows


def drained(spark, df, build, tmp_path, parts=3):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(parts).write.parquet(src)
    stream = build(spark.readStream.schema(df.schema).parquet(src))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def byte_by_byte(rows, limit=2):
    """Grants over single bytes: how often each was served; requests run to the first byte at the limit."""
    served, out = {}, {}
    for oid, fid, i, s, e in rows:
        count = served.setdefault((oid, fid), {})
        full = next((b for b in range(s, e + 1) if count.get(b, 0) >= limit), e + 1)
        for b in range(s, full):
            count[b] = count.get(b, 0) + 1
        out[i] = (full - 1 if full > s else None, sum(n > 0 for n in count.values()))
    return out


def test_transfers(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randint(0, 2), rng.choice("ab"), i, s := rng.randint(0, 40), s + rng.randint(0, 9)) for i in range(150)]
    df = spark.createDataFrame(rows, "oid long, fid string, id long, start long, end long")
    found = drained(spark, df, state.stream_transfers, tmp_path).collect()
    got = {r.id: (r.granted_end, r.served) for r in found}
    want = byte_by_byte(rows)
    assert got == want and any(end is None for end, _ in want.values())
    assert all((r.verdict == "granted") == (r.granted_end is not None) and r.complete is None for r in found)


def test_transfers_settle_complete_and_stay_whole(spark, tmp_path):
    rows = [
        (1, "f", 1, "request", 0, 19, None, 20), (1, "f", 2, "settle", 0, 19, 9, 20), (1, "f", 3, "request", 10, 19, None, 20),
        (1, "f", 4, "settle", 10, 19, 19, 20), (2, "f", 5, "request", 0, 0, None, 9), (2, "f", 6, "request", 2, 2, None, 9),
        (2, "f", 7, "request", 4, 4, None, 9), (2, "f", 8, "request", 1, 1, None, 9), (3, "f", 9, "request", 5, 4, None, 0),
    ]
    df = spark.createDataFrame(rows, "oid long, fid string, id long, kind string, start long, end long, written_through long, size long")
    got = {r.id: (r.verdict, r.granted_end, r.served, r.intervals, r.complete) for r in drained(spark, df, lambda s: state.stream_transfers(s, fragments=2), tmp_path, parts=1).collect()}
    assert got[1] == ("granted", 19, 20, 1, True) and got[2] == ("settled", None, 10, 1, False)
    assert got[3] == ("granted", 19, 20, 1, True) and got[4] == ("settled", None, 20, 1, True)
    assert got[6] == ("granted", 2, 2, 2, False) and got[7] == ("fragmented", None, 2, 2, False) and got[8] == ("granted", 1, 3, 1, False)
    assert got[9][4] is True


def test_admission_and_late(spark, tmp_path):
    rng = random.Random(2)
    rows = [("x" if i % 3 else "y", i, 1_700_000_000 + 2000 * i - (5000 if rng.random() < 0.1 else 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "listing string, id long, seconds long")
    got = {r.id: r.verdict for r in drained(spark, df, state.stream_admission, tmp_path).collect()}
    high, used, want = {}, {}, {}
    for k, i, s in rows:
        day = (k, s // 86_400)
        if s < high.get(k, 0) - 300:
            want[i] = "late"
        elif used.get(day, 0) >= 10:
            want[i] = "over_quota"
        else:
            want[i], used[day], high[k] = "admitted", used.get(day, 0) + 1, max(high.get(k, 0), s)
    assert got == want and set(want.values()) == {"late", "over_quota", "admitted"}
    late = {r.id for r in drained(spark, df, state.stream_late, tmp_path / "late").collect()}
    assert late == {i for i, v in want.items() if v == "late"}


def test_windows_are_the_same_in_batch_and_stream(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("event_id"), F.lit("a").alias("event_type"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    batch = delivery_windows(df, "10 minutes")
    assert batch.count() == 20 and delivery_windows(df, "10 minutes", "5 minutes").count() == 41
    streamed = drained(spark, df, lambda s: delivery_windows(s, "10 minutes", watermark="0 seconds"), tmp_path)
    some, whole = {tuple(r) for r in streamed.collect()}, {tuple(r) for r in batch.collect()}
    assert some <= whole and len(some) >= len(whole) - 1  # the last window stays open


def test_sessions_are_the_same_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(6)
    minutes = sorted(rng.sample(range(5_000), 250))
    df = spark.createDataFrame([(i, rng.choice("ab"), m) for i, m in enumerate(minutes)], "event_id long, user string, m long").select("event_id", "user", F.timestamp_seconds(F.col("m") * 60).alias("ts"))
    want, last = {}, {}
    for r in df.orderBy("ts").collect():
        at = int(r.ts.timestamp()) // 60
        if r.user not in last or at - last[r.user][1] > 30:
            last[r.user] = [at, at, 0, 0]
        s = last[r.user]
        want[r.user, s[0]] = s
        s[1:] = at, s[2] + 1, s[3] + r.event_id
    want = {(u, a, b + 30, n, ids) for (u, a), (_, b, n, ids) in want.items()}
    plain = lambda rows: {(r.user, int(r.session_start.timestamp()) // 60, int(r.session_end.timestamp()) // 60, r.n, r.ids) for r in rows}
    assert plain(delivery_sessions(df, "user", "30 minutes").collect()) == want
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for a in range(0, 5_000, 1_000):  # sessions go on over batches
        df.where((F.minute("ts") >= 0) & (F.unix_seconds("ts") >= a * 60) & (F.unix_seconds("ts") < (a + 1_000) * 60)).coalesce(1).write.mode("append").parquet(src)
    stream = delivery_sessions(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), "user", "30 minutes", "10 minutes")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-check").trigger(availableNow=True).start().awaitTermination()
    got = plain(spark.read.parquet(out).collect())
    assert got <= want and len(got) >= len(want) - 4


def test_delivered_marks_of_a_table(spark):
    audited = spark.createDataFrame([(1, 1), (2, 9)], "seq long, audit_seq long")
    assert {r.seq for r in mark_delivered(spark.range(10).withColumnRenamed("id", "seq"), audited, 5).where("delivered").collect()} == {1}


def test_inventory_generations(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "file_id string, size long, mtime timestamp, sha256 string"
    day = lambda d: __import__("datetime").datetime(2024, 1, d)
    spark.createDataFrame([("a", 1, day(1), "x"), ("b", 2, day(1), "y")], schema).write.parquet(src)
    run = lambda: state.stream_inventory(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    spark.createDataFrame([("a", 5, day(2), "z"), ("c", 3, day(2), "w")], schema).write.mode("append").parquet(src)
    run()
    rows = {r.file_id: r for r in state.inventory_at(spark, str(tmp_path / "out"), 1).collect()}
    assert {k: r.size for k, r in rows.items()} == {"a": 5, "b": 2, "c": 3} and rows["a"].sha256 == "z"
    assert rows["a"].first_seen_at < rows["a"].changed_at == rows["c"].first_seen_at


def test_whole_listings_leave_tombstones_once(spark, tmp_path):
    schema = "file_id string, size long, mtime timestamp, sha256 string"
    day = lambda d: __import__("datetime").datetime(2024, 1, d)
    src = str(tmp_path / "in")
    for listing in (["a", "b"], ["a"], ["a", "c"]):
        spark.createDataFrame([(f, 1, day(1), f) for f in listing], schema).coalesce(1).write.mode("append").parquet(src)
        state.stream_inventory(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "check"), complete=True).awaitTermination()
    at = lambda n: {r.file_id: r.present for r in state.inventory_at(spark, str(tmp_path / "out"), n).collect()}
    assert at(0) == {"a": True, "b": True} and at(1) == {"a": True, "b": False} and at(2) == {"a": True, "c": True}


def test_a_batch_of_few_files_writes_few_rows(spark, tmp_path, monkeypatch):
    """Listings of 40 files of which few change, over whole inventories every third generation."""
    monkeypatch.setattr(state, "COMPACT", 3)
    schema = "file_id string, size long, mtime timestamp, sha256 string"
    day = lambda d: __import__("datetime").datetime(2024, 1, 1 + d)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    listing, states = {f"f{i:02d}": (1, day(0)) for i in range(40)}, []
    for g in range(8):
        if g:
            listing[f"f{g:02d}"] = (g + 9, day(g))  # one changes
            listing[f"new{g}"] = (1, day(g))  # one comes
            listing.pop(f"f{39 - g:02d}")  # one goes
            if g == 5:
                listing[f"f{38:02d}"] = (7, day(g))  # one is back
        states.append(dict(listing))
        spark.createDataFrame([(f, s, m, f) for f, (s, m) in listing.items()], schema).coalesce(1).write.mode("append").parquet(src)
        state.stream_inventory(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "check"), complete=True).awaitTermination()
    written = [spark.read.schema(state.INVENTORY).parquet(f"{out}/changes/generation={g}").count() for g in range(8)]
    assert written == [40, 3, 3, 3, 3, 4, 3, 3]
    for g, want in enumerate(states):
        rows = state.inventory_at(spark, out, g).collect()
        assert {r.file_id: r["size"] for r in rows if r.present} == {f: s for f, (s, _) in want.items()}
        assert sorted(r.file_id for r in rows if not r.present) == ([f"f{39 - g:02d}"] if g else [])


def test_segments_equal_counted_bytes():
    """Ranges added and taken back at random, against single bytes."""
    rng = random.Random(9)
    for _ in range(30):
        segments, count, given = state.Segments([], []), {}, []
        for _ in range(60):
            if given and rng.random() < 0.3:
                a, b = given.pop(rng.randrange(len(given)))
                by = -1
            else:
                a = rng.randrange(0, 60)
                b, by = a + rng.randrange(-1, 9), 1
                given.append((a, b))
            segments.add(a, b, by)
            for p in range(a, b + 1):
                count[p] = count.get(p, 0) + by
            covered = {p for p, n in count.items() if n > 0}
            assert segments.served == len(covered) and segments.islands == sum(p - 1 not in covered for p in covered)
            x = rng.randrange(0, 70)
            y = x + rng.randrange(-1, 12)
            assert segments.full(x, y) == next((p for p in range(x, y + 1) if count.get(p, 0) >= 2), None)
            assert segments.covers(x) == all(p in covered for p in range(x))
            assert all(m < n for m, n in zip(segments.marks, segments.marks[1:], strict=False))
            assert all(m != n for m, n in zip([0, *segments.counts], segments.counts, strict=False))
        again = state.Segments(segments.marks, segments.counts)
        assert (again.served, again.islands) == (segments.served, segments.islands)


def test_one_file_with_many_requests(spark, tmp_path):
    """All requests of one file: a mark is found by search, so a hot file is no slower a request than a cold one."""
    n = 150_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("oid"), F.lit("f").alias("fid"), "id", (F.col("id") * 7919 % 900_000).alias("start"), (F.col("id") * 7919 % 900_000 + 4).alias("end"))
    found = drained(spark, df, lambda s: state.stream_transfers(s, fragments=1 << 30), tmp_path)
    assert found.count() == n
    last = found.orderBy(F.desc("id")).first()
    want = df.select(F.explode(F.sequence("start", "end")).alias("p")).distinct().count()
    assert last.served == want


def test_files_as_a_stream(spark, tmp_path):
    from tallyvane.sources.files import stream_files
    from tallyvane.sources.logs import scan_audit, stream_audit, torn_tails

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text('{"seq":1,"message_type":"x","prev_hash":""}\n{"seq":2,"message_type":"y","prev_hash":"h"}\n')
    (src / "b.jsonl").write_text('{"seq":3,"message_type":"x"}\nno json\n{"seq":4,"mess')
    for name, stream in (("files", stream_files(spark, str(src))), ("log", stream_audit(spark, str(src)))):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / (name + "-c"))).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r.size for r in spark.read.parquet(str(tmp_path / "files")).collect()} == {(src / n).stat().st_size for n in ("a.jsonl", "b.jsonl")}
    assert spark.read.parquet(str(tmp_path / "log")).where("seq is not null").count() == 3
    assert [r.seq for r in scan_audit(spark, str(src)).where("seq is not null").orderBy("seq").collect()] == [1, 2, 3]
    torn = {r.part.rsplit("/", 1)[1]: (r.torn, r.bad_lines) for r in torn_tails(spark, str(src)).collect()}
    assert torn == {"a.jsonl": (False, 0), "b.jsonl": (True, 1)}


def test_files_share_states_over_batches(spark, tmp_path):
    """20,000 files of one group in three batches, and orders without a number: a state holds the files that a batch does not name, too."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema, big = "oid long, fid string, id long, start long, end long", (1 << 60) + 1
    for n in range(3):
        rows = spark.range(20_000).where(f"id % 3 <> {n}").selectExpr(f"id + {big} AS oid", "'f' AS fid", f"id * 3 + {n} AS id", "0L AS start", "9L AS end")
        rows.union(spark.createDataFrame([(None, None, -3 + n, 0, 9)], schema)).coalesce(1).write.mode("append").parquet(src)
        stream = state.stream_transfers(spark.readStream.schema(schema).parquet(src), buckets=1)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-check").trigger(availableNow=True).start().awaitTermination()
    got = {r.id: (r.oid, r.verdict, r.served) for r in spark.read.parquet(out).collect()}
    assert got == {i * 3 + n: (i + big, "granted", 10) for i in range(20_000) for n in range(3) if i % 3 != n} | {-3 + n: (None, "exhausted" if n == 2 else "granted", 10) for n in range(3)}
