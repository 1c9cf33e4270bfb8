"""Running values over hot keys, in many segments, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tallyvane.operators import intervals as I
from tallyvane.operators import ledger, scans

KEYS = ["oid", "fid"]


def plain(rows):
    """rows (key, at, value) -> (key, at) -> sum, max, max before, next, min from."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == key)
        for i, (at, _) in enumerate(own):
            values = [v for _, v in own if v is not None]
            upto, before, rest = ([v for _, v in part if v is not None] for part in (own[: i + 1], own[:i], own[i:]))
            del values
            out[key, at] = (sum(upto) if upto else None, max(upto, default=None), max(before, default=None), own[i + 1][0] if i + 1 < len(own) else None, min(rest, default=None))
    return out


@pytest.mark.parametrize("rows", [1, 5, 40, 10_000])
def test_every_running_value(spark, rows):
    r = random.Random(rows)
    given = [("hot" if r.random() < 0.7 else None if r.random() < 0.3 else r.choice("ab"), i, r.choice([None, r.randrange(-9, 9)])) for i in r.sample(range(5_000), 400)]
    df = spark.createDataFrame(given, "k string, at long, v long").repartition(5)
    hot = scans.hot_keys(df, ["k"], rows)
    assert (hot is None) == (rows == 10_000)
    v = F.col("v")
    found = scans.scan(df, ["k"], ["at"], hot, rows, s=("sum", v), m=("max", v), b=("max_before", v), n=("next", F.col("at")), f=("min_from", v))
    assert found.columns == ["k", "at", "v", "s", "m", "b", "n", "f"]
    assert {(x.k, x.at): (x.s, x.m, x.b, x.n, x.f) for x in found.collect()} == plain(given)


def test_one_key_is_many_segments(spark):
    df = spark.range(2_000).select(F.lit("only").alias("k"), F.col("id").alias("at"))
    hot = scans.hot_keys(df, ["k"], 50)
    sizes = [x["count"] for x in scans.segmented(df, ["k"], "at", hot, 50).groupBy("_segment").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 600 and sum(sizes) == 2_000


def test_rows_of_one_position_stay_together(spark):
    df = spark.createDataFrame([("k", 7, i) for i in range(100)], "k string, at long, v long")
    found = scans.scan(df, ["k"], ["at", "v"], scans.hot_keys(df, ["k"], 3), 3, s=("sum", F.col("v")))
    assert max(x.s for x in found.collect()) == 4950


@pytest.fixture(params=[3, 1 << 20])
def segment(request, monkeypatch):
    monkeypatch.setattr(scans, "SEGMENT", request.param)
    return request.param


def test_intervals_of_a_hot_file(spark, segment):
    """Serves, islands, containment, first exhausted bytes and unwritten ones, byte by byte."""
    r = random.Random(8)
    rows = [(1, "f" if r.random() < 0.8 else "g", i, s := r.randrange(0, 300), s + r.randrange(-1, 12)) for i in range(150)]
    df = spark.createDataFrame(rows, "oid long, fid string, id long, start long, end long").repartition(4)
    count = {}
    for o, f, _, a, b in rows:
        for p in range(a, b + 1):
            count[o, f, p] = count.get((o, f, p), 0) + 1
    serves = I.serve_counts(df, KEYS)
    told = {(x.oid, x.fid, p): x["count"] for x in serves.collect() for p in range(x.start, x.end + 1)}
    assert told == count
    assert all(a["end"] + 1 < b.start or a["count"] != b["count"] for a, b in zip(*(lambda s: (s, s[1:]))(sorted(serves.collect())), strict=False) if a[:2] == b[:2])
    some = df.where("id % 2 = 0")
    islands = I.coverage_islands(some, KEYS)
    covered = {(o, f, p) for o, f, i, a, b in rows if i % 2 == 0 for p in range(a, b + 1)}
    held = sorted(map(tuple, islands.collect()))
    assert {(o, f, p) for o, f, a, b in held for p in range(a, b + 1)} == covered
    assert all(x[:2] != y[:2] or x[3] + 1 < y[2] for x, y in zip(held, held[1:], strict=False))
    asked = df.where("start <= end")
    inside = {x.id for x in I.contained(asked, islands, KEYS).collect()}
    assert inside == {i for o, f, i, a, b in rows if a <= b and all((o, f, p) in covered for p in range(a, b + 1))}
    first = {x.id: x.exhausted for x in I.first_exhausted(df, serves, KEYS).collect()}
    assert first == {i: next((p for p in range(a, b + 1) if count[o, f, p] >= 2), None) for o, f, i, a, b in rows}
    unwritten = {(x.oid, x.fid): x.unwritten for x in I.unwritten_exhausted(serves, islands, KEYS).collect()}
    want = {}
    for (o, f, p), n in count.items():
        if n == 2:
            want[o, f] = want.get((o, f), 0) + ((o, f, p) not in covered)
    assert unwritten == want


def test_high_water_of_a_hot_listing(spark, segment):
    r = random.Random(2)
    rows = [("x" if r.random() < 0.9 else None, i, 1_000 * i - r.choice([0, 0, 900_000])) for i in range(120)]
    df = spark.createDataFrame(rows, "listing string, id long, s long").repartition(3)
    got = {x.id: (x.high, x.late) for x in ledger.clock_high_water(df, "listing", "id", "s").collect()}
    high, want = {}, {}
    for k, i, s in rows:
        want[i] = (high.get(k), k in high and s < high[k] - 300)
        high[k] = max(high.get(k, s), s)
    assert got == want


def test_quota_ranks_no_whole_key(spark):
    """One key with most rows: ranks are taken of ten rows a task, all others are compared."""
    rows = [("hot" if i % 10 else None, 1_000 - i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, id long").repartition(6)
    out = ledger.admit_quota(df, ["k"], ["t", "id"], 10)
    got = {x.id for x in out.where("admitted").collect()}
    want = {i for k in ("hot", None) for _, i in sorted((t, i) for kk, t, i in rows if kk == k)[:10]}
    assert got == want and out.columns == ["k", "t", "id", "admitted"] and out.count() == 400
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
