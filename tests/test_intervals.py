"""Interval jobs against brute force over byte arrays, on several partitionings."""

import random

import pytest

from tallyvane.operators import intervals as I
from tallyvane.streaming import state

KEYS = ["oid", "fid"]


def ranges(seed, n=120, size=60):
    rng = random.Random(seed)
    return [(i, rng.randint(0, 2), rng.choice("ab"), s := rng.randint(0, size), s + rng.randint(-1, 9)) for i in range(n)]


def bytes_of(rows):
    out = {}
    for _, oid, fid, a, b in rows:
        cell = out.setdefault((oid, fid), [0] * 80)
        for x in range(a, b + 1):
            cell[x] += 1
    return out


def runs(levels):
    out = []
    for x, n in enumerate(levels):
        if n and out and out[-1][1] == x - 1 and out[-1][2] == n:
            out[-1] = (out[-1][0], x, n)
        elif n:
            out.append((x, x, n))
    return out


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_serves_islands_and_joins(spark, parts):
    rows = ranges(parts)
    df = spark.createDataFrame(rows, "id long, oid long, fid string, start long, end long").repartition(parts)
    levels = bytes_of(rows)
    serves = I.serve_counts(df.drop("id"), KEYS)
    got = {}
    for r in serves.collect():
        got.setdefault((r.oid, r.fid), []).append((r.start, r.end, r["count"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: runs(v) for k, v in levels.items() if any(v)}
    islands = I.coverage_islands(df, KEYS)
    got = {}
    for r in islands.collect():
        got.setdefault((r.oid, r.fid), []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: [x[:2] for x in runs([min(n, 1) for n in v])] for k, v in levels.items() if any(v)}

    live = [r for r in rows if r[3] <= r[4]]
    asked = spark.createDataFrame(live, "id long, oid long, fid string, start long, end long")
    for cell in (4, 1 << 20):
        I.CELL = cell
        met = {(r.id, r.start2) for r in I.overlapping(asked, serves.select(*KEYS, "start", "end"), KEYS, cell).collect()}
        want = {(i, a) for i, o, f, s, e in live for a, b, _ in runs(levels[o, f]) if a <= e and b >= s}
        assert met == want
    first = {r.id: r.exhausted for r in I.first_exhausted(asked, serves, KEYS).collect()}
    for i, o, f, s, e in live:
        assert first[i] == min((max(s, a) for a, b, n in runs(levels[o, f]) if n >= 2 and a <= e and b >= s), default=None)
    some = I.coverage_islands(df.where("id % 2 = 0"), KEYS)
    sent = bytes_of([r for r in rows if r[0] % 2 == 0])
    unwritten = {(r.oid, r.fid): r.unwritten for r in I.unwritten_exhausted(serves, some, KEYS).collect()}
    assert unwritten == {k: sum(n == 2 and not (k in sent and sent[k][x]) for x, n in enumerate(v)) for k, v in levels.items() if 2 in v}
    half = bytes_of([r for r in rows if r[0] % 2 == 0])
    inside = {r.id for r in I.contained(asked, some, KEYS).collect()}
    assert inside == {i for i, o, f, s, e in live if (o, f) in half and all(half[o, f][s : e + 1])}


def test_settle_and_resume(spark):
    r = spark.createDataFrame([(1, 0, 99, 10, False), (2, 0, 99, 10, True), (3, 5, 7, 7, False)], "id long, start long, end long, written_through long, crashed boolean")
    out = {x.id: (x.returned_from, x.returned_bytes) for x in I.settle(r, window=20).collect()}
    assert out == {1: (11, 89), 2: (31, 69), 3: (8, 0)}
    islands = spark.createDataFrame([(1, "a", 0, 9), (1, "a", 20, 29), (2, "a", 3, 9)], "oid long, fid string, start long, end long")
    sizes = spark.createDataFrame([(1, "a", 100), (2, "a", 10), (3, "a", 0)], "oid long, fid string, size long")
    assert {x.oid: x.offset for x in I.resume_offset(islands, sizes, KEYS).collect()} == {1: 10, 2: 0, 3: 0}
    assert [x.oid for x in I.completions(islands, sizes, KEYS).collect()] == [3]


def test_streamed_state_equals_batches_of_bytes():
    rng, segments, levels = random.Random(3), [], [0] * 80
    for _ in range(300):
        a = rng.randint(0, 60)
        b = a + rng.randint(0, 9)
        end = state.grant(segments, a, b)
        blocked = next((x for x in range(a, b + 1) if levels[x] >= 2), None)
        assert end == (b if blocked is None else blocked - 1 if blocked > a else None)
        if end is not None:
            segments = state.add_range(segments, a, end)
            for x in range(a, end + 1):
                levels[x] += 1
        assert segments == runs(levels)
