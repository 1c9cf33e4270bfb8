"""Read plans, archives, profiles and scans on small cases."""

import gzip
import hashlib
import hmac
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from tallyvane.functions import ids
from tallyvane.operators import inventory, ledger, listing, profile
from tallyvane.sources import archives, files, text

SEED = "22" * 32
FORMATS = ["txt", "txt", "zip", "csv", "txt"]
IDENTITIES, SIZES = ["a", "b", "c", "d", "é"], [100, 2, 3, 1, 2]


def test_planned_read_set_by_brute_force(spark):
    rows = [("L", i, s, f) for i, s, f in zip(IDENTITIES, SIZES, FORMATS, strict=True)]
    got = {r.identity for r in listing.planned_read_set(spark.createDataFrame(rows, "listing_id string, identity string, size long, format string"), SEED, 4, 3).collect()}
    left, want = 4, set()
    for _, i, s, f in sorted((r for r in rows if r[3] != "csv"), key=lambda r: (hmac.digest(bytes.fromhex(SEED), r[1].encode(), "sha256"), r[1])):
        cost = 3 if f == "zip" else s
        if cost <= left:
            want.add(i)
            left -= cost
    assert got == want


def test_large_listings_are_planned_by_rounds(spark, monkeypatch):
    rows = [(listing, f"{listing}{i}", (i * i * 37) % 900 + (i % 7 > 0), "csv" if i % 11 == 0 else "txt") for listing, n in (("L", 400), ("M", 30), (None, 200)) for i in range(n)]
    folded = []
    monkeypatch.setattr(listing, "FOLD_MAX", 40)
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", lambda self, f, s, old=GroupedData.applyInPandas: folded.append(self._df.groupBy("listing_id").count().collect()) or old(self, f, s))
    got = listing.planned_read_set(spark.createDataFrame(rows, "listing_id string, identity string, size long, format string"), SEED, 6_000, 3)
    want = []
    for name in ("L", "M", None):
        left = 6_000
        for r in sorted((r for r in rows if r[0] == name and r[3] != "csv"), key=lambda r: (hmac.digest(bytes.fromhex(SEED), r[1].encode(), "sha256"), r[1])):
            if r[2] <= left:
                want.append(r[:2])
                left -= r[2]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert all(r["count"] <= 40 for r in folded[0])  # no task is given a large listing


def test_digests_gather_no_listing(spark):
    rows = [(listing, f"{i * 7919 % 1000:04d}", i, f"{i:064x}", '"e"', None, "txt") for listing, n in (("L", 700), ("M", 1), (None, 130)) for i in range(n)]
    df = spark.createDataFrame([*rows, ("Z", None, None, None, None, None, "txt")], "listing_id string, identity string, size long, sha256 string, etag string, version_id string, format string")
    out = listing.ordered_digest(df.repartition(5))
    want = {"Z": hashlib.sha256().hexdigest()}
    for name in ("L", "M", None):
        parts = [len(r[1]).to_bytes(8, "big") + r[1].encode() + r[2].to_bytes(8, "big") + bytes.fromhex(r[3]) for r in sorted((r for r in rows if r[0] == name), key=lambda r: r[1])]
        want[name] = hashlib.sha256(b"".join(parts)).hexdigest()
    assert {r.listing_id: r.digest for r in out.collect()} == want
    folded = df.where("identity is not null").selectExpr("listing_id", "size as object_id", "array(identity) names", "array('x') types")
    for plan in (out, listing.fingerprint(folded), listing.unread_binding(df, df.limit(0).select("listing_id", "identity"))):
        assert "collect_list" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("message", [b"", b"abc", bytes(range(256))])
def test_hmac(spark, message):
    df = spark.createDataFrame([(bytearray(message),)], "m binary")
    assert df.select(ids.hmac_sha256(SEED, F.col("m")).alias("x")).first().x == hmac.digest(bytes.fromhex(SEED), message, "sha256").hex()


def test_identity_is_composed(spark):
    df = spark.createDataFrame([("é", "tag", "null"), ("a", "", ""), ("k", "t", "v")], "k string, e string, v string")
    assert [r.x for r in df.select(ids.identity(F.col("k"), F.col("e"), F.col("v")).alias("x")).collect()] == ["é\x00tag", None, "k\x00v"]


def archive(kind):
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a.txt", "x" * 500)
            z.writestr("b/", "")
            z.writestr("b/c.txt", "hello")
    elif kind == "tar":
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            info = tarfile.TarInfo("a.txt")
            info.size = 5
            t.addfile(info, io.BytesIO(b"hello"))
    elif kind == "gzip":
        out.write(gzip.compress(b"only text"))
    else:
        out.write(b"PK\x03\x04 broken")
    return out.getvalue()


def test_archives(spark):
    rows = [(k, bytearray(archive(k))) for k in ("zip", "tar", "gzip", "broken")]
    entries = archives.expand_archives(spark.createDataFrame(rows, "member string, content binary"))
    got = {(r.member, r.entry): (r.size, r.state, r.reason) for r in entries.collect()}
    assert got == {("zip", "a.txt"): (500, "read", None), ("zip", "b/c.txt"): (5, "read", None), ("tar", "a.txt"): (5, "read", None), ("gzip", None): (0, "unread", "no_archive", )[:3], ("broken", None): (0, "unread", "corrupt")}
    up = {r.member: (r.opened, r.partial, r.entries, r.bytes) for r in archives.archive_rollup(entries).collect()}
    assert up["zip"] == (True, False, 2, 505) and up["broken"] == (False, True, 0, 0)


def test_archive_budget(monkeypatch):
    monkeypatch.setattr(archives, "ALLOWANCE", 400)
    rows = archives.entries_of("m", archive("zip"))
    assert [(r[2], r[6], r[7]) for r in rows] == [("a.txt", "unread", "budget_exhausted"), ("b/c.txt", "unread", "budget_exhausted")]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.bin").write_bytes(b"a" * 10)
    (tmp_path / "y.txt").write_text("hi")
    listed = {r.relative_path: r.size for r in files.list_files(spark, {"r": str(tmp_path)}).collect()}
    assert listed == {"sub/x.bin": 10, "y.txt": 2}
    digests = {r.path.rsplit("/", 1)[1]: r.sha256 for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert digests["y.txt"] == hashlib.sha256(b"hi").hexdigest()
    blocks = sorted((r.block, r.digest) for r in files.file_block_digests(spark, str(tmp_path / "sub"), 8).collect())
    assert blocks == [(0, hashlib.sha256(b"a" * 8).hexdigest()), (1, hashlib.sha256(b"aa").hexdigest())]


def test_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿keep,secret\n1,"x ""y"",\nz"\n2\n,b\n')
    rows = text.scan_delimited(spark, str(p))
    assert rows.columns[1] == "secret" and [tuple(r) for r in rows.collect()] == [("1", 'x "y",\nz'), ("2", None), (None, "b")]
    assert text.scan_delimited(spark, str(p), strict=True).columns == ["keep", "secret"]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a":1,"b":null}\n\n{"b":"x"}\n')
    rows = text.jsonl_columns(text.scan_jsonl(spark, str(p), strict=True), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in rows] == [("1", None), (None, "x")]
    for bad in ('{"a":{"b":1}}', '{"a":1,"a":2}', "[1]", "no"):
        p.write_text(bad + "\n")
        with pytest.raises(Exception, match="flat JSON"):
            text.scan_jsonl(spark, str(p), strict=True).collect()


def test_profile_rules(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", None)], "keep long, secret string, none string")
    out = {r.name: (r.type, r.row_count, r.null_rate_pct, r.distinct_bucket) for r in profile.profile(df, {"keep": "k"}, ["secret"]).collect()}
    assert out == {"k": ("integer", 2, 0, "2-10"), "none": ("string", 2, 100, "1")}
    nested = spark.createDataFrame([([1],)], "a array<int>")
    assert profile.profile(nested).collect() == []
    empty = {r.name: r.null_rate_pct for r in profile.profile(df.limit(0)).collect()}
    assert empty == {"keep": None, "secret": None, "none": None}


@pytest.mark.parametrize("n", [1, 5, 50, 500, 2000])
def test_distinct_buckets(spark, n):
    row = profile.profile(spark.range(n).selectExpr("cast(id as string) v")).first()
    assert row.distinct_bucket == {1: "1", 5: "2-10", 50: "11-100", 500: "101-1000", 2000: ">1000"}[n]


def test_facts_suppress_small_groups(spark):
    df = spark.range(20).selectExpr("if(id < 3, null, id) a", "cast(id as string) b", "cast(null as int) c")
    facts = {r.name: r for r in profile.facts(df, SEED).collect()}
    assert facts["a"].null_rate is None and facts["a"].estimate >= 10 and facts["a"].numeric is None
    assert facts["b"].null_rate == "0.000000" and facts["b"].estimate >= 10
    assert facts["c"].null_rate == "1.000000" and facts["c"].estimate == 0
    few = profile.facts(df.limit(5), SEED).collect()
    assert all(r.null_rate is None and r.estimate is None for r in few)


def test_ceiling_and_batches(spark):
    df = spark.createDataFrame([("a/b.csv",), ("a/x/b.csv",), ("c/d/e",), ("c",)], "p string")
    assert [r.p for r in df.where(ledger.within_ceiling(F.col("p"), ["a/*.csv", "c/**"])).collect()] == ["a/b.csv", "c/d/e"]
    many = spark.range(1001).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("k"))
    sizes = sorted(r["count"] for r in inventory.batches(many, "k").groupBy("batch").count().collect())
    assert sizes == [1, 1000]


def test_generation_sink_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "inv")
    files.write_generation(spark.range(3), path, 1)
    files.write_generation(spark.range(5), path, 2)
    files.write_generation(spark.range(4), path, 1)
    assert {r.generation: r["count"] for r in spark.read.parquet(path).groupBy("generation").count().collect()} == {1: 4, 2: 5}


def test_strict_json_lines(spark, tmp_path):
    from tallyvane.sources.text import scan_jsonl

    good = ['{"a":"[draft] note","b":"{x}"}', '{"a":1,"b":null}', "", '{"a":" [1]","c":true}']
    (tmp_path / "good.jsonl").write_text("\n".join(good))
    rows = scan_jsonl(spark, str(tmp_path / "good.jsonl"), strict=True).orderBy("pos").collect()
    assert [r.fields for r in rows] == [{"a": "[draft] note", "b": "{x}"}, {"a": "1", "b": None}, {"a": " [1]", "c": "true"}]
    for bad in ('{"a":[1]}', '{"a":{"b":1}}', '{"a":1,"a":2}', "[1]", "word", '{"a":"[x]","b":[]}'):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(Exception, match="not a flat JSON object"):
            scan_jsonl(spark, str(tmp_path / "bad.jsonl"), strict=True).collect()


def test_chained_lines_follow_over_parts(spark):
    import hashlib

    from tallyvane.operators.ledger import chained, check_chain

    rows = [(i, f"line {i}", f"p{(i * 7 // 10) % 9}") for i in range(30) if (i * 7 // 10) % 9 == i * 7 // 10]
    log = spark.createDataFrame(rows, "seq long, line string, part string").repartition(5)
    got = chained(log, "seq", "line", "part").orderBy("seq").collect()
    digest = lambda line: hashlib.sha256(line.encode()).hexdigest()
    assert [r.before for r in got] == [None, *(digest(line) for _, line, _ in rows[:-1])]
    whole = spark.createDataFrame([(r.seq, r.line, r.part, r.before or "") for r in got], "seq long, line string, part string, prev string")
    assert check_chain(whole, "seq", "line", "prev", "part").collect() == []


def test_listings_over_the_cap_are_refused(spark, tmp_path):
    from tallyvane.sources.files import list_files

    for i in range(3):
        (tmp_path / f"f{i}.txt").write_text("x")
    assert list_files(spark, {"root": str(tmp_path)}, cap=3).count() == 3
    with pytest.raises(Exception, match="more than 2 files"):
        list_files(spark, {"root": str(tmp_path)}, cap=2).collect()


def test_batches_of_any_keys(spark):
    from tallyvane.operators.inventory import batches

    keys = [f"/same/root/{i:05d}" for i in range(2345)]
    df = spark.createDataFrame([(k,) for k in keys], "path string").repartition(7)
    assert {r.path: r.batch for r in batches(df, "path", 100).collect()} == {k: i // 100 for i, k in enumerate(keys)}
    assert batches(df.limit(0), "path").collect() == []
