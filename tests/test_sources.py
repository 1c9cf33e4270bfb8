"""Files beyond a row's size, delimited files in parts, archives that break."""

import gzip
import hashlib
import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from tallyvane.sources import archives, files, text


def test_files_beyond_two_gib(spark, tmp_path):
    """A sparse file of 3 GiB and a few bytes: its blocks are read by many tasks, the whole in one pass."""
    path, size = tmp_path / "big" / "a b%20+ä.bin", (3 << 30) + 5
    path.parent.mkdir()
    with open(path, "wb") as f:
        f.truncate(size)
        f.seek(size - 5)
        f.write(b"tail!")
    (path.parent / "small.bin").write_bytes(b"x" * 10)
    (path.parent / "empty.bin").write_bytes(b"")
    block = 64 << 20
    found = files.file_block_digests(spark, str(path.parent), block).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    big = {r.block: r.digest for r in rows if r.name == path.name}
    zero = hashlib.sha256(bytes(block)).hexdigest()
    assert big == {i: zero for i in range(48)} | {48: hashlib.sha256(b"tail!").hexdigest()}
    assert len({r.task for r in rows if r.name == path.name}) >= 3
    assert [(r.block, r.digest) for r in rows if r.name == "small.bin"] == [(0, hashlib.sha256(b"x" * 10).hexdigest())]
    whole = hashlib.sha256()
    for _ in range(48):
        whole.update(bytes(block))
    whole.update(b"tail!")
    told = {r.path.rsplit("/", 1)[1]: (r["size"], r.sha256) for r in files.file_digests(spark, str(path.parent)).collect()}
    assert told == {path.name: (size, whole.hexdigest()), "small.bin": (10, hashlib.sha256(b"x" * 10).hexdigest())}
    assert {r.relative_path: r["size"] for r in files.list_files(spark, {"x": str(path.parent)}).collect()} == {path.name: size, "small.bin": 10, "empty.bin": 0}


@pytest.mark.parametrize("size", [1, 99, 100, 101, 1000])
def test_ranges_and_rows_agree(spark, tmp_path, size):
    content = random.Random(size).randbytes(size)
    (tmp_path / "f").write_bytes(content)
    want = [(i, hashlib.sha256(content[i * 100 : i * 100 + 100]).hexdigest()) for i in range(-(-size // 100))]
    for most in (0, 1 << 20):
        assert sorted((r.block, r.digest) for r in files.file_block_digests(spark, str(tmp_path), 100, most).collect()) == want
        assert [r.sha256 for r in files.file_digests(spark, str(tmp_path), most).collect()] == [hashlib.sha256(content).hexdigest()]


def cells(r):
    return r.choice(["plain", "", "a,b", 'say "x"', "two\nlines", 'end"\n"begin', "\n\n", "ä€", " pad ", '"', "x" * 300, "\r\nz", "it's"])


def quoted(v, r):
    return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r') or r.random() < 0.2 else v


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("lines", [7, 1 << 17])
def test_parts_equal_the_whole(spark, tmp_path, monkeypatch, end, lines):
    """Quoted line ends across many byte ranges of two files, against one task per file."""
    monkeypatch.setattr(text, "LINES", lines)
    r = random.Random(lines)
    for name in ("a.csv", "b.csv"):
        rows = [["id", "left", "right"]] + [[str(i), cells(r), cells(r) or "z"] for i in range(600)]
        (tmp_path / name).write_text(end.join(",".join(quoted(v, r) for v in row) for row in rows) + (end if name == "a.csv" else ""), newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = text.scan_delimited(spark, str(tmp_path))
        want = text.scan_delimited(spark, str(tmp_path), whole=True)
        assert got.columns == want.columns == ["id", "left", "right"]
        key = lambda row: [str(v) for v in row]
        plain = lambda row: tuple(v.replace("\r\n", "\n") if v else v for v in row)
        a, b = sorted(map(tuple, got.collect()), key=key), sorted(map(plain, want.collect()), key=key)
        assert len(b) == 1200 and a == b
        parts = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
        assert parts >= 10 and want.rdd.getNumPartitions() <= 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_strict_and_tolerant_rows(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("﻿a\tb\n1\t\n2\n\n\"3\"\t\"x\ty\"\n", encoding="utf-8")
    rows = [tuple(r) for r in text.scan_delimited(spark, str(tmp_path / "t.tsv"), "\t").collect()]
    assert sorted(rows) == [("1", None), ("2", None), ("3", "x\ty")] and text.scan_delimited(spark, str(tmp_path / "t.tsv"), "\t").columns[0] == "﻿a"
    with pytest.raises(Exception, match="(?i)malformed|MALFORMED"):
        text.scan_delimited(spark, str(tmp_path / "t.tsv"), "\t", strict=True).collect()
    (tmp_path / "s.csv").write_text("﻿a,b\n1,\n", encoding="utf-8")
    strict = text.scan_delimited(spark, str(tmp_path / "s.csv"), strict=True)
    assert strict.columns == ["a", "b"] and [tuple(r) for r in strict.collect()] == [("1", "")]


def test_a_quote_that_never_ends_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "RECORD", 1000)
    (tmp_path / "a.csv").write_text('a,b\n1,"never\n' + "x,y\n" * 1000)
    with pytest.raises(Exception, match="more than 1000 bytes"):
        text.records(spark, str(tmp_path)).collect()


def test_empty_and_header_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    df = text.scan_delimited(spark, str(tmp_path))
    assert df.columns == ["a", "b"] and df.collect() == []


def test_entries_before_a_break_stay(spark):
    """Six entries; the archive is cut within the fifth."""
    r, out = random.Random(1), io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for i in range(6):
            info = tarfile.TarInfo(f"e{i}")
            info.size = 20_000
            t.addfile(info, io.BytesIO(r.randbytes(20_000)))
    whole = gzip.compress(out.getvalue(), mtime=0)
    rows = [("whole", whole), ("cut", whole[:90_000]), ("head", whole[:700]), ("none", b"\x1f\x8b")]
    found = archives.expand_archives(spark.createDataFrame(rows, "member string, content binary"))
    told = {m: [(x.entry, x.state, x.reason) for x in found.where(F.col("member") == m).orderBy(F.col("i") < 0, "i").collect()] for m, _ in rows}
    assert told["whole"] == [(f"e{i}", "read", None) for i in range(6)]
    assert told["cut"] == [(f"e{i}", "read", None) for i in range(4)] + [(None, "unread", "corrupt")]
    assert told["head"] == [(None, "unread", "corrupt")] and told["none"] == [(None, "unread", "no_archive")]
    rolled = {x.member: (x.opened, x.partial, x.entries, x.bytes) for x in archives.archive_rollup(found).collect()}
    assert rolled["whole"] == (True, False, 6, 120_000) and rolled["cut"] == (True, True, 4, 80_000) and rolled["head"][:2] == (False, True)


def test_listing_follows_no_links(spark, tmp_path):
    """A tree with links to files, to folders, out of the root and round in a cycle."""
    root, outside = tmp_path / "root", tmp_path / "outside"
    (root / "a" / "b" / "c").mkdir(parents=True)
    outside.mkdir()
    for p in (root / "x.csv", root / "a" / "ä %20y.csv", root / "a" / "b" / "c" / "deep", outside / "secret"):
        p.write_text(p.name)
    (root / "escape").symlink_to(outside / "secret")
    (root / "a" / "out").symlink_to(outside)
    (root / "a" / "b" / "cycle").symlink_to(root)
    (root / "gone").symlink_to(tmp_path / "nothing")
    (tmp_path / "door").symlink_to(root)
    want = {"x.csv": 5, "a/ä %20y.csv": len("ä %20y.csv".encode()), "a/b/c/deep": 4}
    for start in (root, tmp_path / "door", f"file://{root}/"):  # a root may be a link
        rows = files.list_files(spark, {"one": str(start), "two": str(outside)}).collect()
        assert {r.relative_path: r["size"] for r in rows if r.source == "one"} == want
        assert [(r.relative_path, r["size"]) for r in rows if r.source == "two"] == [("secret", 6)]
        assert all(abs(r.mtime.timestamp() - (root / "x.csv").stat().st_mtime) < 60 for r in rows)
    digests = {r.path.rsplit("/", 1)[1] for r in files.list_files(spark, {"one": str(root)}).join(files.file_digests(spark, str(root)), "path").collect()}
    assert digests == {"x.csv", "ä %20y.csv", "deep"}


def test_a_listing_over_the_cap_is_refused(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}").write_text("x")
    assert files.list_files(spark, {"s": str(tmp_path)}, cap=5).count() == 5
    with pytest.raises(Exception, match="more than 4 files"):
        files.list_files(spark, {"s": str(tmp_path)}, cap=4).collect()
    assert files.list_files(spark, {"s": str(tmp_path)}, cap=None).count() == 5
    (tmp_path / "none").mkdir()
    assert files.list_files(spark, {"s": str(tmp_path / "none")}).collect() == []
