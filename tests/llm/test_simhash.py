import random

import pytest
import xxhash

from tallyvane.llm import simhash
from tallyvane.llm.components import components


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, "One", "a B", "a b c", "Ä a\tb\x0bc d  e", "x " * 500, "the cat sat on the mat " * 9 + "END"])
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint((text or "").encode()) % 2**64 == brute_fingerprint(text)


def test_tally_of_lists_tells_shared_bytes():
    for wrong in range(256):
        met = sum(all(not wrong >> b & 1 or b in left_out for b in range(8)) for left_out in simhash.OPEN)
        assert (met >= simhash.MIN_LISTS) == (bin(wrong).count("1") <= simhash.BYTES - simhash.MIN_SHARED)


def test_links_connect_as_all_pairs_do(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    centre = rng.getrandbits(64)
    fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)]  # long lists
    chain = rng.getrandbits(64)
    for _ in range(30):  # a chain: ends far apart, neighbours within two bits
        chain ^= sum(1 << b for b in rng.sample(range(64), 2))
        fps.append(chain)
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    rows = links.collect()
    assert rows and all(bin((r.a ^ r.b) % 2**64).count("1") <= 2 for r in rows)
    label = {r.node: r.label for r in components(links).collect()}
    got = [label.get(f, f) for f in signed]
    want = brute_components(fps)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_near_duplicates_nulls_copies_and_clashing_columns(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(5, base, 1), (3, base, 2), (9, None, 3), (8, "", 4), (None, base, 5), (3, base, 6), (7, "another text entirely with words", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 3, 3), (False, 3, 3), (False, 5, 3), (False, 7, 7), (False, 8, 8), (False, 9, 8), (True, 0, 3)]
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def test_query_equals_brute_force(spark):
    from tallyvane.llm.queries import op3_simhash

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(d.text) for d in docs]
    roots = brute_components(fps)
    least = {}
    for d, r in zip(docs, roots, strict=True):
        least[r] = min(least.get(r, d.doc_id), d.doc_id)
    want = {(d.doc_id, f"{f:016x}", least[r]) for d, f, r in zip(docs, fps, roots, strict=True)}
    assert {tuple(r) for r in op3_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_any_id_column(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, None)], "id long, digest string")
    assert sorted(r.id for r in simhash.one_per_group(docs, "id", "digest").collect()) == [1, 3]
    assert sorted(r.component_id for r in simhash.near_duplicates(docs, "id", "digest").collect()) == [1, 1, 3]


@pytest.mark.parametrize("name", ["__id", "__digest", "id", "fp", "first", "root", "key"])
def test_clashing_names_of_groups(spark, name):
    docs = spark.createDataFrame([(2, "a b c d", 7), (1, "a b c d", 8), (3, "something else altogether here", 9)], f"doc_id long, text string, `{name}` int")
    assert sorted(map(tuple, simhash.one_per_group(docs).collect())) == [(1, "a b c d", 8), (3, "something else altogether here", 9)]
