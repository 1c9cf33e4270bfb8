"""Whitening against numpy's own eigenvectors, and slicing on spectra that are hard to number."""

import math
import warnings

import numpy as np
import pytest

from tallyvane.llm import queries as q
from tallyvane.llm import whitening as w

SF = "/root/testdata/sf0.001"


def symmetric(values, seed=0):
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = turn @ np.diag(values) @ turn.T
    return (a + a.T) / 2


SPECTRA = {
    "apart": [9, 7, 5, 4, 3, 2, 1.5, 1, 0.5, 0.1],
    "equal pairs": [5, 5, 4, 4, 4, 2, 2, 1, 1, 1],
    "all equal": [3.0] * 10,
    "near": [1 + 1e-9, 1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5 - 1e-12, 0.1, 0, 0, 0],
    "flat": [1e-3] + [0.0] * 9,
    "wide": [1e12, 1e6, 1, 1e-3, 0, 0, 0, 0, 0, 0],
    "signs": [3, 2, 1, 0, -1, -2, -3, -4, -5, -6],
}


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("seed", range(3))
def test_slices(name, seed):
    values = np.array(SPECTRA[name], float)
    a = symmetric(values, seed)
    found = w.sliced(a, 8)
    near = 1e-12 * np.abs(values).max()
    assert np.allclose(found.values, np.sort(values)[::-1][:8], rtol=0, atol=near)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(8), atol=1e-12)
    assert np.allclose(a @ found.vectors, found.vectors * found.values, atol=10 * near)


@pytest.mark.parametrize("seed", range(5))
def test_counts(seed):
    r = np.random.default_rng(seed)
    a = symmetric(r.standard_normal(17), seed)
    values = np.linalg.eigvalsh(a)
    for shift in [*((values[1:] + values[:-1]) / 2), -9, 9, *r.standard_normal(20)]:
        if np.abs(values - shift).min() > 1e-12:
            assert w.count_below(a, shift) == (values < shift).sum()
    assert w.count_below(np.array([[0.0, 1], [1, 0]]), 0.0) == 1 and w.count_below(np.zeros((3, 3)), 1.0) == 3


def test_no_variance_and_small():
    assert w.sliced(np.zeros((3, 3)), 8).values.tolist() == [0, 0, 0]
    assert np.allclose(w.sliced(np.array([[4.0]]), 8).values, [4])


def plain(rows, components=8):
    """(id, x) rows to (id, component) -> (n, deviation, |whitened|, explained)."""
    x = np.array([v for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for (i, _), row, c in zip(rows, x, centred, strict=True):
        off = sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))
        out += [(i, k + 1, n, off, abs(c @ vectors[:, k]) / math.sqrt(values[k]), values[k] / values.sum()) for k in range(min(components, x.shape[1]))]
    return out


def whole(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def ints(v):
    return [math.floor(float(np.float32(c)) * 1024) + 100_000 for c in v]


def same(got, want):
    key = lambda r: (str(r[0]), r[1], r[3], round(r[4], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and int(a[3]) == b[3]
        assert math.isclose(a[4], b[4], rel_tol=1e-6, abs_tol=1e-7) and math.isclose(a[5], b[5], rel_tol=1e-9)


def rows_of(df):
    return [(r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in df.collect()]


def test_query_by_numpy(spark):
    source = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    df = q.op13_whitening(spark, SF)
    same(rows_of(df), plain([(i, ints(v)) for i, v in source if whole(v)]))
    errors = {r[0] for r in df.select("identity_error").distinct().collect()}
    assert len(errors) == 1 and errors.pop() < 1e-9
    assert df.where("deviation <> deviation_exact").isEmpty()


def test_one_sign_for_all_rows(spark):
    """Whitened values have covariance one and mean zero, which mixed signs would break."""
    df = q.op13_whitening(spark, SF)
    found = df.groupBy("component").agg({"whitened": "avg", "*": "count"}).collect()
    assert all(abs(r["avg(whitened)"]) < 1e-9 for r in found)


def test_defined_cases(spark):
    r = np.random.default_rng(3)
    good = [(i, r.standard_normal(3).tolist()) for i in range(40)]
    good += [(None, good[0][1]), (5, good[5][1]), (5, good[5][1])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1e30, 0.0, 0.0]), (106, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 7, 8, 9) for i, v in good + bad], "vec_id bigint, embedding array<float>, x int, id int, n int").repartition(5)
    with pytest.warns(UserWarning, match="1 rows"):
        found = w.whitened(df)
    same(rows_of(found), plain([(i, ints(v)) for i, v in good]))


def test_flat_and_empty(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert w.whitened(spark.createDataFrame([], schema)).collect() == []
    rows = w.whitened(spark.createDataFrame([(i, [0.5] * 9) for i in range(4)], schema)).collect()
    assert len(rows) == 32 and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] == 0 for r in rows)
    line = w.whitened(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], schema)).orderBy("component").collect()
    assert line[0]["explained"] == pytest.approx(1) and line[-1]["whitened"] is None and line[0]["identity_error"] < 1e-12


def test_exact_beyond_a_long():
    x = np.array([[1 << 50, 3], [0, 4]])
    n = 10**9
    whole_part, rest = np.array([1 << 48, 3]), np.array([5, 7])
    want = [sum((n * (int(a) - int(b)) - int(c)) ** 2 for a, b, c in zip(row, whole_part, rest, strict=True)) for row in x]
    assert w.deviations(x, whole_part, rest, n) == want and want[0] > 1 << 63


def test_no_warning_on_the_table(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        w.whitened(spark.read.parquet(f"{SF}/embeddings.parquet"))
