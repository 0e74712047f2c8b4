"""Whitening against numpy over all rows, and its defined cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelry.llm.queries import op12_embedding_whitening
from parcelry.llm.whitening import fixed_point, whiten

VEC = "vec_id long, x array<long>"


def plain(x, weights, components=16):
    """Exact sums by Python integers, then the covariance's eigenvectors."""
    n, sums = sum(weights), [sum(int(v) * w for v, w in zip(column, weights)) for column in zip(*x)]
    c = np.array([[(n * int(v) - s) / n for v, s in zip(row, sums)] for row in x])
    cov = (c * np.array(weights)[:, None]).T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return n, deviation, c @ vectors / np.sqrt(values), values / np.trace(cov)


def compare(got, keys, x, weights):
    n, deviation, whitened, share = plain(x, weights)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], r)
    k = whitened.shape[1]
    signs = None
    for key, d, w in zip(keys, deviation, whitened):
        own = by[key]
        assert sorted(own) == list(range(1, k + 1))
        y = np.array([own[i + 1]["whitened"] for i in range(k)])
        signs = np.sign(y * w) if signs is None else signs
        assert np.allclose(y * signs, w, rtol=1e-7, atol=1e-9)
        assert all(r["n"] == n and r["deviation"] == d and r["identity_error"] < 1e-8 for r in own.values())
        assert np.allclose([own[i + 1]["explained"] for i in range(k)], share, rtol=1e-9)


@pytest.mark.parametrize("counts", [False, True])
def test_equals_numpy(spark, counts):
    rng = np.random.default_rng(5)
    values = (rng.normal(size=(60, 5)) * [90, 40, 20, 9, 4]).astype(int) + 1_000_000
    times = rng.integers(1, 4, 60)
    times[0] = 400
    rows = [(i * 1000 + t, v.tolist()) for i, v in enumerate(values) for t in range(times[i])]
    got = whiten(spark.createDataFrame(rows, VEC).repartition(7), counts=counts).collect()
    assert len(got) == 5 * len(rows)
    compare(got, [i * 1000 for i in range(60)], values, list(map(int, times)) if counts else [1] * 60)
    per = {}
    for r in got:
        per.setdefault((r["vec_id"] // 1000, r["component"]), set()).add((r["whitened"], r["deviation"]))
    assert all(len(found) == 1 for found in per.values())


def test_query_on_the_given_table(spark):
    base = "/root/testdata/sf0.001"
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{base}/embeddings.parquet").collect()
    x = {r["vec_id"]: [int(np.floor(64 * float(c))) + 1_000_000 for c in r["embedding"]] for r in rows}
    distinct = {tuple(v): k for k, v in x.items()}
    got = op12_embedding_whitening(spark, base).collect()
    assert len(got) == 16 * len(rows) and got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    compare(got, list(distinct.values()), list(distinct), [1] * len(distinct))


def test_fixed_point_drops_and_saturates(spark):
    rows = [(1, [0.5, -0.01]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1e300, -1e300])]
    got = {r["vec_id"]: r["x"] for r in fixed_point(spark.createDataFrame(rows, "vec_id long, e array<double>"), "e").collect()}
    assert got == {1: [1_000_032, 999_999], 6: [], 7: [2**63 - 1, -(2**63) + 1_000_000]}


def test_defined_cases(spark):
    assert whiten(spark.createDataFrame([], VEC)).collect() == []
    assert whiten(spark.createDataFrame([(1, [5, 6]), (2, [5, 6]), (3, []), (4, None), (5, [1, None])], VEC)).collect() == []
    # A length of its own is a fit of its own; dimensions that never change have no component.
    rows = [(1, [0, 7]), (2, [10, 7]), (None, [20, 7]), (3, [0, 7]), (4, [1]), (5, [3]), (5, [3])]
    df = spark.createDataFrame(rows, VEC).withColumns({c: F.lit("kept") for c in ("key", "times", "dims", "Component", "c")})
    got = whiten(df).collect()
    found = sorted((str(r["vec_id"]), r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 6), round(r["explained"], 6)) for r in got)
    a, b = round(1.5**0.5, 6), 1.0
    assert found == [("1", 1, 3, 900, a, 1.0), ("2", 1, 3, 0, 0.0, 1.0), ("3", 1, 3, 900, a, 1.0), ("4", 1, 2, 4, b, 1.0), ("5", 1, 2, 4, b, 1.0), ("5", 1, 2, 4, b, 1.0), ("None", 1, 3, 900, a, 1.0)]
    assert {r["key"] for r in got} == {"kept"} and got[0].identity_error < 1e-12


def test_sums_beyond_64_bits(spark):
    big = 2**62
    rows = [(i, [big + 3 * i, -big + i * i]) for i in range(9)]
    got = {r["vec_id"]: r["deviation"] for r in whiten(spark.createDataFrame(rows, VEC)).filter("component = 1").collect()}
    _, deviation, _, _ = plain([x for _, x in rows], [1] * 9)
    assert got == dict(enumerate(deviation))
    far = whiten(spark.createDataFrame([(1, [2**62]), (2, [-(2**62)])], VEC)).collect()
    assert {(r["deviation"], round(abs(r["whitened"]), 9)) for r in far} == {(2**63 - 1, 1.0)}
