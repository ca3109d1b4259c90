"""Whitening against the exact covariance."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from honeyframe import llm
from honeyframe.llm import whitening as W
from honeyframe.llm.ship import ship

llm.load()
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize("values,count", [
    (np.linspace(1, 2, 300), 8), (1 / np.arange(1, 401.0) ** 2, 16), (np.linspace(0.9, 1, 64), 32), (np.ones(20), 5),
    (np.array([3.0]), 4), (np.r_[np.ones(6), np.zeros(6)], 9), (np.geomspace(1e-9, 1e6, 200), 10),
])
def test_leading_pairs(values, count):
    a = spectrum(values)
    theta, u, size = W.leading_pairs(lambda x: a @ x, len(values), count)
    want = np.sort(values)[::-1][:count]
    assert np.allclose(theta, want, rtol=0, atol=1e-11 * want[0])
    assert np.abs(u.T @ u - np.eye(len(want))).max() < 1e-12
    assert np.linalg.norm(a @ u - u * theta, axis=0).max() <= 2e-12 * want[0]


def test_minres_is_exact_in_the_whole_space():
    a = spectrum(np.array([-3.0, -1, 0.5, 2, 7]))
    b = np.random.default_rng(1).normal(size=(5, 3))
    shifts = np.array([0.1, 0.2, 0.3])
    x = W.minres(lambda v: a @ v, b, shifts, lambda v: v, 0.0, 5)
    assert np.allclose(a @ x - x * shifts, b, atol=1e-9)


def exact(table, count=32):
    """Whole-number vectors, their covariance and their eigenpairs."""
    good = [(i, [float(c) for c in v]) for i, v in table if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    centred = [[n * r[j] - s[j] for j in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    return good, centred, n, e[::-1][:count], u[:, ::-1][:, :count], float(np.trace(cov))


def check(table, got):
    good, centred, n, e, u, trace = exact(table)
    by = defaultdict(list)
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        by[r["component"]].append(r)
    rank = int((e > 1e-10 * e[0]).sum())
    assert sorted(by) == list(range(1, rank + 1))
    for k in by:
        plain = np.array(centred, float) / n @ u[:, k - 1] / math.sqrt(e[k - 1])
        rows = [(i if i is not None else -1, sum(c * c for c in z), w) for (i, _), z, w in zip(good, centred, plain)]
        mine = [(r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"], r["whitened"]) for r in by[k]]
        rows.sort()
        mine.sort()
        assert [r[:2] for r in rows] == [r[:2] for r in mine]
        a, b = np.array([r[2] for r in rows]), np.array([r[2] for r in mine])
        if rows == sorted(set(rows)):
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert abs(by[k][0]["explained"] - e[k - 1] / trace) < 1e-10


def test_table(spark, sf):
    t = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = llm.QUERIES["op12_whitening"](spark, sf)
    assert got.columns == COLUMNS
    check(t, got.collect())


def test_odd_rows(spark, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(3)
    table = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(40, 6)) * [9, 7, 5, 3, 2, 1])]
    table += [(None, table[0][1][::-1]), (None, [1.0] * 6), (50, table[1][1]), (50, table[1][1])]
    bad = [(60, None), (61, []), (62, [None] * 6), (63, [float("nan")] * 6), (64, [float("inf")] + [0.0] * 5), (None, None)]
    d = spark.createDataFrame(table + bad + [(70, [1.0, 2.0])], "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "x", "n", "d", "ids")})
    got = W.whiten(d)
    assert got.columns == COLUMNS
    check(table, got.collect())
    assert {r["component"] for r in W.whiten(d, components=2).collect()} == {1, 2}


def test_tables_without_variance(spark):
    ship(spark)
    for table in ([], [(1, [1.0, 2.0])], [(i, [0.5, 0.25]) for i in range(5)], [(1, None), (2, [])]):
        d = spark.createDataFrame(table, "vec_id long, embedding array<float>")
        got = W.whiten(d)
        assert got.columns == COLUMNS and got.collect() == []


def test_large_entries_stay_exact(spark):
    ship(spark)
    table = [(i, [i * 1e9, -i * 3e8, 1.0]) for i in range(9)] + [(9, [2.0, 5e9, 7.0])]
    got = W.whiten(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()
    _, centred, n, e, _, _ = exact(table)
    for r in got:
        want = sum(c * c for c in centred[r["vec_id"]])
        assert r["deviation"] == (want if want < 2**63 else None)
    assert np.isclose(sum(r["explained"] for r in got if r["vec_id"] == 0), 1)
