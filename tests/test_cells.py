"""Searches in cells and range partitions against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from honeyframe.operators import runs as R, statistics as S, topology as T


def mesh(spark, seed, n=60, long=True):
    rng = random.Random(seed)
    xy = [(rng.uniform(0, 12), rng.uniform(0, 12)) for _ in range(n)]
    bonds = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(400)}
    bonds = [(a, b) for a, b in bonds if math.dist(xy[a], xy[b]) < 2.5]
    if long:  # one bond across everything, and one upright and one level one
        xy += [(-300.0, -290.0), (310.0, 305.0), (6.0, 0.0), (6.0, 12.0), (0.0, 6.0), (12.0, 6.0)]
        bonds += [(n, n + 1), (n + 2, n + 3), (n + 4, n + 5)]
    atoms = spark.createDataFrame([(0, i, x, y, 0.0) for i, (x, y) in enumerate(xy)], "view int, atom_id long, x double, y double, z double")
    return xy, bonds, atoms, spark.createDataFrame([(0, a, b) for a, b in bonds], "view int, a long, b long")


def middle(xy, e):
    (x, y), (u, v) = xy[e[0]], xy[e[1]]
    return (x + u) / 2, (y + v) / 2


@pytest.mark.parametrize("seed", [1, 2])
def test_midpoints_in_discs(spark, seed):
    xy, bonds, atoms, table = mesh(spark, seed)
    want = {
        (s, t) for s in bonds for t in bonds if s != t and math.dist(middle(xy, s), middle(xy, t)) < math.dist(xy[s[0]], xy[s[1]]) / 2
    }
    got = [((r["a"], r["b"]), (r["a2"], r["b2"])) for r in T.bond_conflicts(table, atoms).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_crossing_bonds(spark, seed):
    xy, bonds, atoms, table = mesh(spark, seed)

    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    want = set()
    for s in bonds:
        for t in bonds:
            if s < t and not set(s) & set(t):
                p, q, u, v = (xy[i] for i in (*s, *t))
                if side(p, q, u) * side(p, q, v) < 0 and side(u, v, p) * side(u, v, q) < 0:
                    want.add((s, t))
    got = [((r["a"], r["b"]), (r["a2"], r["b2"])) for r in T.bond_conflicts(table, atoms, dual=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_in_a_key_over_many_partitions(spark):
    rng = random.Random(5)
    rows = [(0, i, rng.uniform(0, 1000)) for i in range(3000)] + [(1, i, 5.0 * i) for i in range(3)] + [(2, 7, None)]
    asked = [(0, rng.uniform(-50, 1050)) for _ in range(200)] + [(1, t) for t in (-3.0, 2.5, 2.4, 11.0, 90.0)] + [(3, 1.0)]
    right = spark.createDataFrame(rows, "k int, id long, v double").filter("v is not null")
    left = spark.createDataFrame(asked, "k int, t double")
    got = {(r["k"], r["t"]): r["id"] for r in R.nearest_within(left, right, "k", "t", "v", "id", 2.5).collect()}
    assert len(got) == len(set(asked))
    for k, t in asked:
        near = min(((abs(v - t), i) for q, i, v in rows if q == k and v is not None), default=(9.0, None))
        assert got[(k, t)] == (near[1] if near[0] <= 2.5 else None)


def test_histogram_of_an_outlier(spark):
    d = spark.createDataFrame([(1, 0), (1, 0), (1, 10**12)], "c int, value long")
    got = sorted((r["value"], r["n"]) for r in S.value_histogram(d, "c").collect())
    assert got == [(0, 2), (10**12, 1)]


def test_neighbours_in_views_of_any_density(spark):
    """A view with a dense spot in a wide plane, one a million times as narrow, one with
    many points at one place, and one with fewer points than neighbours."""
    rng = random.Random(6)
    rows = [(0, i, rng.gauss(0, 1e-4), rng.gauss(0, 1e-4)) for i in range(150)] + [(0, 200 + i, rng.uniform(-1e3, 1e3), rng.uniform(-1e3, 1e3)) for i in range(50)]
    rows += [(1, i, rng.uniform(0, 1e-3), rng.uniform(0, 1e-3)) for i in range(100)]
    rows += [(2, i, 3.0, 4.0) for i in range(40)] + [(2, 100 + i, float(i), 0.0) for i in range(5)] + [(3, i, float(i), 1.0) for i in range(3)]
    d = spark.createDataFrame(rows, "view int, id long, x double, y double")
    got = {}
    for r in T.knn_candidates(d, 4, max_cell=16).collect():
        got.setdefault((r["view"], r["id"]), {})[r["place"]] = r["other"]
    for v, i, x, y in rows:
        near = sorted((round(math.hypot(a - x, b - y), 9), j) for u, j, a, b in rows if u == v and j != i)[:4]
        assert got[(v, i)] == {n + 1: j for n, (_, j) in enumerate(near)}, (v, i)


@pytest.mark.parametrize("alpha, beta", [(3.0, 8.0), (0.7, 5.5), (40.0, 12.0)])
def test_beta_prime_is_found_from_its_moments(spark, alpha, beta):
    mean, c = alpha / (beta - 1), beta - 1
    var = alpha * (alpha + c) / (c * c * (c - 1))
    skew = 2 * (2 * alpha + c) / (c - 2) * math.sqrt((c - 1) / (alpha * (alpha + c)))
    d = spark.createDataFrame([(mean - 0.5, var, math.sqrt(var), skew), (1.0, 1.0, 1.0, -0.5)], "avg double, var double, std double, skew double")
    got, none = S.family_params(d).orderBy("skew").collect()[::-1]
    assert (got["ib_alpha"], got["ib_beta"], got["ib_x0"]) == pytest.approx((alpha, beta, 0.5))
    assert none["ib_alpha"] is None and none["ib_beta"] is None
