"""Reconstruction: upkeep of the likelihood, states, and edits against a full evaluation."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from honeyframe import fixtures as X
from honeyframe.catalog import probability
from honeyframe.catalog.symmetry import models_xz
from honeyframe.functions import hexgrid as H
from honeyframe.operators import mixture as M, topology as T
from honeyframe.session import cut_lineage

N, LEVELS = X.RADIUS, 16


@pytest.fixture(scope="module")
def small(spark, sf):
    """Few sub-frames, four models, the table of all values."""
    frames = cut_lineage(X.sf_pixels(spark, sf).filter("sf_id < 60").select("sf_id", "x", "z", "hp", "value"))
    models = cut_lineage(models_xz(spark, sf).filter("m < 4").select("m", "hp", "level"))
    table = cut_lineage(probability.prob_table(spark, sf))
    weights = spark.createDataFrame([(0, 0.4, "Lattice"), (1, 0.2, "Fixed"), (2, 0.3, "Continue"), (3, 0.1, "Continue")], "m long, weight double, state string")
    return frames, models, weights, table


def total(frames, models, weights, table):
    """The likelihood from all pixels of all copies."""
    marg = M.marginal_loglik(M.orbit_loglik(frames, models, table, N, N))
    return M.mixture_loglik(marg, weights, 12).first()["total"]


def test_total_is_that_of_a_full_evaluation(small):
    frames, models, weights, table = small
    got, shares, history = M.reconstruct(frames, models, weights, table, N, N, 0.0, 10.0, LEVELS, rounds=2)
    ok = [h["total"] for h in history if h["accepted"]]
    assert all(b >= a for a, b in zip(ok, ok[1:]))
    assert any(h["phase"] == "edit" and h["edits"] > 0 for h in history)
    got, shares = cut_lineage(got), cut_lineage(shares)
    assert total(frames, got, shares, table) == pytest.approx(ok[-1], abs=1e-6)
    w = {r["m"]: r["weight"] for r in shares.collect()}
    assert w[0] == 0.4 and w[1] == 0.2 and sum(w.values()) == pytest.approx(1.0)
    before = {(r["m"], r["hp"]): r["level"] for r in models.collect()}
    after = {(r["m"], r["hp"]): r["level"] for r in got.collect()}
    assert set(before) == set(after) and all(after[k] == v for k, v in before.items() if k[0] == 0)
    assert any(after[k] != v for k, v in before.items())


def test_edits_are_scored_like_full_models(spark, small):
    """Also where all copies of weight are touched: an edit that makes one copy, the
    best by far, worse than all others."""
    frames, models, weights, table = small
    image = frames.filter("sf_id = 3").select(F.lit(7).cast("long").alias("m"), "hp", F.least(F.col("value") * 2, F.lit(15)).cast("long").alias("level"))
    models = cut_lineage(models.filter("m > 1").unionByName(image))
    w = spark.createDataFrame([(2, 0.5), (3, 0.25), (7, 0.25)], "m long, weight double")
    ll = cut_lineage(M.baseline_loglik(frames, models, table, N, N))
    marg = cut_lineage(M.marginal_loglik(ll))
    change = F.when(F.col("level") > 4, 0).otherwise(15).cast("long")
    e = models.select((F.col("m") * 10 + F.col("hp") % 3).alias("edit"), "m", "hp", F.col("level").alias("old"), change.alias("new")).filter("hp % 3 < 2")
    e = cut_lineage(e)
    base = M.mixture_loglik(marg, w).first()["total"]
    got = {r["edit"]: r for r in M.score_edits(frames, ll, marg, e, table, N, N, w).collect()}
    assert len(got) == 6
    for k, r in got.items():
        edited = M.apply_edits(models, e.filter(F.col("edit") == k))
        want = M.mixture_loglik(M.marginal_loglik(M.orbit_loglik(frames, edited, table, N, N)), w).first()["total"]
        assert r["total"] == pytest.approx(want, abs=1e-6)
        assert r["gain"] == pytest.approx(want - base, abs=1e-6)


def test_a_value_outside_the_table_is_an_error(small):
    frames, models, _, table = small
    with pytest.raises(PySparkException, match="no row in the probability table"):
        M.orbit_loglik(frames, models, table.filter("value < 2"), N, N).collect()


def test_home_pixels(spark):
    rows = M.home_pixels(spark, 5).collect()
    assert sorted(r["hp"] for r in rows) == list(range(75))
    d = M.home_pixels(spark, 5).withColumn("again", H.hex_index("x", "z", 5))
    assert d.filter("again <> hp").isEmpty()


def test_one_ring_of_many_corners(spark):
    n = 100_000
    a = spark.range(n).select(
        F.lit(0).alias("view"), F.col("id").alias("atom_id"), F.cos(F.col("id") * (2 * math.pi / n)).alias("x"), F.sin(F.col("id") * (2 * math.pi / n)).alias("y")
    )
    b = spark.range(n).select(F.lit(0).alias("view"), F.least("id", (F.col("id") + 1) % n).alias("a"), F.greatest("id", (F.col("id") + 1) % n).alias("b"))
    r = T.trace_rings(b, a)
    d = r.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("places"), F.max("size").alias("size"), F.max("seq").alias("last")).first()
    assert (d["n"], d["places"], d["size"], d["last"]) == (n, n, n, n - 1)
    step = r.alias("p").join(r.alias("q"), F.col("q.seq") == F.col("p.seq") + 1).select((F.col("q.atom_id") - F.col("p.atom_id")).alias("s"))
    assert step.filter("abs(s) <> 1 and abs(s) <> 99999").isEmpty()


def test_tables_that_grow_with_the_frames_are_no_broadcasts(small):
    frames, models, weights, table = small
    ll = cut_lineage(M.baseline_loglik(frames, models, table, N, N))
    marg = cut_lineage(M.marginal_loglik(ll))
    resp = M.responsibilities(marg)
    for d in (M.em_models(frames, ll, resp, N, N, 0.0, 10.0, LEVELS), M.copy_weights(ll, resp), M._frame_rows(ll, M.frame_terms(marg, weights))):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [sf_id" in plan and "BroadcastHashJoin [sf_id" not in plan
