"""Steps that must stay right, and spread out, on tables that grow."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from honeyframe import catalog, fixtures as X
from honeyframe.catalog import topology as CT
from honeyframe.operators import atoms as A, lattice as Q, reports as R, search as SE, symmetry as Y, topology as T
from honeyframe.session import cut_lineage
from honeyframe.sources.lines import carry_last, numbered_lines

catalog.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- labels -------------------------------------------------------------------------


@pytest.mark.parametrize("most", [4096, 12, 0])
def test_labels_in_labels(spark, most):
    """However few marks are allowed, and with parts that come twice or are one character."""
    rng = random.Random(1)
    labels = ["".join(rng.choice("ab_7") for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "", "7_7_7_7"]
    asked = sorted({"".join(rng.choice("ab_7") for _ in range(rng.randint(1, 4))) for _ in range(40)} | {"7_7", "b", ""})
    frames = spark.createDataFrame(list(enumerate(labels)), "slice long, fl string")
    report = spark.createDataFrame([(a,) for a in asked] + [(None,)], "rl string")
    got = sorted((r["slice"], r["rl"]) for r in R.contains_join(frames, report, "fl", "rl", most).collect())
    assert got == sorted((k, a) for k, s in enumerate(labels) for a in asked if s and a and a in s)


def test_labels_are_not_joined_on_the_driver(spark):
    """The parts of the labels look small to the planner and are many."""
    frames = spark.range(1000).select(F.col("id").alias("slice"), F.concat_ws("_", F.col("id"), F.lit("7.tif")).alias("label"))
    report = frames.select(F.col("slice").alias("rep_id"), F.concat_ws("_", F.col("slice"), F.lit("7")).alias("label"))
    assert "BroadcastHashJoin" not in plan(R.join_by_label(report, frames, frames))


# -- frames in blocks -----------------------------------------------------------------


def frame(rng, n):
    k = rng.permutation(64)[:n]
    return k % 8, k // 8, rng.integers(0, 9, n), rng.choice([1, 1, 1, 4], n)


def test_frames_of_a_block_do_not_matter_to_each_other():
    rng = np.random.default_rng(2)
    frames = [frame(rng, n) for n in (64, 0, 40, 64, 1, 55)]
    p = np.array([[0.37, 0.21, 1.04, 0.4, 3.77, 4.13]] * len(frames)).T * (1 + 0.02 * rng.random((6, len(frames))))
    block = SE.CellScores(frames, 2, 4, 8, 8)
    found, score = block.refine(p, 0.2, 0.01)
    spot, best, edge = block.zoom(p, Q.WIDTHS, 1, 3)
    for k, f in enumerate(frames):
        alone = SE.CellScores([f], 2, 4, 8, 8)
        one, s = alone.refine(p[:, k : k + 1], 0.2, 0.01)
        assert np.allclose(one[:, 0], found[:, k]) and s[0] == pytest.approx(score[k])
        two, b, e = alone.zoom(p[:, k : k + 1], Q.WIDTHS, 1, 3)
        assert np.allclose(two[:, 0], spot[:, k]) and b[0] == pytest.approx(best[k]) and e[0] == edge[k]
    assert score[1] == 0.0 and np.array_equal(found[:, 1], p[:, 1])


def test_search_of_frames_without_pixels(spark):
    par = spark.createDataFrame([(k, 0.37, 0.21, 1.04, 0.4, 3.77, 4.13) for k in (1, 2, 2)], "frame_id long, hel double, tilt double, excent double, phi double, off_x double, off_y double")
    px = spark.createDataFrame([(2, i % 8, i // 8, i * i % 7, 1) for i in range(64)], "frame_id long, x long, y long, value long, mask long")
    got = Q.coarse_to_fine(px, par, 2, 4, 8, 8).collect()
    assert sorted(r["frame_id"] for r in got) == [1, 2, 2]
    assert {r["frame_id"]: r["score"] > 0 for r in got} == {1: False, 2: True}


def test_atoms_move_until_no_move_gains(spark):
    rng = random.Random(3)
    px = [(f, i % 8, i // 8, rng.randint(0, 9)) for f in range(12) for i in range(64)]
    p = spark.createDataFrame(px, "frame_id long, x long, y long, value long")
    a = p.filter("value > 5").select("frame_id", "x", "y", (F.col("value") / 2).alias("weight"))
    m = A.render_atoms(p, a, CT.KERNEL, 8, 8)
    res = p.join(m, ["frame_id", "x", "y"]).select("frame_id", "x", "y", (F.col("value") - F.col("model")).alias("value"))
    atoms, left = A.nudge_atoms(a, res, CT.KERNEL, 1, 2, 8, 8)
    again, _ = A.nudge_atoms(atoms, left, CT.KERNEL, 1, 2, 8, 8)
    key = lambda d: sorted((r["frame_id"], r["x"], r["y"], round(r["weight"], 3)) for r in d.collect())
    assert key(again) == key(atoms)
    drawn = {(r["frame_id"], r["x"], r["y"]): r["model"] for r in A.render_atoms(p, atoms, CT.KERNEL, 8, 8).collect()}
    rest = {(r["frame_id"], r["x"], r["y"]): r["value"] for r in left.collect()}
    assert len(rest) == len(px) and all(math.isclose(v - drawn[(f, x, y)], rest[(f, x, y)], abs_tol=1e-6) for f, x, y, v in px)


# -- meshes, lines and shapes ---------------------------------------------------------


def test_patterns_are_not_joined_on_the_driver(spark):
    rings = {1: [1, 2, 3, 4, 5], 2: [2, 1, 6, 7, 8], 3: [1, 5, 20, 21, 22, 23, 6], 4: [2, 8, 30, 31, 32, 33, 3]}
    r = spark.createDataFrame([(0, k, s, a) for k, v in rings.items() for s, a in enumerate(v)], "view long, ring_id long, seq long, atom_id long")
    a = r.select("view", "atom_id").distinct().select("view", "atom_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    b = T.ring_edges(r).select("view", "a", "b").distinct()
    assert "BroadcastHashJoin" not in plan(T.defect_patterns(r, b, a))
    assert "BroadcastHashJoin" not in plan(T.second_neighbor_distances(b, a))


def test_crossings_deal_the_cells_once(spark):
    """The bonds of a cell meet themselves; both sides come from one shuffle of the cells."""
    rng = random.Random(6)
    xy = {i: (rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(60)}
    links = sorted({(min(p), max(p)) for p in (rng.sample(range(60), 2) for _ in range(80))})
    a = spark.createDataFrame([(v, i, x, y, 0.0) for v in (0, 1) for i, (x, y) in xy.items()], "view long, atom_id long, x double, y double, z double")
    b = spark.createDataFrame([(v, *p) for v in (0, 1) for p in links], "view long, a long, b long")
    d = T.bond_conflicts(b, a, dual=True)
    got = sorted((r["view"], r["a"], r["b"], r["a2"], r["b2"], r["drop_first"]) for r in d.collect())
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    crossed = lambda p, q, r, s: side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0
    pairs = [(m, n) for m in links for n in links if m < n and not {*m} & {*n} and crossed(*(xy[i] for i in (*m, *n)))]
    assert got == sorted((v, *m, *n, math.dist(*(xy[i] for i in m)) > math.dist(*(xy[i] for i in n))) for v in (0, 1) for m, n in pairs)
    assert "ReusedExchange" in plan(d)


def test_topology_file_asks_for_the_sides_once(spark, tmp_path, monkeypatch):
    """Interior rings and links share the sides of the bonds; both made them before."""
    spark.range(400).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    calls, real = [], T.bond_sides
    monkeypatch.setattr(T, "bond_sides", lambda rings: calls.append(1) or real(rings))
    lines = [r["line"].split("\t") for r in catalog.QUERIES["write_topology"](spark, str(tmp_path)).collect()]
    assert len(calls) == 1
    corners, beside = {}, {}
    for r in X.mesh_rings(spark, str(tmp_path)).orderBy("ring_id", "seq").collect():
        corners.setdefault(r["ring_id"], []).append(r["atom_id"])
    for k, c in corners.items():
        for p in zip(c, c[1:] + c[:1]):
            beside.setdefault((min(p), max(p)), []).append(k)
    links = {b: {*k} for b, k in beside.items() if len(k) == 2}
    inner = {k for k, c in corners.items() if len({x for s in links.values() if k in s for x in s - {k}}) == len(c)}
    assert sorted(tuple(map(int, x[1:])) for x in lines if x[0] == "RING") == sorted(map(tuple, corners.values()))
    assert sorted(tuple(map(int, x[1:])) for x in lines if x[0] == "BOND") == sorted(b for b, s in links.items() if s <= inner)


def test_patterns_deal_the_corners_once(spark):
    """What is returned is made of the ends found; before, it dealt all corners and bonds again.
    Corners that are null or come twice count as in the lists of rings."""
    rings = {1: [1, 2, 3, 4, 5], 2: [2, 1, 6, 7, 8], 3: [1, 5, 20, 21, 22, 23, 6], 4: [2, 8, 30, 31, 32, 33, 3], 5: [40, None, 41], None: [50, 51, 52]}
    rows = [(0, k, s, a) for k, v in rings.items() for s, a in enumerate(v)] + [(None, 1, 0, 1), (1, 9, 0, 60), (1, 9, 0, 60), (1, 9, 1, 61)]
    r = cut_lineage(spark.createDataFrame(rows, "view long, ring_id long, seq long, atom_id long"))
    a = cut_lineage(r.select("view", "atom_id").distinct().select("view", "atom_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
    b = cut_lineage(T.ring_edges(r).select("view", "a", "b").distinct())
    d = T.defect_patterns(r, b, a)
    assert {(x["kind"], x["atom_id"]) for x in d.collect()} == {("7557", 1), ("7557", 2)}
    assert not {*r.inputFiles(), *b.inputFiles(), *a.inputFiles()} & {*d.inputFiles()}


def test_first_radius_looks_at_few_points(spark):
    """Before, cells of up to ``max_cell`` points were joined with their neighbours."""
    rng = random.Random(4)
    d = spark.createDataFrame([(0, i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(2500)], "view int, id long, x double, y double")
    assert math.pi * T._first_radius(d, 6, 256).first()["_r"] ** 2 < 4 * 6


def test_lines_of_a_long_file(spark, tmp_path):
    """Marks are carried over chunks, and a window holds one chunk."""
    n = 150_000
    (tmp_path / "a.txt").write_text("\n".join(f"#{i}" if i % 70_000 == 5 else str(i) for i in range(n)))
    lines = numbered_lines(spark, str(tmp_path))
    d = carry_last(lines, F.col("line").startswith("#"), F.col("line"), "mark", "nr")
    assert "_c" in plan(d)
    got = d.filter("line not like '#%'").groupBy("mark", "nr").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r["mark"] or "", r["nr"], r["n"]) for r in got) == [("", -1, 5), ("#140005", 2, 9994), ("#5", 0, 69_999), ("#70005", 1, 69_999)]


def test_shapes_do_not_multiply_pixels(spark):
    """Pixels are not copied for every shift and turn; missing and double ones count."""
    rng = random.Random(5)
    home = [(x, z) for x in range(-2, 2) for z in range(-2, 2) if -2 <= x + z < 2]
    px = [(1, x, z, rng.randint(0, 9)) for x, z in home] + [(2, x, z, 3) for x, z in home]
    d = spark.createDataFrame(px, "frame_id long, x long, z long, value long")
    shape = Y.hex_shape(d, 2)
    assert "Generate" not in plan(shape)
    one, flat = (r.asDict() for r in shape.orderBy("frame_id").collect())
    assert flat["hex_shape"] is None and (flat["dx"], flat["dz"]) == (-2, 0)
    twice = Y.hex_shape(d.unionAll(d), 2).orderBy("frame_id").first().asDict()
    assert twice == pytest.approx(one)


def test_faces_over_many_partitions(spark):
    """Rings that pass several partitions of bonds are joined from their paths, with the
    same corners as rings within one; all rows that are dealt are written once."""
    from honeyframe.operators import faces, topology as T

    n = 12
    xy = [(0, i * (n + 1) + j, float(j) + 0.01 * i, float(i), 0.0, 1.0) for i in range(n + 1) for j in range(n + 1)]
    atoms = spark.createDataFrame(xy, "view int, atom_id long, x double, y double, z double, weight double")
    at = lambda i, j: i * (n + 1) + j
    pairs = [(at(i, j), at(i, j + 1)) for i in range(n + 1) for j in range(n)] + [(at(i, j), at(i + 1, j)) for i in range(n) for j in range(n + 1)]
    bonds = spark.createDataFrame([(0, a, b) for a, b in pairs if (a, b) != (at(5, 5), at(5, 6))], "view int, a long, b long")
    dealt = T._placed(bonds, atoms, rows=40)
    assert dealt.rdd.getNumPartitions() >= 2 * len(pairs) // 40
    assert not dealt.mapInArrow(faces.partition_faces, faces.SCHEMA).filter("size IS NULL").isEmpty()
    placed = T._placed
    try:
        T._placed = lambda b, a: placed(b, a, rows=40)
        got = T.trace_rings(bonds, atoms).collect()
    finally:
        T._placed = placed
    rings = {}
    for r in got:
        rings.setdefault((r["low"]["u"], r["low"]["v"]), {})[r["seq"]] = r["atom_id"]
    want = {(at(i, j), at(i, j + 1)): [at(i, j), at(i, j + 1), at(i + 1, j + 1), at(i + 1, j)] for i in range(n) for j in range(n) if (i, j) not in ((4, 5), (5, 5))}
    want[at(4, 5), at(4, 6)] = [at(4, 5), at(4, 6), at(5, 6), at(6, 6), at(6, 5), at(5, 5)]
    assert {k: [v[s] for s in sorted(v)] for k, v in rings.items()} == want
    assert {r["size"] for r in got} == {4, 6} and all(set(v) == set(range(len(v))) for v in rings.values())


def test_buckets_stay_where_they_are(spark):
    """A join with a table in buckets shuffles the other side only."""
    from honeyframe.session import Buckets

    tables = Buckets(spark)
    big = tables.write(spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).repartition(9, "k"), 9, "k")
    got = spark.range(5).select((F.col("id") * 7).alias("k")).join(big, "k")
    assert sorted(map(tuple, got.collect())) == [(7 * i, 14 * i) for i in range(5)]
    assert plan(got).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    tables.drop()
    assert not [t for t in spark.catalog.listTables() if t.name in tables.names]


def test_views_are_linked_along_a_strip(spark):
    """A strip of hexagons is linked ring by ring from one end: a round does not shuffle the
    meshes again. One view has a ring of another size at the far end, one has no start, one
    has rows that come twice, one starts from an atom with two masters."""
    n = 6
    strip = lambda at=0: [(k, s, at + a) for k in range(n) for s, a in enumerate([2 * k, 2 * k + 1, 1000 + k, 2 * k + 3, 2 * k + 2, 2000 + k])]
    master = [(0, *c) for c in strip()]
    views = [(1, *c) for c in strip(10_000)] + [(2, *c) for c in strip()] + [(2, n - 1, 6, 77)] + [(3, *c) for c in strip()]
    views += 2 * [(4, *c) for c in strip()] + [(5, *c) for c in strip()]
    r, xy = "view long, ring_id long, seq long, atom_id long", "view long, atom_id long, x double, y double"
    place = lambda rows: sorted({(v, a, float(a), float(v)) for v, _, _, a in rows})
    first = [(1, 10_000, 0), (1, 10_001, 1)] + [(v, a, a) for v in (2, 4, 5) for a in (0, 1)] + [(5, 0, 3)]
    seen = []
    write = T.Buckets.write
    try:
        T.Buckets.write = lambda self, df, k, *keys: seen.append(keys) or write(self, df, k, *keys)
        links, nodes = T.merge_views(
            spark.createDataFrame(place(master), xy), spark.createDataFrame(master, r), spark.createDataFrame(place(views), xy),
            spark.createDataFrame(views, r), spark.createDataFrame(first, "view long, atom_id long, master long"))
    finally:
        T.Buckets.write = write
    assert sorted(seen) == [("ma", "mb"), ("mr",), ("view", "va"), ("view", "vr")]
    got = {(x["view"], x["atom_id"]): (x["master"], x["is_new"]) for x in links.collect()}
    names = {a for _, _, a in strip()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {10_000 + a: (a, False) for a in names}
    assert {k[0] for k in got} == {1, 3} and all(v[1] for k, v in got.items() if k[0] == 3)
    assert {x["observers"] for x in nodes.collect() if x["master"] >= 0} == {1}
