"""Iterative operators by the properties their results must have, and small
hand-worked cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from honeyframe import catalog, fixtures as X
from honeyframe.catalog import frames, lattice as CL, topology as CT
from honeyframe.functions import hexgrid as H
from honeyframe.operators import atoms as A, lattice as Q, mixture as M, pixels as P, reports as R, runs as N, search as SE, topology as T

catalog.load()


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# -- literal cases ---------------------------------------------------------------


def test_one_run(spark):
    t = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.0, 0.5, 1.2, 1.1, 0.0])], "line long, pos long, value double")
    (r,) = N.count_runs(t, ["line"], 1.0, 5).collect()
    assert (r["pos"], r["length"], r["count"]) == (1, 3, 1)
    assert r["mean"] == pytest.approx(0.9333, abs=1e-4)


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_last_marked_across_chunks(spark, chunk):
    marks = [0, 1, 0, 0, 1, 0, 0, 0]
    t = spark.createDataFrame([(0, i, bool(m)) for i, m in enumerate(marks)], "k long, pos long, m boolean")
    got = dict(rows(N.last_marked(t, ["k"], "pos", F.col("m"), "at", chunk), "pos", "at"))
    assert [got[i] for i in range(8)] == [None, 1, 1, 1, 4, 4, 4, 4]


def test_wrap_is_a_bijection_home(spark):
    n = 4
    d = spark.range(-900, 900).select((F.col("id") % 30).alias("x"), F.floor(F.col("id") / 30).alias("z"))
    d = d.withColumns({"x0": F.col("x"), "z0": F.col("z"), "y": F.lit(0)})
    for x, z, x0, z0 in rows(H.with_wrap(d, n), "x", "z", "x0", "z0"):
        assert -n <= x < n and -n < -x - z <= n and -n <= z < n
        a, b = x0 - x, z0 - z
        assert (2 * a + b) % (3 * n) == 0 and (a + 2 * b) % (3 * n) == 0
    d = spark.createDataFrame([(4, -4, 0)], "x long, y long, z long")
    assert rows(H.with_wrap(d, 4), "x", "y", "z") == [(0, 4, -4)]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_hex_index_is_dense(spark, n):
    pts = [(x, z) for x in range(-n, n) for z in range(-n, n) if -n <= x + z < n]
    d = spark.createDataFrame(pts, "x long, z long").select("x", "z", H.hex_index("x", "z", n).alias("hp"))
    got = sorted((x, z, hp) for x, z, hp in rows(d, "x", "z", "hp"))
    assert [g[2] for g in got] == list(range(3 * n * n))


def test_site_class_sum(spark):
    d = spark.createDataFrame([(m, -m + k, -k, m, k) for m in range(9) for k in range(m // 2 + 1)], "x long, y long, z long, m long, k long")
    for m, k, c in rows(d.select("m", "k", H.site_class("x", "y", "z", 9).alias("c")), "m", "k", "c"):
        below = sum(1 + j // 2 for j in range(m))
        assert c == below + (k if m else 0) - (0 if m < 2 else 0)


def test_filter_rules(spark):
    d = spark.createDataFrame([(1.0,), (3.0,), (12.0,)], "a double")
    rules = [R.Rule("a", 1.0, 3.0), R.Rule("a", 0.0, 10.0, invert=True)]
    assert sorted(r[0] for r in R.frame_bounds_filter(d, rules).collect()) == [3.0, 12.0]


def test_best_case(spark):
    m = spark.createDataFrame([(0, 0, -3.0), (0, 1, -5.0)], "sf_id long, m long, marg double")
    assert rows(M.assign_cases(m), "m") == [(0,)]


def test_blob_phases(spark):
    pts = [(x, z) for x in range(-2, 2) for z in range(-2, 2) if -2 <= x + z < 2]
    m = spark.createDataFrame([(0, x, z, 10 if (x, z) == (0, 0) else 8) for x, z in pts], "m long, x long, z long, level long")
    m = m.withColumn("hp", H.hex_index("x", "z", 2))
    hp = m.filter("x = 0 and z = 0").first()["hp"]
    e = spark.createDataFrame([(1, 0, hp, 10, 14)], "edit long, m long, hp long, old long, new long")
    for later, want in ((False, 11), (True, 10)):
        got = {h: n for h, n in rows(M.propose_blobs(e, m, 2, 100, later), "hp", "new")}
        assert got.pop(hp) == 14
        assert len(got) == 6 and set(got.values()) == {want}


# -- frames ------------------------------------------------------------------------


def test_clean_spots_same_as_one_at_a_time(spark, sf):
    d = frames.square(spark, sf).filter("frame_id < 12")
    dist = {}
    for f, x, y, v in rows(P.dirt_distance(d, F.col("mask") == 16, 8, 8), "frame_id", "x", "y", "dist"):
        dist.setdefault(f, {})[(y, x)] = v
    want = set()
    reach = 1
    for f, m in dist.items():
        live = {p: v for p, v in m.items() if all(1 <= c < 7 for c in p) and v > reach}
        while live:
            y, x = min(live, key=lambda p: (-live[p], p))
            want.add((f, x, y))
            live = {(b, a): v for (b, a), v in live.items() if not (x - 2 <= a < x + 2 and y - 2 <= b < y + 2)}
    got = P.clean_spots(d, F.col("mask") == 16, 8, 8, radius=1)
    assert set(rows(got, "frame_id", "x", "y")) == want


def test_greedy_tiling_is_maximal(spark, sf):
    cand = Q.scan_subframes(X.px(spark, sf), 2, None, border=1).filter("frame_id < 40")
    size = 2
    got, every = {}, {}
    for f, x, z in rows(Q.greedy_tiling(cand, size, 1, simple=False), "frame_id", "x", "z"):
        got.setdefault(f, []).append((x, z))
    for f, x, z in rows(cand, "frame_id", "x", "z"):
        every.setdefault(f, []).append((x, z))

    def near(a, b):
        dx, dz = a[0] - b[0], a[1] - b[1]
        return abs(dx) + abs(dz) + abs(dx + dz) < 2 * size

    for f, pts in every.items():
        chosen = got[f]
        assert len(set(chosen)) == len(chosen)
        assert not any(near(a, b) for a in chosen for b in chosen if a < b)
        assert all(any(near(p, c) for c in chosen) for p in pts)


def test_searches_reach_their_ends(spark, sf):
    """Scores within a frame are those of the job over all candidates; searches never
    lose score, and no step of the last size gains after refining."""
    px = frames.square(spark, sf).filter("frame_id < 30")
    par = frames.params(spark, sf).filter("frame_id < 30")
    grid = Q.candidate_grid(par, 0, 1, 1)
    want = {(r["frame_id"], r["cand"]): r["score"] or 0.0 for r in Q.score_candidates(px, grid, 2, frames.RES, 8, 8).collect()}
    arrays = {}
    for r in px.collect():
        arrays.setdefault(r["frame_id"], []).append((r["x"], r["y"], r["value"], r["mask"]))
    cells = {f: SE.CellScore(*(np.array(c) for c in zip(*v)), 2, frames.RES, 8, 8) for f, v in arrays.items()}
    for r in grid.collect():
        assert cells[r["frame_id"]].score(r.asDict()) == pytest.approx(want.get((r["frame_id"], r["cand"]), 0.0), rel=1e-7, abs=1e-9)
    for fit in (Q.coarse_to_fine(px, par, 2, frames.RES, 8, 8), Q.coordinate_refine(px, par, 2, frames.RES, 8, 8)):
        got = {r["frame_id"]: r.asDict() for r in fit.collect()}
        assert len(got) == 30
        for f, r in got.items():
            assert r["score"] >= want.get((f, 0), 0.0) - 1e-6
            assert cells[f].score(r) == pytest.approx(r["score"])
    for f, r in got.items():
        p, score = SE.refine(cells[f], {g: r[g] for g in SE.GEOMETRY}, 0.2 / 1024, 1e-4)
        assert score <= r["score"] + 1e-8


@pytest.mark.parametrize("module, name", [(A, "nudge_atoms")])
def test_searches_of_queries_end_on_their_own(spark, sf, monkeypatch, module, name):
    """No query passes an end of its own to the search."""
    passed = []
    monkeypatch.setattr(module, name, lambda *a, **k: passed.append(k) or (None, None))
    catalog.QUERIES[name](spark, sf)
    assert passed == [{}]


def test_rotation_keeps_the_total(spark, sf):
    m = CL.X.hx(spark, sf).filter("frame_id < 3").select(F.col("frame_id").alias("m"), "x", "z", F.col("value").alias("level"))
    before = dict(rows(m.groupBy("m").agg(F.sum("level").alias("s")), "m", "s"))
    after = dict(rows(M.fractional_rotation(m, 2, 5, 4).groupBy("m").agg(F.sum("value").alias("s")), "m", "s"))
    assert all(after[k] == pytest.approx(v) for k, v in before.items())


def test_reconstruction_returns_models_and_weights(spark, sf, monkeypatch):
    """With the operator's own least gain; the sum of the weights is one."""
    run, passed = M.reconstruct, []
    monkeypatch.setattr(M, "reconstruct", lambda *a, **k: passed.append((k, a[1])) or run(*a, rounds=1))
    got = catalog.QUERIES["reconstruct"](spark, sf).collect()
    (kwargs, models), = passed
    assert kwargs == {}
    assert sorted((r["m"], r["hp"]) for r in got if r["kind"] == "model") == sorted(rows(models, "m", "hp"))
    assert sum(r["weight"] for r in got if r["kind"] == "weight") == pytest.approx(1.0)


# -- atoms and mesh -----------------------------------------------------------------


def _sq(df):
    return dict(rows(df.groupBy("frame_id").agg(F.sum(F.col("value") * F.col("value")).alias("s")), "frame_id", "s"))


def test_atom_search_lowers_the_residual(spark, sf):
    p = frames.square(spark, sf).filter("frame_id < 20")
    atoms, res = A.find_atoms(p, CT.KERNEL, 2, 8, 8, floor=1.0, min_weight=0.5)
    before = _sq(p.withColumn("value", F.col("value") - 1.0))
    after = _sq(res)
    assert all(after[f] <= before[f] + 1e-9 for f in before)
    model = A.render_atoms(p, atoms, CT.KERNEL, 8, 8)
    d = p.join(model, ["frame_id", "x", "y"]).join(res.withColumnRenamed("value", "r"), ["frame_id", "x", "y"])
    assert d.filter(F.abs(F.col("value") - 1.0 - F.col("model") - F.col("r")) > 1e-6).isEmpty()
    at = {}
    for f, x, y in rows(atoms, "frame_id", "x", "y"):
        at.setdefault(f, []).append((x, y))
    for pts in at.values():
        assert all(math.dist(a, b) >= 2 for a in pts for b in pts if a < b)
    _, moved = A.nudge_atoms(atoms, res, CT.KERNEL, 1, 2, 8, 8, least_gain=2.0)
    final = _sq(moved)
    assert all(final[f] <= after[f] + 1e-6 for f in after)


def test_knn_with_many_equal_places(spark):
    pts = [(0, i, 1.0, 1.0) for i in range(300)] + [(0, 1000 + i, 50.0 + i, 2.0 * i) for i in range(40)]
    d = spark.createDataFrame(pts, "view long, id long, x double, y double")
    got = {}
    for i, o, k in rows(T.knn_candidates(d, 5, max_cell=16), "id", "other", "place"):
        got.setdefault(i, {})[k] = o
    for _, i, x, y in pts:
        best = sorted((round(math.hypot(x - a, y - b), 9), j) for _, j, a, b in pts if j != i)[:5]
        assert [got[i][k] for k in range(1, 6)] == [j for _, j in best]


def test_bonds_of_the_mesh(spark, sf):
    a = X.mesh_atoms(spark, sf).filter(F.col("y") < 12)
    b = T.bond_atoms(T.knn_candidates(a.select("view", F.col("atom_id").alias("id"), "x", "y"), 6), 3, max_dist=1.4)
    pairs = set(rows(b, "a", "b"))
    deg = {}
    for p, q in pairs:
        for k in (p, q):
            deg.setdefault(k, set()).add(p + q - k)
    assert max(len(v) for v in deg.values()) <= 3
    assert not any(deg[p] & deg[q] for p, q in pairs)


def test_euler_count(spark, sf):
    a, b, _ = CT.mesh(spark, sf)
    rings = T.trace_rings(b, a).select("view", "low").distinct().count()
    # a connected planar graph: atoms - bonds + inner faces = 1
    assert a.count() - b.count() + rings == 1


def test_signature_starts_at_the_seed(spark, sf):
    s = CT.signatures(spark, sf)
    first = {r["line"] for r in s.filter("level = 0").collect()}
    assert first == {"5-6-7"}


def test_view_links_are_one_to_one(spark, sf):
    links = catalog.QUERIES["merge_views"](spark, sf).collect()
    known = [(r["view"], r["atom_id"], r["master"]) for r in links if not r["is_new"]]
    assert len(known) == len({k[:2] for k in known}) == len({(k[0], k[2]) for k in known}) > 1000


def test_view_with_another_ring_is_dropped(spark):
    """A view whose ring next to the seed has another size cannot be linked."""
    master = [(0, 1, s, a) for s, a in enumerate([1, 2, 3, 4, 5, 6])] + [(0, 2, s, a) for s, a in enumerate([2, 1, 7, 8, 9, 10])]
    view = [(1, 1, s, a) for s, a in enumerate([1, 2, 3, 4, 5, 6])] + [(1, 2, s, a) for s, a in enumerate([2, 1, 7, 8, 9])]
    r = "view long, ring_id long, seq long, atom_id long"
    xy = "view long, atom_id long, x double, y double"
    at = lambda v, n: [(v, i, float(i), float(i * i)) for i in range(1, n + 1)]
    start = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "view long, atom_id long, master long")
    links, _ = T.merge_views(spark.createDataFrame(at(0, 10), xy), spark.createDataFrame(master, r),
                             spark.createDataFrame(at(1, 9), xy), spark.createDataFrame(view, r), start)
    assert links.count() == 0


def test_7557(spark):
    rings = {1: [1, 2, 3, 4, 5], 2: [2, 1, 6, 7, 8], 3: [1, 5, 20, 21, 22, 23, 6], 4: [2, 8, 30, 31, 32, 33, 3]}
    r = spark.createDataFrame([(0, k, s, a) for k, v in rings.items() for s, a in enumerate(v)], "view long, ring_id long, seq long, atom_id long")
    ids = sorted({a for v in rings.values() for a in v})
    a = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in ids], "view long, atom_id long, x double, y double, z double")
    b = T.ring_edges(r).select("view", "a", "b").distinct()
    got = T.defect_patterns(r, b, a).collect()
    assert {(g["kind"], g["atom_id"], g["action"]) for g in got} == {("7557", 1, "drop"), ("7557", 2, "drop")}


def test_report_with_two_headers(spark, tmp_path):
    from honeyframe.sources import tables as S

    (tmp_path / "r.txt").write_text("#label\tmerit\tpeaks\na\t1.5\t3\n\n#label,numpeak,merit\nb,4,2.5\nnull,5,3.5\n")
    got = sorted(rows(S.read_frame_report(spark, str(tmp_path)), "grp", "label", "merit", "peaks"), key=str)
    assert got == sorted([(0, "a", 1.5, 3), (1, "b", 2.5, 4), (1, None, 3.5, 5)], key=str)


def test_image_of_another_shape_fails_softly(spark, tmp_path):
    import numpy as np

    from honeyframe.sources import images as I

    (tmp_path / "a1.tif").write_bytes(I.encode_page(np.arange(6, dtype="uint16").reshape(2, 3)))
    (tmp_path / "a2.tif").write_bytes(I.encode_page(np.zeros((3, 3), dtype="float32")))
    (tmp_path / "a3.tif").write_bytes(b"not an image")
    got = I.scan_images(spark, str(tmp_path), r"^a\d", (2, 3)).collect()
    assert sum(r["ok"] for r in got) == 6 and sum(not r["ok"] for r in got) == 2
    assert {(r["x"], r["y"]): r["value"] for r in got if r["ok"]}[(2, 1)] == 5.0
