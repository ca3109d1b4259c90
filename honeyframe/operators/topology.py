"""Atom mesh: neighbours, bonds, rings, signatures and views.

Tables carry a ``view``: atoms (view, atom_id, x, y, z, weight), bonds
(view, a, b) with a < b, rings (view, ring_id, seq, atom_id). Degrees and ring
sizes are bounded by the geometry, so lists per atom or ring are short.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from honeyframe.operators.faces import SCHEMA, partition_faces
from honeyframe.operators.numbering import number_rows
from honeyframe.session import Buckets, Store, apart, bounded, cut_lineage, parts_for, ship

# -- neighbours ------------------------------------------------------------------


def _first_radius(src: DataFrame, k: int, max_cell: int) -> DataFrame:
    """(view, _r, _whole): the width of each view and a radius of its own, halved until
    no cell of that width holds more than ``max_cell`` points, and then so small that the
    circle around a point of the view holds about 2k others, by the cells of its points."""
    store = Store(src.sparkSession)
    wide = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    wide = F.when(wide > 0, wide).otherwise(1.0)
    size = store.write(src.groupBy("view").agg(wide.alias("_whole"), (wide / F.sqrt(F.greatest(F.count(F.lit(1)) / F.lit(float(k)), F.lit(1.0)))).alias("_r")))
    while True:
        d = src.join(bounded(size), "view").groupBy("view", "_r", "_whole", F.floor(F.col("x") / F.col("_r")), F.floor(F.col("y") / F.col("_r"))).agg(F.count(F.lit(1)).alias("n"))
        full = store.write(d.groupBy("view", "_r", "_whole").agg((F.max("n") > max_cell).alias("_full"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("_own")))
        if full.filter("_full").isEmpty():
            less = F.sqrt(F.lit(2.0 * k) / (math.pi * F.col("_own")))
            return full.select("view", (F.col("_r") * F.least(less, F.lit(1.0))).alias("_r"), "_whole")
        store.drop(size)
        size = full.select("view", F.when(F.col("_full"), F.col("_r") / 2).otherwise(F.col("_r")).alias("_r"), "_whole")


def knn_candidates(points: DataFrame, k: int = 32, box: tuple[float, float] | None = None, max_cell: int = 256) -> DataFrame:
    """k nearest neighbours of every point (view, id, x, y), nearest first:
    (view, id, other, dist, place, mutual). ``box`` makes the plane periodic.

    Rounds of doubling radius: cells as wide as the radius are joined with
    their eight neighbours, and a point is done once it has k others within
    the radius. Each view has a radius of its own, which starts so small that no cell
    holds more than ``max_cell`` points (or 4k); of points at the very same place only
    the k + 1 with the smallest ids can matter as neighbours, so such a radius exists.
    """
    w = W.partitionBy("view", "x", "y").orderBy("id")
    src = points.select("view", "id", "x", "y").withColumn("_d", F.row_number().over(w)).filter(F.col("_d") <= k + 1).drop("_d")
    if box:
        shifts = F.array(*[F.struct(F.lit(i * box[0]).alias("sx"), F.lit(j * box[1]).alias("sy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        src = src.select("view", "id", "x", "y", F.inline(shifts)).select("view", "id", (F.col("x") + F.col("sx")).alias("x"), (F.col("y") + F.col("sy")).alias("y"))
    src = cut_lineage(src)
    if src.isEmpty():
        return points.select("view", "id", F.col("id").alias("other"), F.lit(0.0).alias("dist"), F.lit(1).alias("place"), F.lit(True).alias("mutual")).limit(0)
    start = bounded(_first_radius(src, k, max(max_cell, 4 * k)))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    todo = cut_lineage(points.select("view", "id", "x", "y"))
    found, grown = None, 1
    while not todo.isEmpty():
        radius = F.col("_r") * grown
        cells = {"_cx": F.floor(F.col("x") / radius), "_cy": F.floor(F.col("y") / radius)}
        right = src.join(bounded(todo.select("view").distinct()), "view", "left_semi").join(start, "view").withColumns(cells)
        right = right.select("view", F.col("id").alias("other"), F.col("x").alias("_ox"), F.col("y").alias("_oy"), "_cx", "_cy")
        left = todo.join(start, "view").withColumns(cells | {"_last": radius > 2 * F.col("_whole") * (3 if box else 1), "_radius": radius})
        own = ["view", "id", "x", "y", "_last", "_radius"]
        left = left.select(*own, "_cx", "_cy", F.inline(near)).select(*own, (F.col("_cx") + F.col("i")).alias("_cx"), (F.col("_cy") + F.col("j")).alias("_cy"))
        d2 = F.pow(F.col("x") - F.col("_ox"), 2) + F.pow(F.col("y") - F.col("_oy"), 2)
        p = apart(left).join(right, ["view", "_cx", "_cy"]).filter(F.col("id") != F.col("other")).withColumn("dist", F.sqrt(d2))
        p = p.filter(F.col("_last") | (F.col("dist") <= F.col("_radius")))
        if box:
            p = p.groupBy("view", "id", "other", "_last").agg(F.min("dist").alias("dist"))
        order = W.partitionBy("view", "id").orderBy(F.round("dist", 9), "other")
        p = p.select("view", "id", "other", "dist", "_last", F.row_number().over(order).alias("place")).filter(F.col("place") <= k)
        p = cut_lineage(p)
        # the whole view has been seen, or k others: done
        ended = todo.join(start, "view").filter(radius > 2 * F.col("_whole") * (3 if box else 1)).select("view", "id")
        full = cut_lineage(p.filter(F.col("place") == k).select("view", "id").unionByName(ended).distinct())
        done = p.join(full, ["view", "id"], "left_semi").drop("_last")
        found = done if found is None else found.unionByName(done)
        todo = cut_lineage(todo.join(full, ["view", "id"], "left_anti"))
        grown *= 2
    back = found.select("view", F.col("other").alias("id"), F.col("id").alias("other"), F.lit(True).alias("mutual"))
    return found.join(back, ["view", "id", "other"], "left").withColumn("mutual", F.coalesce("mutual", F.lit(False)))


def _both_ways(bonds: DataFrame, *extra: str) -> DataFrame:
    return bonds.select("view", F.col("a").alias("p"), F.col("b").alias("q"), *extra).unionAll(
        bonds.select("view", F.col("b").alias("p"), F.col("a").alias("q"), *extra)
    )


def bond_atoms(candidates: DataFrame, max_degree: int = 3, allow_quads: bool = True, max_dist: float | None = None) -> DataFrame:
    """Bonds (view, a, b, dist) from mutual candidates (view, id, other, dist).

    Every round bonds the atoms that are each other's nearest open candidate.
    A candidate is closed when an end has all its bonds, or when the bond would
    close a triangle (or a quadrangle, if they are not allowed).
    """
    c = candidates.select("view", "id", "other", "dist")
    if max_dist is not None:
        c = c.filter(F.col("dist") <= max_dist)
    a, b = F.least("id", "other"), F.greatest("id", "other")
    open_ = c.groupBy("view", a.alias("a"), b.alias("b")).agg(F.min("dist").alias("dist"))
    # equal lengths, as on a perfect lattice, are ordered by a fixed hash of the
    # bond: ranks by atom id would make long chains that wait for each other
    open_ = cut_lineage(open_.withColumn("_h", F.xxhash64("a", "b")))
    none = open_.select("view", "a", "b", "dist").limit(0)
    bonds, step = [], _both_ways(none)  # the bonds of each round; steps from atoms with open candidates
    while not open_.isEmpty():
        both = _both_ways(open_, "dist", "_h")
        best = both.groupBy("view", "p").agg(F.min(F.struct(F.round("dist", 9).alias("d"), "_h", "q")).alias("m")).select("view", "p", F.col("m.q").alias("q"))
        back = best.select("view", F.col("q").alias("p"), F.col("p").alias("q"))
        pair = apart(best).join(back, ["view", "p", "q"]).filter(F.col("p") < F.col("q"))
        new = cut_lineage(apart(open_).join(pair.select("view", F.col("p").alias("a"), F.col("q").alias("b")), ["view", "a", "b"], "left_semi"))
        if not allow_quads:
            # two new bonds may close one quadrangle: the shorter one stays
            closing = _quad_closing(new, functools.reduce(DataFrame.unionByName, bonds, new.select("view", "a", "b", "dist")))
            worse = closing.join(new.select("view", "a", "b", "dist"), ["view", "a", "b"])
            w = W.partitionBy("view", "_x", "_y").orderBy(F.round("dist", 9), "a", "b")
            worse = worse.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") > 1).select("view", "a", "b").distinct()
            new = cut_lineage(new.join(worse, ["view", "a", "b"], "left_anti"))
        bonds.append(new.select("view", "a", "b", "dist"))
        open_ = apart(open_).join(new.select("view", "a", "b"), ["view", "a", "b"], "left_anti")
        step = cut_lineage(step.unionAll(_both_ways(new)))
        full = step.groupBy("view", "p").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max_degree)
        for end in ("a", "b"):
            open_ = apart(open_).join(full.select("view", F.col("p").alias(end)), ["view", end], "left_anti")
        hop = apart(step.select("view", F.col("q").alias("m"), F.col("p").alias("a"))).join(step.select("view", F.col("q").alias("m"), F.col("p").alias("b")), ["view", "m"])
        hop = hop.filter(F.col("a") < F.col("b")).select("view", "a", "b").distinct()
        open_ = apart(open_).join(hop, ["view", "a", "b"], "left_anti")
        if not allow_quads:
            open_ = open_.join(_three_steps(step), ["view", "a", "b"], "left_anti")
        open_ = cut_lineage(open_.select("view", "a", "b", "dist", "_h"))
        if allow_quads:  # what an atom without open candidates has is of no more use
            step = apart(step).join(_both_ways(open_).select("view", "p").distinct(), ["view", "p"], "left_semi")
    return functools.reduce(DataFrame.unionByName, bonds, none)


def _three_steps(step: DataFrame) -> DataFrame:
    """Ends (a, b) of paths of three bonds."""
    one = step.select("view", F.col("p").alias("a"), F.col("q").alias("_x"))
    two = step.select("view", F.col("p").alias("_x"), F.col("q").alias("_y"))
    three = step.select("view", F.col("p").alias("_y"), F.col("q").alias("b"))
    d = one.join(two, ["view", "_x"]).filter(F.col("_y") != F.col("a")).join(three, ["view", "_y"])
    return d.filter((F.col("b") != F.col("_x")) & (F.col("a") < F.col("b"))).select("view", "a", "b").distinct()


def _quad_closing(new: DataFrame, all_bonds: DataFrame) -> DataFrame:
    """New bonds (a, b) with the path a-x-y-b beside them, keyed by the other
    two atoms, so that rival bonds of one quadrangle meet."""
    step = _both_ways(all_bonds)
    one = step.select("view", F.col("p").alias("a"), F.col("q").alias("_u"))
    two = step.select("view", F.col("p").alias("_u"), F.col("q").alias("_v"))
    three = step.select("view", F.col("p").alias("_v"), F.col("q").alias("b"))
    d = new.select("view", "a", "b").join(one, ["view", "a"]).filter(F.col("_u") != F.col("b"))
    d = d.join(two, ["view", "_u"]).filter(F.col("_v") != F.col("a")).join(three, ["view", "_v", "b"])
    quad = F.array_sort(F.array("a", "b", "_u", "_v"))
    return d.select("view", "a", "b", F.get(quad, F.lit(0)).alias("_x"), F.concat_ws(",", quad.cast("array<string>")).alias("_y"))


def _around(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Both directions p -> q of every bond, with the places of their ends and the
    angle's place among the neighbours of p."""
    xy = atoms.select("view", "atom_id", "x", "y")
    d = _both_ways(bonds)
    for end, pre in (("p", "p"), ("q", "q")):
        d = apart(d).join(xy.select("view", F.col("atom_id").alias(end), F.col("x").alias(pre + "x"), F.col("y").alias(pre + "y")), ["view", end])
    d = d.withColumn("angle", F.atan2(F.col("qy") - F.col("py"), F.col("qx") - F.col("px")))
    order = W.partitionBy("view", "p").orderBy(F.round("angle", 9), "q")  # few neighbours
    return d.withColumn("place", F.row_number().over(order))


def order_neighbors(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Neighbours q of every atom p in the order of their angle."""
    return _around(bonds, atoms).select("view", "p", "q", "angle", "place")


# -- rings -----------------------------------------------------------------------


def _placed(bonds: DataFrame, atoms: DataFrame, rows: int = 250_000) -> DataFrame:
    """Both directions (view, p, q, angle, turn) of every bond, dealt by the places of
    their first ends: range partitions of about ``rows`` rows, of neighbouring atoms, with
    all bonds of an atom in one of them. Strips of a view are about as wide as a
    partition is high."""
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    box = bounded(atoms.groupBy("view").agg(
        F.min("x").alias("_x"), F.min("y").alias("_y"), F.nullif(F.max("y") - F.min("y"), F.lit(0.0)).alias("_high"),
        F.nullif(F.sqrt(area * rows / F.count(F.lit(1)) / 3), F.lit(0.0)).alias("_w"),
    ))
    d = bonds.select("view", "a", "b")
    for end in ("a", "b"):
        d = apart(d).join(atoms.select("view", F.col("atom_id").alias(end), F.struct("x", "y").alias("_" + end)), ["view", end])
    x, y = F.col("_p.x"), F.col("_p.y")
    ways = F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(e, ("p", "q", "_p", "_q"))]) for e in (("a", "b", "_a", "_b"), ("b", "a", "_b", "_a"))])
    d = d.select("view", F.inline(ways)).join(box, "view")
    strip = F.coalesce(F.floor((x - F.col("_x")) / F.col("_w")), F.lit(0)) * F.lit(1 << 31)
    place = strip + F.coalesce(F.floor((y - F.col("_y")) / F.col("_high") * F.lit((1 << 31) - 1)), F.lit(0))
    angle = F.round(F.atan2(F.col("_q.y") - y, F.col("_q.x") - x), 9)
    d = d.select(F.col("view").cast("long"), F.col("p").cast("long"), F.col("q").cast("long"), angle.alias("angle"), (x * F.col("_q.y") - F.col("_q.x") * y).alias("turn"), place.alias("_place"))
    n = max(int(bonds.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * bonds.count() // rows))
    return d.repartitionByRange(n, "view", "_place", "p").drop("_place")


def _join_paths(paths: DataFrame, store: Store) -> DataFrame:
    """Paths (view, u, v, n, last_u, last_v), each followed by the one that its last bond
    leads to, as faces: (view, u, v, low, ahead), the smallest path of the face and the bonds
    from the start of the path to the start of that one.

    Doubling the pointer finds the smallest path ahead and how far ahead it is. A face is
    closed when the path after its name sees the name again; closed faces leave, so
    that long borders alone go through the later rounds.
    """
    o = number_rows(paths, ["view", "u", "v"], "e")
    after = o.select("view", F.col("u").alias("last_u"), F.col("v").alias("last_v"), F.col("e").alias("nx"))
    state = store.write(o.join(after, ["view", "last_u", "last_v"]).select(
        "e", "nx", F.col("nx").alias("jump"), F.col("e").alias("low"), F.lit(0).cast("long").alias("ahead"), F.col("n").alias("span")
    ))
    width, closed = 1, []

    def names(d):
        """Closed faces: the path after the name sees the name again."""
        first = d.filter(F.col("e") == F.col("low")).select(F.col("nx").alias("e"), F.col("low").alias("_m"))
        return d.select("e", "low").join(first, "e").filter(F.col("low") == F.col("_m")).select("low")

    while not state.isEmpty():
        here = state.select(F.col("e").alias("jump"), F.col("jump").alias("_j"), F.col("low").alias("_l"), F.col("ahead").alias("_a"), F.col("span").alias("_s"))
        d = state
        for _ in range(3):  # three looks ahead in one job make the pointer four times as long
            ahead = F.when(F.col("_l") < F.col("low"), F.col("_a") + F.col("span")).otherwise(F.col("ahead"))
            d = d.join(here, "jump").select(
                "e", "nx", F.col("_j").alias("jump"), F.least("low", "_l").alias("low"), ahead.alias("ahead"), (F.col("span") + F.col("_s")).alias("span")
            )
        d = store.write(d)
        store.drop(state)
        state, width = d, 4 * width
        done = store.write(names(state))
        if width > 16 and done.count() < state.filter(F.col("e") == F.col("low")).count():
            store.drop(done)
            continue  # a few long borders: they leave together
        closed.append(store.write(state.join(done, "low", "left_semi").select("e", "low", "ahead")))
        rest = store.write(state.join(done, "low", "left_anti").select("e", "nx", "jump", "low", "ahead", "span"))
        store.drop(state, done)
        state = rest
    faces = functools.reduce(DataFrame.unionByName, closed) if closed else state.select("e", "low", "ahead")
    return faces.join(o.select("e", "view", "u", "v"), "e").drop("e")


def trace_rings(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Rings of the bond graph: its inner faces.

    At each atom the bond after the arriving one, by angle, goes on. Following
    that pointer closes a face. Directed bonds are dealt by place, so most faces lie
    in one partition and are closed there (``faces``). Of a face that passes several,
    each partition has paths; the paths, one row each, are joined by rounds of
    pointers. The smallest atom names the face and ranks its corners. Faces that turn
    the other way (outer borders) or visit an atom twice are open and dropped.
    """
    ship(bonds.sparkSession)
    store = Store(bonds.sparkSession)
    d = store.write(_placed(bonds, atoms).mapInArrow(partition_faces, SCHEMA))
    rest = d.filter("size IS NULL")
    paths = _join_paths(rest.filter("n IS NOT NULL").select("view", "u", "v", "n", "last_u", "last_v"), store)
    e = apart(rest.select("view", "u", "v", "seq", "atom_id", "q", "turn")).join(paths, ["view", "u", "v"])
    e = store.write(e.select("view", "low", (F.col("seq") - F.col("ahead")).alias("at"), "atom_id", "q", "turn"))
    faces = e.groupBy("low").agg(
        F.count(F.lit(1)).alias("size"), F.sum("turn").alias("_turn"), F.count_distinct("atom_id").alias("_atoms"),
        F.min(F.struct("atom_id", "q", "at")).alias("_first"),
    )
    faces = faces.filter((F.col("_turn") > 0) & (F.col("size") > 2) & (F.col("_atoms") == F.col("size")))
    far = e.join(faces, "low").select(
        "view", F.col("_first.atom_id").alias("u"), F.col("_first.q").alias("v"), F.pmod(F.col("at") - F.col("_first.at"), F.col("size")).alias("seq"), "atom_id", "size"
    )
    every = d.filter("size IS NOT NULL").select(*far.columns).unionByName(far)
    view, atom = bonds.schema["view"].dataType, bonds.schema["a"].dataType
    return every.select(
        F.col("view").cast(view).alias("view"), F.struct(F.col("u").cast(atom).alias("u"), F.col("v").cast(atom).alias("v")).alias("low"),
        "seq", F.col("atom_id").cast(atom).alias("atom_id"), "size",
    )


def ring_edges(rings: DataFrame) -> DataFrame:
    """(view, ring_id, seq, a, b): consecutive corners, as unordered bonds."""
    order = W.partitionBy("view", "ring_id").orderBy("seq")  # one ring
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = F.coalesce(F.lead("atom_id").over(order), F.first("atom_id").over(whole))
    d = rings.withColumn("_n", nxt)
    return d.select("view", "ring_id", "seq", F.least("atom_id", "_n").alias("a"), F.greatest("atom_id", "_n").alias("b"))


def bond_sides(rings: DataFrame) -> DataFrame:
    """Rings on each side of a bond: (view, a, b, ring1, ring2, sides)."""
    e = ring_edges(rings)
    return e.groupBy("view", "a", "b").agg(
        F.min("ring_id").alias("ring1"), F.max("ring_id").alias("ring2"), F.count(F.lit(1)).alias("sides")
    )


def ring_sizes(rings: DataFrame) -> DataFrame:
    return rings.groupBy("view", "ring_id").agg(F.count(F.lit(1)).alias("size"))


def interior_rings(rings: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(view, ring_id, size, interior): as many neighbour rings as edges. ``sides`` are the
    ``bond_sides`` of the rings, where they are written already."""
    sides = (bond_sides(rings) if sides is None else sides).filter(F.col("sides") == 2)
    link = sides.select("view", F.col("ring1").alias("ring_id"), F.col("ring2").alias("_o")).unionAll(
        sides.select("view", F.col("ring2").alias("ring_id"), F.col("ring1").alias("_o"))
    )
    n = link.groupBy("view", "ring_id").agg(F.countDistinct("_o").alias("_n"))
    d = ring_sizes(rings).join(apart(n), ["view", "ring_id"], "left")
    return d.select("view", "ring_id", "size", (F.coalesce("_n", F.lit(0)) == F.col("size")).alias("interior"))


def atom_degrees(bonds: DataFrame) -> DataFrame:
    return _both_ways(bonds).groupBy("view", F.col("p").alias("atom_id")).agg(F.count(F.lit(1)).alias("degree"))


def interior_atoms(bonds: DataFrame) -> DataFrame:
    """An atom is interior when it and all its neighbours have more than two."""
    deg = atom_degrees(bonds)
    d = apart(_both_ways(bonds)).join(deg.select("view", F.col("atom_id").alias("q"), F.col("degree").alias("_dq")), ["view", "q"])
    return d.groupBy("view", F.col("p").alias("atom_id")).agg(
        ((F.count(F.lit(1)) > 2) & (F.min("_dq") > 2)).alias("interior")
    )


def interior_bonds(bonds: DataFrame) -> DataFrame:
    deg = atom_degrees(bonds)
    d = bonds.select("view", "a", "b")
    for end in ("a", "b"):
        d = apart(d).join(deg.select("view", F.col("atom_id").alias(end), F.col("degree").alias("_d" + end)), ["view", end])
    return d.select("view", "a", "b", ((F.col("_da") > 2) & (F.col("_db") > 2)).alias("interior"))


def dual_edges(rings: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """Links (view, ring1, ring2, a, b) across shared bonds; ``sides`` as in ``interior_rings``."""
    return (bond_sides(rings) if sides is None else sides).filter((F.col("sides") == 2) & (F.col("ring1") != F.col("ring2"))).select("view", "ring1", "ring2", "a", "b")


def ring_intensity(rings: DataFrame, atoms: DataFrame) -> DataFrame:
    d = rings.join(atoms.select("view", "atom_id", "weight"), ["view", "atom_id"])
    return d.groupBy("view", "ring_id").agg((-F.avg("weight") * (F.count(F.lit(1)) / F.lit(2.0) - 1)).alias("intensity"))


def ring_census(rings: DataFrame) -> DataFrame:
    """Interior rings by number of corners."""
    return interior_rings(rings).filter("interior").groupBy("view", "size").agg(F.count(F.lit(1)).alias("n"))


def _with_ends(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Bonds with the places of their ends and their length: (view, a, b, _a, _b, length)."""
    d = bonds.select("view", "a", "b")
    for end in ("a", "b"):
        d = apart(d).join(atoms.select("view", F.col("atom_id").alias(end), F.struct("x", "y", "z").alias("_" + end)), ["view", end])
    sq = sum((F.pow(F.col(f"_a.{c}") - F.col(f"_b.{c}"), 2) for c in ("x", "y", "z")), F.lit(0.0))
    return d.select("view", "a", "b", "_a", "_b", F.sqrt(sq).alias("length"))


def bond_lengths(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    d = _with_ends(bonds, atoms)
    return d.select("view", "a", "b", "length", ((F.col("_a.x") + F.col("_b.x")) / 2).alias("mx"), ((F.col("_a.y") + F.col("_b.y")) / 2).alias("my"))


def second_neighbor_distances(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Distance of atoms two bonds apart, over sqrt 3: each pair and path once."""
    xyz = atoms.select("view", F.col("atom_id").alias("a"), F.struct("x", "y", "z").alias("_a"))
    # the steps take the places of their ends along: pairs are many, and need no look-up
    s = apart(_both_ways(bonds)).join(xyz.withColumnsRenamed({"a": "p", "_a": "_p"}), ["view", "p"])
    one = s.select("view", F.col("q").alias("m"), F.col("p").alias("a"), F.col("_p").alias("_a"))
    two = s.select("view", F.col("q").alias("m"), F.col("p").alias("b"), F.col("_p").alias("_b"))
    p = apart(one).join(two, ["view", "m"]).filter(F.col("a") < F.col("b"))
    sq = sum((F.pow(F.col(f"_a.{c}") - F.col(f"_b.{c}"), 2) for c in ("x", "y", "z")), F.lit(0.0))
    return p.select("view", "a", "b", (F.sqrt(sq) / math.sqrt(3.0)).alias("length")).distinct()


def _columns(low: Column, high: Column) -> Column:
    """Numbers of the cells from ``low`` to ``high``, both in cell widths."""
    return F.explode(F.sequence(F.floor(low - 1e-9), F.floor(high + 1e-9)))


def bond_conflicts(bonds: DataFrame, atoms: DataFrame, dual: bool = False) -> DataFrame:
    """Pairs of bonds that cannot both be: (view, a, b, a2, b2, drop_first).

    Plain bonds conflict when the other's midpoint is nearer than half their
    length; dual bonds (between rings) when they cross without sharing an end,
    and then the longer one goes. Cells are as wide as the median bond of a view, for
    dual bonds twice as wide: fewer bonds pass several, and each cell's are dealt once.
    A plain bond looks into the cells of the disc around its midpoint, and each
    midpoint lies in one cell; a dual bond lies in the cells it passes, column by
    column. So a very long bond has many cells of its own and makes no cell larger.
    """
    place = [F.col(f"_{end}.{c}").alias(c + end) for end in ("a", "b") for c in ("x", "y")]
    d = cut_lineage(_with_ends(bonds, atoms).select("view", "a", "b", "length", *place) if dual else bond_lengths(bonds, atoms))
    width = F.greatest(F.percentile_approx("length", 0.5), F.lit(1e-9)) * (2 if dual else 1)
    d = d.join(bounded(d.groupBy("view").agg(width.alias("_w"))), "view")
    w = F.col("_w")
    if not dual:
        mx, my, r = F.col("mx") / w, F.col("my") / w, F.col("length") / w / 2
        left = d.select("*", _columns(mx - r, mx + r).alias("_i"))
        off = F.greatest(F.col("_i") - mx, mx - F.col("_i") - 1, F.lit(0.0))  # from the midpoint to the column
        half = F.sqrt(F.greatest(r * r - off * off, F.lit(0.0)))
        left = left.select("view", "a", "b", "mx", "my", "length", "_i", _columns(my - half, my + half).alias("_j"))
        right = d.select("view", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("mx").alias("mx2"), F.col("my").alias("my2"), F.floor(mx).alias("_i"), F.floor(my).alias("_j"))
        gap2 = F.pow(F.col("mx") - F.col("mx2"), 2) + F.pow(F.col("my") - F.col("my2"), 2)
        p = left.join(right, ["view", "_i", "_j"]).filter((F.col("a") != F.col("a2")) | (F.col("b") != F.col("b2")))
        return p.filter(F.col("length") * F.col("length") / 4 > gap2).select("view", "a", "b", "a2", "b2", F.lit(True).alias("drop_first"))
    xa, ya, xb, yb = (F.col(c) / w for c in ("xa", "ya", "xb", "yb"))
    d = d.select("*", _columns(F.least(xa, xb), F.greatest(xa, xb)).alias("_i"))
    slope = (yb - ya) / F.nullif(xb - xa, F.lit(0.0))

    def height(x):  # of the line where it enters or leaves the column
        return F.greatest(F.least(F.coalesce(ya + (x - xa) * slope, ya), F.greatest(ya, yb)), F.least(ya, yb))

    first = F.least(F.greatest(F.col("_i").cast("double"), F.least(xa, xb)), F.greatest(xa, xb))
    last = F.greatest(F.least(F.col("_i") + 1.0, F.greatest(xa, xb)), F.least(xa, xb))
    upright = slope.isNull()
    low = F.when(upright, F.least(ya, yb)).otherwise(F.least(height(first), height(last)))
    high = F.when(upright, F.greatest(ya, yb)).otherwise(F.greatest(height(first), height(last)))
    d = d.select("view", "a", "b", "length", "xa", "ya", "xb", "yb", "_i", _columns(low, high).alias("_j"))
    cols = ["a", "b", "length", "xa", "ya", "xb", "yb"]
    # both sides are the same table under the same names: it is shuffled once
    one, two, cell = apart(d).alias("one"), d.alias("two"), ("view", "_i", "_j")
    p = one.join(two, [F.col(f"one.{c}") == F.col(f"two.{c}") for c in cell])
    p = p.select("one.view", *[F.col(f"one.{c}") for c in cols], *[F.col(f"two.{c}").alias(c + "2") for c in cols])
    p = p.filter(F.struct("a", "b") < F.struct(F.col("a2").alias("a"), F.col("b2").alias("b")))
    shared = (F.col("a") == F.col("a2")) | (F.col("a") == F.col("b2")) | (F.col("b") == F.col("a2")) | (F.col("b") == F.col("b2"))

    def side(px, py, qx, qy, rx, ry):
        return (F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px))

    s1, s2 = side("xa", "ya", "xb", "yb", "xa2", "ya2"), side("xa", "ya", "xb", "yb", "xb2", "yb2")
    t1, t2 = side("xa2", "ya2", "xb2", "yb2", "xa", "ya"), side("xa2", "ya2", "xb2", "yb2", "xb", "yb")
    p = p.filter(~shared & (s1 * s2 < 0) & (t1 * t2 < 0))
    # bonds that pass two cells together meet in both
    return p.select("view", "a", "b", "a2", "b2", (F.col("length") > F.col("length2")).alias("drop_first")).distinct()


def defect_seeds(rings: DataFrame, sizes: tuple[int, ...] = (5, 6, 7)) -> DataFrame:
    """Atoms whose three interior rings have just these sizes."""
    s = interior_rings(rings).filter("interior")
    d = rings.join(s.select("view", "ring_id", "size"), ["view", "ring_id"]).groupBy("view", "atom_id").agg(F.sort_array(F.collect_list("size")).alias("_s"))
    want = F.array(*[F.lit(v).cast("long") for v in sorted(sizes)])
    return d.filter(F.col("_s") == want).select("view", "atom_id")


def defect_patterns(rings: DataFrame, bonds: DataFrame, atoms: DataFrame, side: int = 5, far_size: int = 7) -> DataFrame:
    """Ring patterns that point to bad atoms: (view, kind, atom_id, action, x, y).

    7557: a bond between two 5-rings whose ends each touch just one ring of 7
    or more; both atoms go. z5: a bond between two 5-rings whose ends have four
    rings, the far ring at each end having at most 5; both atoms go, and an
    atom is added at the middle of each other bond of the end that borders the
    far ring. Only interior bonds count. ``side`` is the size of the two rings
    beside the bond, ``far_size`` the least size of the rings at its ends.
    """
    store = Store(rings.sparkSession)
    ends = _defect_ends(rings, side, far_size)
    pair = ["view", "a", "b", "kind"]
    both = ends.filter("atom_id = a").withColumnsRenamed({"atom_id": "_ea", "_far": "_fa", "_beside": "_ba"}).join(
        apart(ends.filter("atom_id = b").withColumnsRenamed({"atom_id": "_eb", "_far": "_fb", "_beside": "_bb"})), pair)
    end = [F.struct(F.col("_e" + e).alias("atom_id"), F.col("_f" + e).alias("_far"), F.col("_b" + e).alias("_beside")) for e in ("a", "b")]
    ends = store.write(both.select(*pair, F.inline(F.array(*end))))
    # bonds at the ends alone: the degrees of both, the bond itself, and the others of an end
    p = ends.select("view", F.col("atom_id").alias("p")).distinct()
    step = [apart(bonds.select("view", F.col(e).alias("p"), F.col(f).alias("q"), F.lit(e == "a").alias("_up"))).join(p, ["view", "p"], "left_semi") for e, f in (("a", "b"), ("b", "a"))]
    step = store.write(step[0].unionByName(step[1]))
    inner = step.groupBy("view", F.col("p").alias("atom_id")).agg((F.count(F.lit(1)) > 2).alias("_in"))
    inner = ends.join(apart(inner), ["view", "atom_id"]).groupBy(*pair).agg(F.min("_in").alias("_in")).filter("_in").drop("_in")
    inner = inner.join(apart(step.filter("_up").select("view", F.col("p").alias("a"), F.col("q").alias("b"))), ["view", "a", "b"], "left_semi")
    ends = store.write(ends.join(apart(inner), pair, "left_semi"))
    z = apart(ends.filter(F.col("kind") == "z5")).join(step.select("view", F.col("p").alias("atom_id"), "q"), ["view", "atom_id"]).filter(~F.col("q").isin(F.col("a"), F.col("b")))
    touch = F.exists("_beside", lambda x: (x["q"] == F.col("q")) & (F.array_contains("_far", x["ring1"]) | F.array_contains("_far", x["ring2"])))
    z = z.filter(touch).select("view", "kind", F.least("atom_id", "q").alias("a"), F.greatest("atom_id", "q").alias("b")).distinct()
    z = store.write(z)
    drop = ends.select("view", "kind", "atom_id").distinct()
    spot = drop.select("view", "atom_id").union(z.select("view", "a")).union(z.select("view", "b")).distinct()
    spots = store.write(apart(atoms.select("view", "atom_id", "x", "y", "z")).join(spot, ["view", "atom_id"], "left_semi"))
    drop = apart(drop).join(spots, ["view", "atom_id"]).select("view", "kind", "atom_id", F.lit("drop").alias("action"), "x", "y")
    mid = bond_lengths(z, spots)
    add = mid.select("view", F.lit("z5").alias("kind"), F.lit(None).cast("long").alias("atom_id"), F.lit("add").alias("action"), F.col("mx").alias("x"), F.col("my").alias("y"))
    return drop.unionByName(add)


def _visits(rings: DataFrame) -> DataFrame:
    """Corners (view, p, ring_id, size, q0, q1, corner) with the atoms before and after them,
    the rings dealt by their own key once. In a ring with atoms that are null, bonds are as in
    ``ring_edges`` and rows of their own."""
    c = F.col("c")
    first, none = F.get(c, F.lit(0))["atom"], F.lit(None).cast(rings.schema["atom_id"].dataType)

    def row(p, q0, q1, corner):
        return F.struct(p.alias("p"), q0.alias("q0"), q1.alias("q1"), F.lit(corner).alias("corner"))

    plain = F.transform(c, lambda x, i: row(x["atom"], F.get(c, F.pmod(i - 1, F.size(c)))["atom"], F.get(c, F.pmod(i + 1, F.size(c)))["atom"], True))
    after = lambda i: F.coalesce(F.get(c, i + 1)["atom"], first)
    sides = F.transform(c, lambda x, i: F.struct(F.least(x["atom"], after(i)).alias("a"), F.greatest(x["atom"], after(i)).alias("b")))
    odd = F.concat(
        F.transform(c, lambda x: row(x["atom"], none, none, True)),
        F.transform(sides, lambda e: row(e["a"], none, e["b"], False)),
        F.transform(F.filter(sides, lambda e: e["a"] != e["b"]), lambda e: row(e["b"], none, e["a"], False)),
    )
    r = rings.filter("view is not null").groupBy("view", "ring_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("atom_id").alias("atom")))).alias("c"))
    rows = F.when(F.exists(c, lambda x: x["atom"].isNull()), odd).otherwise(plain)
    return r.select("view", "ring_id", F.size("c").cast("long").alias("size"), F.inline(rows))


def _defect_ends(rings: DataFrame, side: int, far_size: int) -> DataFrame:
    """Ends of bonds between two rings of size ``side`` whose other rings are those of a
    pattern: (view, a, b, kind, atom_id, _far, _beside). ``_far`` are the small rings of the
    end that are not beside the bond, ``_beside`` its bonds (q, ring1, ring2).

    All that is asked of an end lies at its atom, so corners are dealt by atom once."""
    v = _visits(rings).filter("p is not null")
    n = parts_for(rings.count(), rings.sparkSession)
    ring = F.struct("ring_id", "size")
    half = lambda q: F.struct(q.alias("q"), F.col("ring_id"), F.col("size"))
    # a bond to the atom itself is seen from both its ends here, and counts once
    halves = F.array_compact(F.array(F.when(F.col("q1").isNotNull(), half(F.col("q1"))), F.when(F.col("q0") != F.col("p"), half(F.col("q0")))))
    at = v.repartition(n, "view", "p").groupBy("view", "p").agg(
        F.collect_list(F.when(F.col("corner") & F.col("ring_id").isNotNull(), ring)).alias("_r"), F.flatten(F.collect_list(halves)).alias("_h"),
    )
    at = at.filter(F.size("_r").isin(3, 4) & F.exists("_h", lambda h: h["size"] == side))
    known = lambda hs: F.filter(hs, lambda h: h["ring_id"].isNotNull())
    beside = F.transform(F.array_distinct(F.transform("_h", lambda h: h["q"])), lambda q: F.struct(q.alias("q"), F.filter("_h", lambda h: h["q"] == q).alias("hs")))
    beside = F.transform(beside, lambda e: F.struct(
        e["q"].alias("q"), F.array_min(F.transform(e["hs"], lambda h: h["ring_id"])).alias("ring1"), F.array_max(F.transform(e["hs"], lambda h: h["ring_id"])).alias("ring2"),
        ((F.size(e["hs"]) == 2) & (F.size(known(e["hs"])) > 0) & F.forall(known(e["hs"]), lambda h: h["size"] == side)).alias("five"),
    ))
    d = at.withColumn("_b", beside).filter(F.exists("_b", lambda e: e["five"]))
    d = d.select("view", "p", "_r", F.transform("_b", lambda e: F.struct(e["q"], e["ring1"], e["ring2"])).alias("_beside"), F.inline(F.filter("_b", lambda e: e["five"])))
    far = F.filter("_r", lambda r: (r["ring_id"] != F.col("ring1")) & (r["ring_id"] != F.col("ring2")))
    d = d.withColumn("_o", far)
    small = F.transform(F.filter("_o", lambda r: r["size"] <= 5), lambda r: r["ring_id"])
    big = F.size(F.filter("_o", lambda r: r["size"] >= far_size))
    # four rings: the ring at an end that shares no edge with the bond
    kind = F.when((F.size("_r") == 3) & (big == 1), "7557").when((F.size("_r") == 4) & (F.size(small) >= 1), "z5")
    d = d.select("view", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), kind.alias("kind"), F.col("p").alias("atom_id"), small.alias("_far"), "_beside").filter("kind is not null")
    return Store(rings.sparkSession).write(d)


def straight_atoms(bonds: DataFrame, atoms: DataFrame, limit: float = -0.85) -> DataFrame:
    """Atoms with two bonds that lie nearly on one line; they are dropped."""
    o = _both_ways(bonds)
    two = o.groupBy("view", "p").agg(F.count(F.lit(1)).alias("n"), F.min("q").alias("q1"), F.max("q").alias("q2")).filter(F.col("n") == 2)
    for end in ("p", "q1", "q2"):
        two = two.join(atoms.select("view", F.col("atom_id").alias(end), F.struct("x", "y").alias("_" + end)), ["view", end])
    ux, uy = F.col("_q1.x") - F.col("_p.x"), F.col("_q1.y") - F.col("_p.y")
    vx, vy = F.col("_q2.x") - F.col("_p.x"), F.col("_q2.y") - F.col("_p.y")
    c = (ux * vx + uy * vy) / F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))
    return two.select("view", F.col("p").alias("atom_id"), c.alias("cosine")).filter(F.col("cosine") < limit)


def compact_topology(atoms: DataFrame, bonds: DataFrame, rings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop bonds with a missing atom, rings with a missing bond and atoms
    without bonds; number atoms from 0 per view by their old id.

    Numbers come from two levels, so that a large view is never ranked by one
    task: ids are cut into blocks, and the blocks of a view are summed.
    """
    alive = atoms.select("view", "atom_id")
    b = bonds
    for end in ("a", "b"):
        b = apart(b).join(alive.withColumnRenamed("atom_id", end), ["view", end], "left_semi")
    b = cut_lineage(b.select("view", "a", "b"))
    e = ring_edges(rings)
    torn = apart(e).join(b, ["view", "a", "b"], "left_anti").select("view", "ring_id").distinct()
    r = rings.join(torn, ["view", "ring_id"], "left_anti")
    used = b.select("view", F.col("a").alias("atom_id")).union(b.select("view", "b")).distinct()
    block = F.floor(F.col("atom_id") / 65536)
    u = used.withColumn("_bl", block)
    along = W.partitionBy("view").orderBy("_bl").rowsBetween(W.unboundedPreceding, -1)
    before = u.groupBy("view", "_bl").agg(F.count(F.lit(1)).alias("_n")).select("view", "_bl", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    inside = W.partitionBy("view", "_bl").orderBy("atom_id")
    num = u.withColumn("_k", F.row_number().over(inside) - 1).join(before, ["view", "_bl"]).select("view", "atom_id", (F.col("_k") + F.col("_before")).alias("new_id"))
    num = cut_lineage(num)
    new_atoms = atoms.join(apart(num), ["view", "atom_id"])
    new_bonds = b
    for end in ("a", "b"):
        new_bonds = apart(new_bonds).join(num.select("view", F.col("atom_id").alias(end), F.col("new_id").alias("_" + end)), ["view", end])
    new_bonds = new_bonds.select("view", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    new_rings = r.join(apart(num), ["view", "atom_id"]).select("view", "ring_id", "seq", F.col("new_id").alias("atom_id"))
    return new_atoms, new_bonds, new_rings


# -- signatures ------------------------------------------------------------------


def ring_centers(rings: DataFrame, atoms: DataFrame) -> DataFrame:
    d = rings.join(atoms.select("view", "atom_id", "x", "y"), ["view", "atom_id"])
    return d.groupBy("view", "ring_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def ring_signature(rings: DataFrame, atoms: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ring sizes level by level around each seed (view, atom_id), until the
    border: (view, seed, level, line).

    Level 0 is the three rings of the seed, written by size; the following
    levels are the rings that touch the one before, in the order of their
    angle around the seed, starting from its smallest ring and turning towards
    the second. The last level before one with a border ring is the end.
    """
    store = Store(rings.sparkSession)
    info = apart(interior_rings(rings)).join(ring_centers(rings, atoms), ["view", "ring_id"])
    links = dual_edges(rings).select("view", "ring1", "ring2")
    links = links.unionAll(links.select("view", F.col("ring2").alias("ring1"), F.col("ring1").alias("ring2")))
    beside = links.groupBy("view", F.col("ring1").alias("ring_id")).agg(F.collect_set("ring2").alias("_beside"))
    ring = store.write(info.join(apart(beside), ["view", "ring_id"], "left"))
    s = seeds.select("view", F.col("atom_id").alias("seed"))
    first = s.join(apart(rings.select("view", F.col("atom_id").alias("seed"), "ring_id")), ["view", "seed"])
    pos = atoms.select("view", F.col("atom_id").alias("seed"), F.col("x").alias("_sx"), F.col("y").alias("_sy"))
    none = F.lit(None).cast("double")
    # a seed is one row: the rings of its level and of the one before
    state = first.groupBy("view", "seed").agg(F.collect_list("ring_id").alias("_now")).join(apart(pos), ["view", "seed"])
    state = store.write(state.withColumns({"_before": F.array().cast(state.schema["_now"].dataType), "_a0": none, "_a1": none}))
    out = state.select("view", "seed", F.lit(0).alias("level"), F.lit("").alias("line")).limit(0)
    tau, n = F.lit(2 * math.pi), 0

    def angle(e):
        return F.atan2(e["y"] - F.col("_sy"), e["x"] - F.col("_sx"))

    def turn(e):
        sign = F.when(F.pmod(F.col("_a1") - F.col("_a0"), tau) <= math.pi, 1).otherwise(-1)
        return F.round(F.pmod(sign * (angle(e) - F.col("_a0")) + 1e-7, tau), 6)

    while not state.isEmpty():  # neighbours of a level lie in it, in the one before, or are the next one
        d = state.select("view", "seed", F.explode("_now").alias("ring_id")).join(apart(ring), ["view", "ring_id"], "left")
        d = d.groupBy("view", "seed").agg(
            F.min("interior").alias("_in"), F.min(F.coalesce("interior", F.lit(False))).alias("_grow"),
            F.collect_list(F.when(F.col("size").isNotNull(), F.struct("size", "ring_id", "x", "y"))).alias("_rings"),
            F.array_distinct(F.flatten(F.collect_list("_beside"))).alias("_next"),
        ).join(apart(state), ["view", "seed"])
        if n == 0:
            # direction of the smallest ring, and the turn towards the second smallest
            start = F.sort_array(F.transform("_rings", lambda e: F.struct(e["size"].alias("size"), F.round(angle(e), 9).alias("a"))))
            d = d.withColumns({"_a0": F.get(start, F.lit(0))["a"], "_a1": F.get(start, F.lit(1))["a"]})
        # level 0 by size, further levels by turn
        key = turn if n else lambda e: e["size"].cast("double")
        line = F.sort_array(F.transform("_rings", lambda e: F.struct(key(e).alias("k"), e["ring_id"].alias("r"), e["size"].alias("size"))))
        following = F.when(F.col("_grow"), F.array_except(F.array_except("_next", "_now"), "_before"))
        d = store.write(d.select(
            "view", "seed", F.lit(n).alias("level"), F.concat_ws("-", F.transform(line, lambda e: e["size"].cast("string"))).alias("line"),
            "_in", "_sx", "_sy", "_a0", "_a1", following.alias("_now"), F.col("_now").alias("_before"),
        ))
        out = out.unionByName(d.filter("_in").select("view", "seed", "level", "line"))
        state, n = d.filter(F.size("_now") > 0).drop("level", "line", "_in"), n + 1
    return out


def match_signatures(mine: DataFrame, other: DataFrame, center: DataFrame | None = None) -> DataFrame:
    """Score of the common leading lines of each seed with the one signature
    ``other`` (level, line): the sum of (1 + rings in the line) / 2, and the
    best seed of each view. On a tie the seed nearest the centre (view, seed,
    dist) wins, then the smaller id.
    """
    d = mine.join(other.select("level", F.col("line").alias("_o")), "level", "left")
    d = d.withColumn("_same", F.coalesce(F.col("line") == F.col("_o"), F.lit(False)))
    order = W.partitionBy("view", "seed").orderBy("level")  # a few levels
    d = d.withColumn("_all", F.min("_same").over(order))
    length = F.size(F.split("line", "-"))
    s = d.groupBy("view", "seed").agg(F.sum(F.when(F.col("_all"), (1 + length) / F.lit(2.0)).otherwise(0.0)).alias("score"))
    if center is not None:
        s = s.join(center, ["view", "seed"])
    else:
        s = s.withColumn("dist", F.lit(0.0))
    best = F.max(F.struct("score", (-F.round("dist", 9)).alias("nd"), (-F.col("seed")).alias("ns"))).alias("b")
    top = s.groupBy("view").agg(best).select("view", (-F.col("b.ns")).alias("seed"), F.lit(True).alias("best"))
    return s.join(top, ["view", "seed"], "left").select("view", "seed", "score", F.coalesce("best", F.lit(False)).alias("best"))


# -- views -----------------------------------------------------------------------


def _plain(c: Column, size) -> Column:
    """Whether the corners of a sorted list are numbered 0, 1, ... ``size`` - 1."""
    return F.coalesce((F.size(c) == size) & F.forall(F.transform(c, lambda x, i: x["seq"] == i), lambda b: b), F.lit(False))


def _sides(c: Column) -> Column:
    """Each corner (seq, atom, size) of a ring with the one that follows it, or with all
    that do where numbers come twice: (seq, size, a, b)."""
    side = lambda x, y: F.struct(x["seq"].alias("seq"), x["size"].alias("size"), x["atom"].alias("a"), y["atom"].alias("b"))
    ring = F.transform(c, lambda x, i: side(x, F.get(c, F.pmod(i + 1, F.size(c)))))
    odd = F.flatten(F.transform(c, lambda x: F.transform(F.filter(c, lambda y: y["seq"] == (x["seq"] + 1) % x["size"]), lambda y: side(x, y))))
    return F.when(_plain(c, F.get(c, F.lit(0))["size"]), ring).otherwise(odd)


def _linked_sides(c: Column, size: Column) -> Column:
    """Corners that follow each other among the linked ones (seq, a, m, new) of a ring, at
    least one of them new: (seq, a, b, ma, mb)."""
    side = lambda x, y: F.struct(x["seq"].alias("seq"), x["a"].alias("a"), y["a"].alias("b"), x["m"].alias("ma"), y["m"].alias("mb"))
    follows = lambda x, y: (y["seq"] == (x["seq"] + 1) % size) & (x["new"] | y["new"])
    after = lambda x, i: F.coalesce(F.get(c, i + 1), F.get(c, F.lit(0)))
    ring = F.transform(c, lambda x, i: F.when(follows(x, after(x, i)), side(x, after(x, i))).otherwise(
        F.when(follows(x, F.get(c, F.lit(0))), side(x, F.get(c, F.lit(0))))))
    odd = F.flatten(F.transform(c, lambda x: F.transform(F.filter(c, lambda y: follows(x, y)), lambda y: side(x, y))))
    seqs = F.transform(c, lambda x: x["seq"])
    once = (F.size(F.array_distinct(seqs)) == F.size(c)) & F.forall(c, lambda x: x["seq"].between(0, size - 1))
    return F.when(F.coalesce(once, F.lit(False)), F.array_compact(ring)).otherwise(odd)


def _in_step() -> Column:
    """Corners ``vc`` of a view ring with those of the master ring, ``mc``, at the same
    number of steps from the bond where they meet: (va, ma)."""
    vc, mc, n = F.col("vc"), F.col("mc"), F.col("size")
    meets = lambda x: F.pmod(F.col("mseq") + (x["seq"] - F.col("seq")), n)
    pair = lambda x, y: F.struct(x["atom"].alias("va"), y["atom"].alias("ma"))
    ring = F.transform(F.filter(vc, lambda x: x["seq"].isNotNull()), lambda x: pair(x, F.get(mc, meets(x).cast("int"))))
    odd = F.flatten(F.transform(vc, lambda x: F.transform(F.filter(mc, lambda y: y["seq"] == meets(x)), lambda y: pair(x, y))))
    return F.when(_plain(mc, n), ring).otherwise(odd)


def merge_views(
    m_atoms: DataFrame, m_rings: DataFrame, v_atoms: DataFrame, v_rings: DataFrame, start: DataFrame,
    shift: tuple[float, float] = (0.0, 0.0),
) -> tuple[DataFrame, DataFrame]:
    """Link the atoms of views to a master mesh.

    The corners of all rings must turn the same way. ``start`` (view, atom_id,
    master) holds two bonded atoms of one matched ring per view. A view ring with two linked corners in a row takes the
    master ring across the same bond; corners are linked in step around it,
    and its bonds carry on to the next rings. Rounds grow with the distance
    from the seed, not with the number of rings. A ring of another size, or a
    corner that would get two masters, drops the view. Atoms without a master
    are new: their (shifted) place becomes a master node.

    A round looks only at what was linked in the last one: rings learn the masters of
    their corners, and bonds with two linked corners, one of them new, ask for master
    rings. The tables of both meshes are written in hash buckets once and stay there.

    Gives links (view, atom_id, master, is_new) and nodes (master, observers,
    x, y).
    """
    spark = v_rings.sparkSession
    store, tables = Store(spark), Buckets(spark)
    v_count, m_count = (parts_for(r.count(), spark) for r in (v_rings, m_rings))
    corner = F.struct("seq", F.col("atom_id").alias("atom"))
    vs = v_rings.filter("view is not null and ring_id is not null").repartition(v_count, "view", "ring_id").groupBy("view", "ring_id")
    vr = tables.write(vs.agg(F.sort_array(F.collect_list(corner)).alias("vc")).withColumnRenamed("ring_id", "vr"), v_count, "view", "vr")
    ms = m_rings.filter("view is not null and ring_id is not null").repartition(m_count, "ring_id").groupBy("view", "ring_id").agg(F.collect_list(corner).alias("c"))
    ms = ms.withColumn("c", F.transform("c", lambda x: x.withField("size", F.size("c")))).groupBy("ring_id")
    mr = tables.write(ms.agg(F.sort_array(F.flatten(F.collect_list("c"))).alias("mc")).withColumnRenamed("ring_id", "mr"), m_count, "mr")
    at = vr.select("view", "vr", F.size("vc").alias("size"), F.inline("vc")).select("view", F.col("atom").alias("va"), "vr", "seq", "size")
    at = tables.write(at.repartition(v_count, "view", "va"), v_count, "view", "va")
    me = mr.select("mr", F.inline(_sides(F.col("mc")))).select(F.col("a").alias("ma"), F.col("b").alias("mb"), "mr", F.col("size").alias("msize"), F.col("seq").alias("mseq"))
    me = tables.write(me.repartition(m_count, "ma", "mb"), m_count, "ma", "mb")

    first = store.write(start.select("view", F.col("atom_id").alias("va"), F.col("master").alias("ma")))
    links = linked = fresh = last = first
    bad = store.write(first.select("view").limit(0))
    used = store.write(at.select("view", "vr", F.lit(None).cast(m_rings.schema["ring_id"].dataType).alias("mr")).limit(0))  # linked rings
    known = known_table = None  # linked corners of rings
    while True:  # each round links a ring or drops a view
        # rings learn the masters of their corners that were linked in the last round
        place = F.struct("seq", F.col("va").alias("a"), F.col("ma").alias("m"), F.lit(True).alias("new"))
        parts = fresh.join(at, ["view", "va"]).select("view", "vr", "size", F.array(place).alias("c"), F.lit(False).alias("gone"))
        c_type = parts.schema["c"].dataType
        parts = parts.unionByName(used.select("view", "vr", F.lit(None).cast("int").alias("size"), F.lit(None).cast(c_type).alias("c"), F.lit(True).alias("gone")))
        if known is not None:
            old = F.transform("c", lambda x: x.withField("new", F.lit(False)))
            parts = parts.unionByName(known.select("view", "vr", "size", old.alias("c"), F.lit(False).alias("gone")))
        rings = parts.repartition(v_count, "view", "vr").groupBy("view", "vr").agg(F.max("size").alias("size"), F.sort_array(F.flatten(F.collect_list("c"))).alias("c"), F.max("gone").alias("gone"))
        heard = store.write(rings.filter("not gone").drop("gone"))
        # bonds with two linked corners, one of them new, and the master's rings there
        e = heard.select("view", "vr", "size", F.inline(_linked_sides(F.col("c"), F.col("size")))).filter("a <> b")
        up = F.col("a") < F.col("b")  # seq and dir are those of the end with the smaller name
        cand = e.join(me, ["ma", "mb"]).select(
            "view", "vr", "mr", "size", "msize", F.when(up, F.col("seq")).otherwise((F.col("seq") + 1) % F.col("size")).alias("seq"),
            F.when(up, F.col("mseq")).otherwise((F.col("mseq") + 1) % F.col("msize")).alias("mseq"), F.when(up, 1).otherwise(-1).alias("dir"),
        )
        cand = cand.join(apart(used.select("view", "mr")), ["view", "mr"], "left_anti")
        one = cand.groupBy("view", "vr").agg(F.min(F.struct("mr", "size", "msize", "seq", "mseq", "dir")).alias("c")).select("view", "vr", "c.*")
        w = one.join(mr, "mr").join(vr, ["view", "vr"])
        fit = F.col("size") == F.col("msize")
        w = store.write(w.select("view", "vr", "mr", fit.alias("fit"), F.when(fit, _in_step()).alias("pairs")))
        if w.isEmpty():
            break
        # links that are old and new, each once, and how many masters their atom has
        new = w.filter("fit").select("view", F.inline("pairs")).withColumn("fresh", F.lit(True))
        both = linked.select("view", "va", "ma", F.lit(False).alias("fresh")).unionByName(new).repartition(v_count, "view", "va")
        both = both.groupBy("view", "va", "ma").agg(F.min("fresh").alias("fresh"))
        allw = store.write(both.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("view", "va"))))
        twice = allw.filter("n > 1").select("view").union(allw.groupBy("view", "ma").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("view"))
        misfit = w.filter("not fit").select("view")
        worse = store.write(bad.union(misfit).union(twice).distinct())
        linked = links = allw.join(worse, "view", "left_anti").select("view", "va", "ma", "fresh")
        fresh, links = linked.filter("fresh").drop("fresh"), links.drop("fresh")
        more = store.write(used.unionByName(w.filter("fit").select("view", "vr", "mr")).join(worse, "view", "left_anti"))
        rest = heard.join(worse, "view", "left_anti")
        store.drop(used, bad, known_table, last)
        used, bad, known, known_table, last = more, worse, rest, heard, allw
        store.drop(w)
    tables.drop()
    sx, sy = shift
    va = v_atoms.join(bad, "view", "left_anti").select("view", F.col("atom_id").alias("va"), (F.col("x") + sx).alias("x"), (F.col("y") + sy).alias("y"))
    d = store.write(va.join(apart(links), ["view", "va"], "left"))
    # new nodes: places that agree between views are one node
    new = d.filter(F.col("ma").isNull()).withColumns({"_kx": F.round(F.col("x"), 1), "_ky": F.round(F.col("y"), 1)})
    node = new.groupBy("_kx", "_ky").agg(F.min(F.struct("view", "va", "x", "y")).alias("f"))
    new_id = -(F.col("f.view") * F.lit(1 << 40) + F.col("f.va") + 1)
    node = node.select("_kx", "_ky", new_id.alias("master"), F.col("f.x").alias("nx"), F.col("f.y").alias("ny"))
    added = new.join(node, ["_kx", "_ky"]).select("view", F.col("va").alias("atom_id"), "master", F.lit(True).alias("is_new"))
    known = d.filter(F.col("ma").isNotNull()).select("view", F.col("va").alias("atom_id"), F.col("ma").alias("master"), F.lit(False).alias("is_new"))
    out = cut_lineage(known.unionByName(added))
    seen = out.groupBy("master").agg(F.count(F.lit(1)).alias("observers"))
    base = m_atoms.select(F.col("atom_id").alias("master"), "x", "y").unionByName(node.select("master", F.col("nx").alias("x"), F.col("ny").alias("y")))
    nodes = base.join(seen, "master", "left").select("master", F.coalesce("observers", F.lit(0)).alias("observers"), "x", "y")
    return out, nodes
