"""Lattice search, resampling to hexagons and cutting of sub-frames."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from honeyframe.functions import hexgrid as H, lattice as L
from honeyframe.operators import pixels as P
from honeyframe.operators.numbering import number_rows
from honeyframe.operators.search import GEOMETRY, CellScores
from honeyframe.session import apart, cut_lineage, ship, spread

# Relative and angular half widths of the search box per level.
WIDTHS = ((0.005, math.pi / 360), (0.02, math.pi / 90), (0.04, math.pi / 45), (0.08, math.pi / 22.5))

# Pixels of the frames that a task scores side by side.
BLOCK = 1 << 14

def candidate_grid(params: DataFrame, kind: int, width: int, rank: int, scale: Column | float = 1.0) -> DataFrame:
    """Trial lattices around the present one: 2^rank + 1 points per axis of
    (edge length, tilt) for kind 0, (excentricity, phi) for kind 1.

    ``cand`` 0 is the present lattice itself; ``edge`` marks the rim of the box.
    """
    rel, ang = WIDTHS[width]
    steps = 1 << rank
    half = steps // 2
    side = steps + 1
    a, b = ("hel", "tilt") if kind == 0 else ("excent", "phi")
    k = F.explode(F.sequence(F.lit(0), F.lit(side * side))).alias("cand")
    d = params.withColumn("_scale", F.lit(scale) if isinstance(scale, float) else scale).select("*", k)
    i = F.when(F.col("cand") == 0, 0).otherwise(F.floor((F.col("cand") - 1) / side) - half)
    j = F.when(F.col("cand") == 0, 0).otherwise((F.col("cand") - 1) % side - half)
    d = d.withColumns({"_i": i, "_j": j})
    return d.withColumns(
        {
            a: F.col(a) * (1 + rel * F.col("_scale") * F.col("_i") / half),
            b: F.col(b) + ang * F.col("_scale") * F.col("_j") / half,
            "edge": (F.abs("_i") == half) | (F.abs("_j") == half),
        }
    ).drop("_i", "_j", "_scale")


def score_candidates(
    pixels: DataFrame, grid: DataFrame, bond: int, res: int, width: int, height: int, sub: int = 1, shape: bool = True
) -> DataFrame:
    """500 std / mean of the folded cell of every candidate, times the sharpness
    of its position (``shape``). All candidates of all frames in one job.

    Repeats of a random sampling are replaced by a fixed grid of sub-points.
    """
    keys = ["frame_id", "cand"]
    params = grid.select(*keys, *GEOMETRY)
    hits = P.fold_cells(pixels, params, bond, res, width, height, sub, keys)
    # one orientation: cells that share bins with it, not with the other
    sums = P.cell_sums(P.clean_cells(hits.filter(F.col("orient") == 0), keys), keys)
    cell = P.full_cell(sums, keys, res)
    g = cell.groupBy(*keys).agg((500 * F.stddev_pop("value") / F.nullif(F.avg("value"), F.lit(0.0))).alias("contrast"))
    if not shape:
        return g.withColumn("score", F.col("contrast"))
    q = P.position_quality(P.template_offset(cell, res, keys=keys), res, keys)
    return g.join(q, keys, "left").withColumn("score", F.col("contrast") * F.coalesce("positionQ", F.lit(0.0)))


def _search(pixels: DataFrame, params: DataFrame, run, extra: list[T.StructField], *, bond, res, width, height, sub, shape) -> DataFrame:
    """A search of each frame. A row is a lattice with the list of its frame's pixels, rows
    are spread over the session's shuffle width, and a task scores blocks of them side by
    side; only numbers of the frame itself are used. A frame without pixels keeps its
    lattice with score 0."""
    ship(pixels.sparkSession)
    fields = [params.schema["frame_id"], *(T.StructField(g, T.DoubleType()) for g in GEOMETRY), T.StructField("score", T.DoubleType()), *extra]

    def rows(batches):
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch["_px"]), 0).to_numpy(zero_copy_only=False)
            flat = batch["_px"].flatten()
            cols = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "value", "mask")]
            ends, lattices = np.cumsum(n), np.array([batch[g].to_numpy(zero_copy_only=False) for g in GEOMETRY], float)
            found, lo = [], 0
            while lo < len(n):
                hi, most = lo + 1, n[lo]
                while hi < len(n) and max(most, n[hi]) * (hi + 1 - lo) * sub * sub <= BLOCK:
                    most, hi = max(most, n[hi]), hi + 1
                block = [[c[ends[k] - n[k] : ends[k]] for c in cols] for k in range(lo, hi)]
                found.append(run(CellScores(block, bond, res, width, height, sub, shape), lattices[:, lo:hi]))
                lo = hi
            if found:
                p, *rest = (np.concatenate(c, axis=-1) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([batch["frame_id"], *(pa.array(v) for v in (*p, *rest))], names=[f.name for f in fields])

    asked = params.select("frame_id", *[F.col(g).cast("double").alias(g) for g in GEOMETRY])
    lists = pixels.groupBy("frame_id").agg(F.collect_list(F.struct("x", "y", "value", "mask")).alias("_px"))  # one frame
    return spread(asked.join(apart(lists), "frame_id", "left"), "frame_id").mapInArrow(rows, T.StructType(fields))


def coarse_to_fine(
    pixels: DataFrame, params: DataFrame, bond: int, res: int, width: int, height: int, stability: int = 1,
    levels: int = 3, sub: int = 1, shape: bool = True,
) -> DataFrame:
    """Search edge length and tilt, then excentricity and phi, on boxes that
    halve around the best point; cycles repeat for frames that still gain more
    than one percent. The present lattice is always a candidate, so the score
    does not fall. ``at_edge`` flags a best point on the rim of the first box.
    """
    return _search(
        pixels, params, lambda cells, p: cells.zoom(p, WIDTHS, stability, levels), [T.StructField("at_edge", T.BooleanType())],
        bond=bond, res=res, width=width, height=height, sub=sub, shape=shape,
    )


def coordinate_refine(
    pixels: DataFrame, params: DataFrame, bond: int, res: int, width: int, height: int,
    sub: int = 1, shape: bool = True, fine: float = 0.2, least: float = 1e-4,
) -> DataFrame:
    """Move along one of six axes at a time: every round scores all twelve
    steps, takes the best that gains, and halves the steps where none does. A frame ends
    when its steps are at ``least`` or below; a move must raise the score by
    more than 1e-9, so the rounds end."""
    return _search(
        pixels, params, lambda cells, p: cells.refine(p, fine, least), [],
        bond=bond, res=res, width=width, height=height, sub=sub, shape=shape,
    )


def recenter_offset(params: DataFrame, bond: int, clean_x="clean_x", clean_y="clean_y") -> DataFrame:
    """Move the origin to the lattice point nearest the clean-area centre."""
    d = L.with_cell_basis(params, bond)
    dx, dy = F.col(clean_x) - F.col("off_x"), F.col(clean_y) - F.col("off_y")
    n1 = F.floor(F.col("i11") * dx + F.col("i12") * dy + 0.5)
    n2 = F.floor(F.col("i21") * dx + F.col("i22") * dy + 0.5)
    d = d.withColumns({"_n1": n1, "_n2": n2})
    return d.withColumns(
        {
            "off_x": F.col("off_x") + F.col("_n1") * F.col("e1x") + F.col("_n2") * F.col("e2x"),
            "off_y": F.col("off_y") + F.col("_n1") * F.col("e1y") + F.col("_n2") * F.col("e2y"),
        }
    ).select(*params.columns)


# -- hexagons --------------------------------------------------------------------


def sample_hexagons(
    pixels: DataFrame, params: DataFrame, width: int, height: int, sub: int = 2, light: bool = False, even: bool = False
) -> DataFrame:
    """Spread the counts of clean pixels over hexagons at sub x sub points each.

    A hexagon carries the largest mask code of its pixels, or 32 when one of
    its corners is outside the frame. ``even`` scales each hexagon to the mean
    number of points, which evens out moire.
    """
    d = pixels.join(L.with_pixel_basis(params.select("frame_id", *GEOMETRY)), "frame_id")
    pts = F.array(*[
        F.struct(F.lit((a + 0.5) / sub).alias("sx"), F.lit((b + 0.5) / sub).alias("sy"))
        for a in range(sub) for b in range(sub)
    ])
    d = d.select("*", F.inline(pts))
    dx, dy = F.col("x") + F.col("sx") - F.col("off_x"), F.col("y") + F.col("sy") - F.col("off_y")
    d = d.withColumns({"_f1": F.col("i11") * dx + F.col("i12") * dy, "_f2": F.col("i21") * dx + F.col("i22") * dy})
    d = H.with_hex_round(d, "_f1", "_f2")
    ok = F.col("mask").isin(1, 4) if light else F.col("mask") == 1
    geo = ["p1x", "p1y", "p2x", "p2y", "off_x", "off_y", "hel"]
    s = d.groupBy("frame_id", "q", "r").agg(
        F.sum(F.when(ok, F.col("value")).otherwise(0)).alias("_v"), F.count(F.lit(1)).alias("points"),
        F.max("mask").alias("_m"), *[F.first(g).alias(g) for g in geo],
    )
    x, z = F.col("q") - F.shiftright("r", 1), F.col("r")
    outside = F.lit(False)
    third = 1 / 3
    for a, b in ((third, third), (-third, 2 * third), (-2 * third, third), (-third, -third), (third, -2 * third), (2 * third, -third)):
        cx = F.col("off_x") + (x + a) * F.col("p1x") + (z + b) * F.col("p2x")
        cy = F.col("off_y") + (x + a) * F.col("p1y") + (z + b) * F.col("p2y")
        outside = outside | (cx < 0) | (cx > width) | (cy < 0) | (cy > height)
    # area of a hexagon in points
    area = sub * sub * F.abs(F.col("p1x") * F.col("p2y") - F.col("p1y") * F.col("p2x"))
    value = F.col("_v") / (sub * sub)
    if even:
        value = value * area / F.col("points")
    return s.select("frame_id", "q", "r", value.alias("value"), F.when(outside, 32).otherwise(F.col("_m")).alias("mask"), "points")


def footprint_rows(n: int) -> list[tuple[int, int, int]]:
    """(dz, first dx, length) of every row of the home hexagon of radius n."""
    return [(dz, max(-n, -n - dz), min(n - 1, n - 1 - dz) - max(-n, -n - dz) + 1) for dz in range(-n, n)]


def scan_subframes(
    hex_pixels: DataFrame, size: int, bond: int | None = 1, border: int = 2, light: tuple[float, float] | None = None
) -> DataFrame:
    """Centres (frame_id, x, z) on the crystal lattice (anywhere, for ``bond``
    None) whose whole hexagon, with its border, is clean.

    A hexagon is clean if each of its rows lies in one run of clean pixels.
    Every pixel knows the length of its run to the right and votes for the
    centres it starts a row of; a centre with all votes is kept. That is 2n
    votes per pixel instead of 3n^2 look-ups per centre. With ``light`` =
    (low, high) lightly dirty pixels count as clean, and their share of the
    hexagon must be within the bounds.
    """
    n = size // 2 + border
    ok = F.col("mask").isin(1, 4) if light else F.col("mask") == 1
    d = hex_pixels.filter(ok).select(
        "frame_id", (F.col("q") - F.shiftright("r", 1)).alias("x"), F.col("r").alias("z"), (F.col("mask") == 4).cast("int").alias("_l")
    )
    line = W.partitionBy("frame_id", "z")
    d = d.withColumn("_run", F.col("x") - F.row_number().over(line.orderBy("x")))
    run = W.partitionBy("frame_id", "z", "_run")
    d = d.withColumn("_len", F.max("x").over(run) - F.col("x") + 1)
    rows = footprint_rows(n)
    if light:
        ahead = {w: F.sum("_l").over(run.orderBy("x").rangeBetween(0, w - 1)) for w in sorted({r[2] for r in rows})}
        d = d.withColumns({f"_l{w}": c for w, c in ahead.items()})
    votes = F.array(*[
        F.struct(F.lit(dz).alias("dz"), F.lit(x0).alias("x0"), F.lit(w).alias("w"),
                 (F.col(f"_l{w}") if light else F.lit(0)).alias("dirt")) for dz, x0, w in rows
    ])
    v = d.select("frame_id", "x", "z", "_len", F.inline(votes)).filter(F.col("_len") >= F.col("w"))
    c = v.groupBy("frame_id", (F.col("x") - F.col("x0")).alias("x"), (F.col("z") - F.col("dz")).alias("z")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("dirt").alias("_d")
    ).filter(F.col("_n") == len(rows))
    if light:
        share = F.col("_d") / (3 * n * n)
        c = c.filter((share >= light[0]) & (share <= light[1]))
    if bond is not None:
        step = F.lit(3 * bond)
        c = c.filter((F.pmod(2 * F.col("x") + F.col("z"), step) == 0) & (F.pmod(F.col("x") + 2 * F.col("z"), step) == 0))
    return c.select("frame_id", "x", "z")


def best_tiling_offset(candidates: DataFrame, size: int, bond: int) -> DataFrame:
    """Lattice offset (dx, dz) with most centres on its tiling, per frame.

    In lattice units a tiling repeats every size / (2 bond) steps, so the
    offset of a centre is a remainder.
    """
    k = size // (2 * bond)
    i = F.floor((2 * F.col("x") + F.col("z")) / (3 * bond))
    j = F.floor((F.col("x") + 2 * F.col("z")) / (3 * bond))
    n = candidates.groupBy("frame_id", F.pmod(i, F.lit(k)).alias("dx"), F.pmod(j, F.lit(k)).alias("dz")).agg(
        F.count(F.lit(1)).alias("n")
    )
    best = F.max_by(F.struct("dx", "dz", "n"), F.struct("n", -F.col("dx"), -F.col("dz"))).alias("b")
    return n.groupBy("frame_id").agg(best).select("frame_id", "b.dx", "b.dz", "b.n")


def simple_tiling(candidates: DataFrame, size: int, bond: int) -> DataFrame:
    """The centres on the best offset grid."""
    k = size // (2 * bond)
    i = F.floor((2 * F.col("x") + F.col("z")) / (3 * bond))
    j = F.floor((F.col("x") + 2 * F.col("z")) / (3 * bond))
    d = candidates.withColumns({"dx": F.pmod(i, F.lit(k)), "dz": F.pmod(j, F.lit(k))})
    best = best_tiling_offset(candidates, size, bond).drop("n")
    return d.join(best, ["frame_id", "dx", "dz"], "left_semi").select("frame_id", "x", "z")


def conflict_pairs(candidates: DataFrame, size: int) -> DataFrame:
    """Pairs of centres closer than they may be: |dx| + |dy| + |dz| < 2 size.

    Centres are distinct grid points, so a bucket of edge ``size`` holds at
    most size^2 of them. Each centre meets its own bucket and the half plane
    of buckets after it; every pair is found once, as (x, z) < (x2, z2).
    """
    b = candidates.select("frame_id", "x", "z").distinct().withColumns(
        {"_bx": F.floor(F.col("x") / size), "_bz": F.floor(F.col("z") / size)}
    )
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    left = b.select("frame_id", "x", "z", "_bx", "_bz", F.inline(near)).select(
        "frame_id", "x", "z", (F.col("_bx") + F.col("i")).alias("_bx"), (F.col("_bz") + F.col("j")).alias("_bz")
    )
    right = b.select("frame_id", F.col("x").alias("x2"), F.col("z").alias("z2"), "_bx", "_bz")
    p = left.join(right, ["frame_id", "_bx", "_bz"])
    dx, dz = F.col("x") - F.col("x2"), F.col("z") - F.col("z2")
    after = (F.col("x") < F.col("x2")) | ((F.col("x") == F.col("x2")) & (F.col("z") < F.col("z2")))
    p = p.filter(after & (F.abs(dx) + F.abs(dz) + F.abs(dx + dz) < 2 * size))
    return p.select("frame_id", "x", "z", "x2", "z2")


def conflict_counts(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    both = pairs.select("frame_id", "x", "z").unionAll(
        pairs.select("frame_id", F.col("x2").alias("x"), F.col("z2").alias("z"))
    )
    n = both.groupBy("frame_id", "x", "z").agg(F.count(F.lit(1)).alias("conflicts"))
    return candidates.join(n, ["frame_id", "x", "z"], "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))


def greedy_tiling(candidates: DataFrame, size: int, bond: int = 1, simple: bool = True) -> DataFrame:
    """Largest found set of centres that do not overlap.

    Rounds of local minima: a centre is taken when it has the fewest conflicts,
    then the least crowded neighbours, then the largest distance from the
    middle of the frame, among all centres it conflicts with; the latter are
    dropped. Where the plain offset grid holds more centres it is used.
    """
    live = cut_lineage(candidates.select("frame_id", "x", "z").distinct())
    pairs = conflict_pairs(live, size)
    a, b = F.struct("x", "z"), F.struct(F.col("x2").alias("x"), F.col("z2").alias("z"))
    edges = cut_lineage(
        pairs.select("frame_id", a.alias("a"), b.alias("b")).unionAll(pairs.select("frame_id", b.alias("a"), a.alias("b")))
    )
    mid = live.groupBy("frame_id").agg(F.avg("x").alias("_mx"), F.avg("z").alias("_mz"))
    far = live.join(mid, "frame_id").select(
        "frame_id", F.struct("x", "z").alias("a"),
        F.round(F.pow(F.col("x") - F.col("_mx"), 2) + F.pow(F.col("z") - F.col("_mz"), 2)
                + (F.col("x") - F.col("_mx")) * (F.col("z") - F.col("_mz")), 6).alias("_far"),
    )
    far = cut_lineage(far)
    # centres without any conflict are taken at once
    chosen = far.select("frame_id", "a").join(edges, ["frame_id", "a"], "left_anti")
    chosen = cut_lineage(chosen)
    while not edges.isEmpty():
        deg = edges.groupBy("frame_id", "a").agg(F.count(F.lit(1)).alias("_n"))
        crowd = edges.join(deg.select("frame_id", F.col("a").alias("b"), F.col("_n").alias("_nb")), ["frame_id", "b"])
        rank = crowd.groupBy("frame_id", "a").agg(F.count(F.lit(1)).alias("_n"), F.sum("_nb").alias("_c")).join(
            far, ["frame_id", "a"]
        ).select("frame_id", "a", F.struct("_n", "_c", (-F.col("_far")).alias("f"), F.col("a").alias("id")).alias("_rank"))
        rank = cut_lineage(rank)
        other = edges.join(rank.select("frame_id", F.col("a").alias("b"), F.col("_rank").alias("_rb")), ["frame_id", "b"])
        low = other.groupBy("frame_id", "a").agg(F.min("_rb").alias("_low")).join(rank, ["frame_id", "a"])
        now = low.filter(F.col("_rank") < F.col("_low")).select("frame_id", "a")
        now = cut_lineage(now)
        chosen = chosen.unionByName(now)
        # the chosen ones and their neighbours leave
        lost = edges.join(now, ["frame_id", "a"], "left_semi").select("frame_id", F.col("b").alias("a")).unionByName(now).distinct()
        lost = cut_lineage(lost)
        freed = edges.join(lost, ["frame_id", "a"], "left_anti")
        kept = freed.join(lost.withColumnRenamed("a", "b"), ["frame_id", "b"], "left_anti")
        kept = cut_lineage(kept)
        alone = freed.select("frame_id", "a").distinct().join(kept, ["frame_id", "a"], "left_anti")
        chosen = cut_lineage(chosen.unionByName(alone.select("frame_id", "a")))
        edges = kept
    out = chosen.select("frame_id", "a.x", "a.z")
    if not simple:
        return out
    n = out.groupBy("frame_id").agg(F.count(F.lit(1)).alias("_n"))
    grid = best_tiling_offset(live, size, bond).join(n, "frame_id", "left")
    better = cut_lineage(grid.filter(F.col("n") > F.coalesce("_n", F.lit(0))).select("frame_id"))
    plain = simple_tiling(live, size, bond).join(better, "frame_id", "left_semi")
    return out.join(better, "frame_id", "left_anti").unionByName(plain)


def extract_subframes(hex_pixels: DataFrame, centers: DataFrame, size: int) -> DataFrame:
    """Cut the hexagon around each centre (frame_id, x, z) into its own rows:
    (frame_id, cx, cz, x, z, hp, value), x and z relative to the centre."""
    n = size // 2
    f = centers.select("frame_id", F.col("x").alias("cx"), F.col("z").alias("cz"), F.explode(F.sequence(F.lit(-n), F.lit(n - 1))).alias("_dz"))
    lo, hi = F.greatest(F.lit(-n), -n - F.col("_dz")), F.least(F.lit(n - 1), n - 1 - F.col("_dz"))
    f = f.select("*", F.explode(F.sequence(lo, hi)).alias("_dx"))
    f = f.select("frame_id", "cx", "cz", "_dx", "_dz", (F.col("cx") + F.col("_dx")).alias("x"), (F.col("cz") + F.col("_dz")).alias("z"))
    h = hex_pixels.select("frame_id", (F.col("q") - F.shiftright("r", 1)).alias("x"), F.col("r").alias("z"), "value")
    return f.join(h, ["frame_id", "x", "z"]).select(
        "frame_id", "cx", "cz", F.col("_dx").cast("long").alias("x"), F.col("_dz").cast("long").alias("z"),
        H.hex_index(F.col("_dx").cast("long"), F.col("_dz").cast("long"), n).alias("hp"), "value",
    )


def collect_subframes(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """One stack of all sub-frames (one row each), numbered from 1 in frame
    order."""
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return number_rows(d, order, "slice", start=1)
