"""Atoms in frames: rendering, peaks, search and refinement.

``pixels`` are (frame_id, x, y, value), ``atoms`` (frame_id, atom_id, x, y,
weight) with whole pixel places, a kernel is a list of (dx, dy, k).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from honeyframe.operators.nudge import Moves
from honeyframe.operators.statistics import pearson
from honeyframe.session import apart, cut_lineage, ship, spread

Kernel = list[tuple[int, int, float]]

# Pixels of the frames whose atoms a task moves side by side.
BLOCK = 1 << 14


def gaussian_kernel(fwhm: float, radius: int) -> Kernel:
    """Gaussian of a full width at half maximum, peak 1, on a square."""
    s = fwhm / 2.35482
    return [
        (dx, dy, math.exp(-(dx * dx + dy * dy) / (2 * s * s)))
        for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)
    ]


def kernel_column(kernel: Kernel) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(float(k)).alias("k")) for a, b, k in kernel])


def _spread(atoms: DataFrame, kernel: Kernel, width: int, height: int, periodic: bool, carry: list[str]) -> DataFrame:
    """Kernel cells of every atom: (frame_id, carry, x, y, k)."""
    d = atoms.select("frame_id", "x", "y", *carry, F.inline(kernel_column(kernel)))
    x, y = F.col("x") + F.col("dx"), F.col("y") + F.col("dy")
    if periodic:
        return d.select("frame_id", *carry, F.pmod(x, F.lit(width)).alias("x"), F.pmod(y, F.lit(height)).alias("y"), "k")
    d = d.select("frame_id", *carry, x.alias("x"), y.alias("y"), "k")
    return d.filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def render_atoms(pixels: DataFrame, atoms: DataFrame, kernel: Kernel, width: int, height: int, floor: Column | float = 0.0, periodic: bool = False) -> DataFrame:
    """Image of the atoms over a floor, on the pixels of the frames:
    (frame_id, x, y, model)."""
    s = _spread(atoms, kernel, width, height, periodic, ["weight"])
    s = s.select("frame_id", "x", "y", (F.col("weight") * F.col("k")).alias("_m"))
    base = pixels.select("frame_id", "x", "y", (F.lit(floor) if isinstance(floor, float) else floor).cast("double").alias("_m"))
    return base.unionByName(s).groupBy("frame_id", "x", "y").agg(F.sum("_m").alias("model"))


def residual_peaks(residual: DataFrame, visited: DataFrame | None = None, absolute: bool = True) -> DataFrame:
    """Largest (absolute) residual of each frame that was not visited yet."""
    d = residual if visited is None else residual.join(visited.select("frame_id", "x", "y"), ["frame_id", "x", "y"], "left_anti")
    size = F.abs("value") if absolute else F.col("value")
    best = F.max_by(F.struct("x", "y", "value"), F.struct(F.round(size, 9), -F.col("y"), -F.col("x"))).alias("b")
    return d.groupBy("frame_id").agg(best).select("frame_id", "b.x", "b.y", "b.value")


def _fit(spots: DataFrame, residual: DataFrame, kernel: Kernel, width: int, height: int, keys: list[str]) -> DataFrame:
    """Weight of one atom at each spot (keys, frame_id, x, y) and the fall of
    the squared residual it brings.

    The weight is the mean of k r over the cells above a quarter of the peak,
    in units of the kernel.
    """
    top = max(k for _, _, k in kernel)
    core = [k for _, _, k in kernel if k > top / 4]
    cells = _spread(spots, kernel, width, height, False, keys)
    d = apart(cells).join(residual.select("frame_id", "x", "y", F.col("value").alias("_r")), ["frame_id", "x", "y"])
    in_core = F.col("k") > top / 4
    s = d.groupBy("frame_id", *keys).agg(
        F.sum(F.when(in_core, F.col("k") * F.col("_r"))).alias("_kr"),
        F.sum(F.when(in_core, F.col("k"))).alias("_kc"),
        F.sum(F.col("k") * F.col("_r")).alias("_all"), F.sum(F.col("k") * F.col("k")).alias("_kk"),
    )
    weight = F.col("_kr") / F.nullif(F.lit(top) * F.col("_kc"), F.lit(0.0))
    s = s.withColumn("weight", F.coalesce(weight, F.lit(0.0)))
    w = F.col("weight")
    # sum of r^2 - (r - w k)^2
    return s.select("frame_id", *keys, "weight", (2 * w * F.col("_all") - w * w * F.col("_kk")).alias("gain"))


def find_atoms(
    pixels: DataFrame, kernel: Kernel, diameter: int, width: int, height: int, floor: float = 0.0, min_weight: float = 0.0,
    positive: bool = True, limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Place atoms on residual maxima until nothing gains.

    Each round takes all pixels that are the largest residual within one
    diameter; such peaks are at least a diameter apart, so they are weighed in
    one job. A peak is refused, and not visited again, when its weight is below
    the least, has the other sign, or does not lower the squared residual. The
    places around an accepted atom are closed within the solid diameter.
    ``limit`` keeps the strongest atoms of a frame where it is given. Every peak
    is closed, so the rounds end. Returns atoms and the residual.
    """
    res = cut_lineage(pixels.select("frame_id", "x", "y", (F.col("value") - floor).cast("double").alias("value"), F.lit(True).alias("open")))
    atoms = None
    while True:
        size = F.col("value") if positive else F.abs("value")
        rank = F.when(F.col("open") & (size > 0), F.struct(F.round(size, 9).alias("s"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx")))
        d = res.withColumn("_k", rank)
        wx = W.partitionBy("frame_id", "y").orderBy("x").rangeBetween(-diameter, diameter)
        wy = W.partitionBy("frame_id", "x").orderBy("y").rangeBetween(-diameter, diameter)
        d = d.withColumn("_m", F.max("_k").over(wx)).withColumn("_m", F.max("_m").over(wy))
        peaks = cut_lineage(d.filter(F.col("_k") == F.col("_m")).select("frame_id", "x", "y", F.col("x").alias("px"), F.col("y").alias("py")))
        if peaks.isEmpty():
            break
        fit = _fit(peaks, res, kernel, width, height, ["px", "py"])
        good = (F.col("gain") > 1e-9) & (F.col("weight") > min_weight if positive else F.abs("weight") > min_weight)
        new = fit.filter(good).select("frame_id", F.col("px").alias("x"), F.col("py").alias("y"), "weight")
        if limit is None:
            pass
        elif atoms is not None:
            # never more than the limit of a frame; the strongest go first
            have = atoms.groupBy("frame_id").agg(F.count(F.lit(1)).alias("_h"))
            new = new.join(have, "frame_id", "left")
        else:
            new = new.withColumn("_h", F.lit(0))
        if limit is not None:
            place = F.row_number().over(W.partitionBy("frame_id").orderBy(F.round("weight", 9).desc(), "y", "x"))
            new = new.withColumn("_p", place).filter(F.col("_p") + F.coalesce("_h", F.lit(0)) <= limit).select("frame_id", "x", "y", "weight")
        # gains were weighed one by one; overlapping kernels may undo them
        new = cut_lineage(new)
        draw = _spread(new, kernel, width, height, False, ["weight"]).select("frame_id", "x", "y", (-F.col("weight") * F.col("k")).alias("_d"))
        shut = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(-diameter, diameter + 1) for b in range(-diameter, diameter + 1) if a * a + b * b < diameter * diameter])
        closed = new.select("frame_id", "x", "y", F.inline(shut)).select("frame_id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
        closed = closed.unionByName(peaks.select("frame_id", "x", "y"))
        upd = draw.withColumn("_c", F.lit(0)).unionByName(closed.withColumns({"_d": F.lit(0.0), "_c": F.lit(1)}))
        upd = upd.groupBy("frame_id", "x", "y").agg(F.sum("_d").alias("_d"), F.max("_c").alias("_c"))
        res2 = res.join(apart(upd), ["frame_id", "x", "y"], "left").select(
            "frame_id", "x", "y", (F.col("value") + F.coalesce("_d", F.lit(0.0))).alias("value"),
            (F.col("open") & (F.coalesce("_c", F.lit(0)) == 0)).alias("open"),
        )
        res2 = cut_lineage(res2)
        # frames whose joint change does not lower the residual keep the old state
        sq = F.sum(F.col("value") * F.col("value"))
        worse = apart(res2.groupBy("frame_id").agg(sq.alias("_n"))).join(res.groupBy("frame_id").agg(sq.alias("_o")), "frame_id").filter(F.col("_n") > F.col("_o")).select("frame_id")
        worse = cut_lineage(worse)
        kept = res.join(apart(worse), "frame_id", "left_semi").join(
            apart(peaks.select("frame_id", "x", "y", F.lit(True).alias("_s"))), ["frame_id", "x", "y"], "left"
        ).select("frame_id", "x", "y", "value", (F.col("open") & F.col("_s").isNull()).alias("open"))
        res = cut_lineage(res2.join(apart(worse), "frame_id", "left_anti").unionByName(kept))
        new = new.join(apart(worse), "frame_id", "left_anti")
        atoms = cut_lineage(new if atoms is None else atoms.unionByName(new))
    if atoms is None:
        atoms = pixels.select("frame_id", "x", "y", F.lit(0.0).alias("weight")).limit(0)
    return atoms, res.drop("open")


def nudge_atoms(
    atoms: DataFrame, residual: DataFrame, kernel: Kernel, wobble: int, diameter: int, width: int, height: int,
    least_gain: float = 1e-9,
) -> tuple[DataFrame, DataFrame]:
    """Try all places within ``wobble`` of each atom (frame_id, x, y, weight)
    with a new weight and keep the best; colliding atoms merge.

    Of atoms that could disturb each other only the one with the largest gain
    moves in a round, so the residual falls; the rounds of a frame end when no move lowers
    the squared residual by more than ``least_gain``. Frames are independent, so each is
    one row with the lists of its pixels and atoms, and runs through its rounds in a task.
    """
    ship(atoms.sparkSession)
    moves = Moves(kernel, wobble, width, height, least_gain)
    types = {f.name: f.dataType for f in atoms.schema.fields}
    spot = [T.StructField(c, types[c]) for c in ("x", "y")]
    out = T.StructType([
        T.StructField("frame_id", types["frame_id"]),
        T.StructField("_a", T.ArrayType(T.StructType([*spot, T.StructField("weight", T.DoubleType())]))),
        T.StructField("_d", T.ArrayType(T.StructType([*spot, T.StructField("_d", T.DoubleType())]))),
    ])

    def flat(column, names):
        """Row numbers and fields of a column of lists."""
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        items = column.flatten()
        return np.repeat(np.arange(len(n)), n), *(items.field(c).to_numpy(zero_copy_only=False) for c in names)

    def lists(found, count, field):
        """Arrays (row, x, y, value) as a column of lists."""
        f, x, y, v = found
        order = np.argsort(f, kind="stable")
        kind = to_arrow_type(out[field].dataType)
        inner = kind.value_type
        items = pa.StructArray.from_arrays(
            [pa.array(c[order]).cast(g.type) for c, g in zip((x, y, v), inner)], fields=list(inner))
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(f, minlength=count))]).astype(np.int32), items, type=kind)

    def rows(batches):
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(whole["_p"]), 0).to_numpy(zero_copy_only=False))
            block = sizes // BLOCK if len(sizes) else sizes
            for lo, hi in zip(*(np.searchsorted(block, np.unique(block), side) for side in ("left", "right"))):
                batch = whole.slice(lo, hi - lo)
                f, x, y, v = flat(batch["_p"], ("x", "y", "value"))
                g, ax, ay, w = flat(batch["_a"], ("x", "y", "weight"))
                done, added = moves.run(len(batch), (f, x, y, v.astype(float)), (g, ax, ay, w.astype(float)))
                yield pa.RecordBatch.from_arrays([batch["frame_id"], lists(done, len(batch), "_a"), lists(added, len(batch), "_d")], names=out.names)

    a = atoms.groupBy("frame_id").agg(F.collect_list(F.struct("x", "y", F.col("weight").cast("double").alias("weight"))).alias("_a"))  # one frame
    p = residual.groupBy("frame_id").agg(F.collect_list(F.struct("x", "y", F.col("value").cast("double").alias("value"))).alias("_p"))
    done = cut_lineage(spread(a.join(apart(p), "frame_id", "left"), "frame_id").mapInArrow(rows, out))
    drawn = done.select("frame_id", F.inline("_d"))
    res = residual.join(apart(drawn), ["frame_id", "x", "y"], "left").select("frame_id", "x", "y", (F.col("value") + F.coalesce("_d", F.lit(0.0))).alias("value"))
    return done.select("frame_id", F.inline("_a")), res


def merge_close_atoms(atoms: DataFrame, diameter: int) -> DataFrame:
    """Of atoms nearer than the solid diameter the stronger stays and takes the
    mean intensity of itself and the atoms that it takes over, each weighted by
    its own; ties go to the upper left one. An atom goes to its strongest
    neighbour."""
    cell = {"_cx": F.floor(F.col("x") / diameter), "_cy": F.floor(F.col("y") / diameter)}
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = atoms.select("frame_id", "x", "y", "weight").withColumns(cell)
    left = a.select("frame_id", "x", "y", "weight", "_cx", "_cy", F.inline(near)).select("frame_id", "x", "y", "weight", (F.col("_cx") + F.col("i")).alias("_cx"), (F.col("_cy") + F.col("j")).alias("_cy"))
    right = a.select("frame_id", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("weight").alias("w2"), "_cx", "_cy")
    p = left.join(right, ["frame_id", "_cx", "_cy"])
    d2 = F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)
    rank = F.struct(F.abs("weight"), -F.col("y"), -F.col("x"))
    rank2 = F.struct(F.abs("w2").alias("w"), -F.col("y2"), -F.col("x2"))
    lose = p.filter((d2 < diameter * diameter) & (d2 > 0)).filter(rank < rank2)
    lose = cut_lineage(lose.groupBy("frame_id", "x", "y").agg(F.first("weight").alias("w"), F.max_by(F.struct("x2", "y2"), rank2).alias("_to")))
    stay = atoms.join(lose.select("frame_id", "x", "y"), ["frame_id", "x", "y"], "left_anti")
    size = F.abs("w")
    taken = lose.groupBy("frame_id", F.col("_to.x2").alias("x"), F.col("_to.y2").alias("y")).agg(F.sum(size * F.col("w")).alias("_ww"), F.sum(size).alias("_w"))
    own = F.abs("weight")
    joint = (own * F.col("weight") + F.coalesce("_ww", F.lit(0.0))) / F.nullif(own + F.coalesce("_w", F.lit(0.0)), F.lit(0.0))
    return stay.join(taken, ["frame_id", "x", "y"], "left").withColumn("weight", F.coalesce(joint, "weight")).select(*atoms.columns)


def sweep_kernel(pixels: DataFrame, atoms: DataFrame, widths: list[float], radius: int, width: int, height: int, scales: list[float]) -> DataFrame:
    """Best kernel width by correlation with the image, then the best
    brightness by the variance of the residual: (frame_id, fwhm, corr, scale,
    variance)."""
    top = None
    for w in widths:
        m = render_atoms(pixels, atoms, gaussian_kernel(w, radius), width, height)
        d = pixels.join(m, ["frame_id", "x", "y"]).select("frame_id", "x", "y", "value", "model", F.lit(float(w)).alias("fwhm"))
        top = d if top is None else top.unionByName(d)
    c = pearson(top, ["frame_id", "fwhm"], "value", "model").drop("n")
    best = c.groupBy("frame_id").agg(F.max(F.struct(F.round("corr", 9).alias("r"), (-F.col("fwhm")).alias("nf"), "corr")).alias("b"))
    best = best.select("frame_id", (-F.col("b.nf")).alias("fwhm"), "b.corr")
    d = top.join(best, ["frame_id", "fwhm"]).select("frame_id", "fwhm", "corr", "value", "model", F.explode(F.array(*[F.lit(float(s)) for s in scales])).alias("scale"))
    v = d.groupBy("frame_id", "fwhm", "corr", "scale").agg(F.var_pop(F.col("value") - F.col("scale") * F.col("model")).alias("variance"))
    pick = F.min(F.struct(F.round("variance", 9).alias("r"), "scale", "variance")).alias("b")
    return v.groupBy("frame_id", "fwhm", "corr").agg(pick).select("frame_id", "fwhm", "corr", "b.scale", "b.variance")
