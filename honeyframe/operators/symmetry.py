"""Symmetry copies, alignment and matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from honeyframe.functions import hexgrid as H
from honeyframe.operators.pixels import offsets_within
from honeyframe.session import bounded, ship, spread

# Pixels of the frames that a task looks at side by side.
BLOCK = 1 << 14


def expand_orbit(
    df: DataFrame, n: int, bond: int, keys: list[str] = ("sf_id",), carry: list[str] = ("value",),
    inverse: bool = False,
) -> DataFrame:
    """Every frame under the 12 (n/bond)^2 copies: (keys, sym, hp, carry).

    The copies are a constant array and the new position is computed, so the
    expansion is narrow: no join, no shuffle.
    """
    d = df.select(*keys, "x", "z", *carry, F.inline(H.symmetry_array(n, bond)))
    move = H.with_inverse_transform if inverse else H.with_transform
    d = move(d, n)
    return d.select(*keys, "sym", H.hex_index("tx", "tz", n).alias("hp"), *carry)


def orbit_median(orbit: DataFrame, keys: list[str] = ("sf_id",), subtract: DataFrame | None = None) -> DataFrame:
    """Lower median of the copies at every position; with ``subtract`` (keys,
    hp, value) also the shifted difference, offset 32768."""
    m = orbit.groupBy(*keys, "hp").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").cast("long").alias("median")
    )
    if subtract is None:
        return m
    d = subtract.select(*keys, "hp", "value").join(m, [*keys, "hp"])
    return d.withColumn("difference", F.col("value") + 32768 - F.col("median"))


def _zscore(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Standard score within a frame of bounded size."""
    w = W.partitionBy(*keys)
    std = F.stddev_pop(value).over(w)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.nullif(std, F.lit(0.0)))


def kernel_of(lattice: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """Standard score of one image (hp, value), less that of a background,
    scored again: (hp, k)."""

    def score(df, out):
        s = df.groupBy().agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
        m, sd = (s.select(c).scalar() for c in ("_m", "_s"))
        return df.select("hp", ((F.col("value") - m) / F.nullif(sd, F.lit(0.0))).alias(out))

    k = score(lattice, "k")
    if background is None:
        return k
    d = k.join(score(background, "_b"), "hp").select("hp", (F.col("k") - F.col("_b")).alias("value"))
    return score(d, "k")


def allowed_transforms(radius: int, rotate: bool, mirror: bool) -> Column:
    """Shifts up to a ring distance, with rotations and mirror if allowed, as a
    constant array (t, lx, lz, rot, mirror)."""
    ops = [
        (lx, lz, rot, mir)
        for mir in ((0, 1) if mirror else (0,))
        for rot in (range(6) if rotate else (0,))
        for lx, lz in offsets_within(radius)
    ]
    names = ("lx", "lz", "rot", "mirror")
    return F.array(
        *[F.struct(F.lit(t).alias("t"), *[F.lit(v).alias(k) for k, v in zip(names, op)]) for t, op in enumerate(ops)]
    )


def match_transforms(
    frames: DataFrame, kernel: DataFrame, n: int, radius: int = 0, rotate: bool = True, mirror: bool = True,
    key: str = "frame_id",
) -> DataFrame:
    """Correlation of every frame with the kernel for every allowed transform."""
    z = _zscore(frames.select(key, "x", "z", "value"), [key], "value", "_z")
    d = z.select(key, "x", "z", "_z", F.inline(allowed_transforms(radius, rotate, mirror)))
    d = H.with_inverse_transform(d, n)
    d = d.select(key, "t", "lx", "lz", "rot", "mirror", "_z", H.hex_index("tx", "tz", n).alias("hp"))
    return d.join(bounded(kernel), "hp").groupBy(key, "t", "lx", "lz", "rot", "mirror").agg(
        F.avg(F.col("k") * F.coalesce("_z", F.lit(0.0))).alias("match")
    )


def best_transforms(scores: DataFrame, key: str = "frame_id") -> DataFrame:
    """Best transform per frame, with the match of the runner-up."""
    w = W.partitionBy(key).orderBy(F.round("match", 9).desc(), "t")
    top = scores.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= 2)
    first = F.col("_k") == 1
    return top.groupBy(key).agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in ("t", "lx", "lz", "rot", "mirror", "match")],
        F.max(F.when(~first, F.col("match"))).alias("second"),
    )


def move_frames(frames: DataFrame, best: DataFrame, n: int, key: str = "frame_id", carry: list[str] = ("value",)) -> DataFrame:
    """Apply the chosen transforms to frames or to any mapped stack: the pixel
    at T(p) goes to p."""
    d = frames.select(key, "x", "z", *carry).join(best.select(key, "lx", "lz", "rot", "mirror"), key)
    d = H.with_inverse_transform(d, n)
    return d.select(key, F.col("tx").alias("x"), F.col("tz").alias("z"), H.hex_index("tx", "tz", n).alias("hp"), *carry)


def align_frames(
    frames: DataFrame, lattice: DataFrame, n: int, background: DataFrame | None = None, radius: int = 0,
    rotate: bool = True, mirror: bool = True, stacks: tuple[DataFrame, ...] = (), key: str = "frame_id",
) -> tuple[DataFrame, list[DataFrame]]:
    """Find the best transform of every frame and move it and its stacks.

    Returns the matches and the moved tables, frames first.
    """
    scores = match_transforms(frames, kernel_of(lattice, background), n, radius, rotate, mirror, key)
    best = best_transforms(scores, key)
    return best, [move_frames(s, best, n, key) for s in (frames, *stacks)]


def molecule_match(
    diff: DataFrame, molecules: DataFrame, key: str = "frame_id", mol: str = "mol", same: str | None = None,
    exponent: float = 1.0,
) -> DataFrame:
    """Match of each difference image (key, hp, value) with the molecules
    (mol, hp, value): best, second and worst correlation, the sum of the
    positive ones and (n / sum)^exponent.

    The molecules are a short list (an orbit or a set of models). With ``same``
    both sides carry that column and only equal ones are compared.
    """
    on = ["hp"] + ([same] if same else [])
    d = diff.select(key, *on, F.col("value").alias("_a"))
    m = molecules.select(mol, *on, F.col("value").alias("_b"))
    pair = d.join(bounded(m), on).groupBy(key, mol).agg(
        F.covar_pop("_a", "_b").alias("_c"), F.stddev_pop("_a").alias("_sa"), F.stddev_pop("_b").alias("_sb")
    )
    norm = F.col("_sa") * F.col("_sb")
    pair = pair.select(key, mol, F.when(norm > 1e-12, F.col("_c") / norm).otherwise(0.0).alias("corr"))
    w = W.partitionBy(key).orderBy(F.round("corr", 9).desc(), mol)
    pair = pair.withColumn("_k", F.row_number().over(w))
    pos = F.sum(F.when(F.col("corr") > 0, F.col("corr")).otherwise(0.0))
    return pair.groupBy(key).agg(
        F.max(F.when(F.col("_k") == 1, F.col(mol))).alias("best"),
        F.max("corr").alias("best_match"), F.max(F.when(F.col("_k") == 2, F.col("corr"))).alias("second_match"),
        F.min("corr").alias("worst_match"), pos.alias("summed"),
        F.pow(F.count(F.lit(1)) / F.nullif(pos, F.lit(0.0)), exponent).alias("inv_avg"),
    )


def model_symmetry_factor(models: DataFrame, n: int, bond: int, exponent: float = 1.0) -> DataFrame:
    """Scaling factor of each model (m, x, z, hp, level) from the match with
    its own copies: 1 for a fully symmetric model, larger without symmetry."""
    d = models.withColumn("value", F.col("level").cast("double"))
    orbit = expand_orbit(d, n, bond, keys=["m"])
    a = d.select("m", "hp", F.col("value").alias("_a"))
    pair = orbit.join(a, ["m", "hp"]).groupBy("m", "sym").agg(
        F.covar_pop("_a", "value").alias("_c"), F.stddev_pop("_a").alias("_sa"), F.stddev_pop("value").alias("_sb")
    )
    norm = F.col("_sa") * F.col("_sb")
    corr = F.when(norm > 1e-12, F.col("_c") / norm).otherwise(0.0)
    pos = F.sum(F.when(corr > 0, corr).otherwise(0.0))
    return pair.groupBy("m").agg(
        pos.alias("summed"), F.pow(F.count(F.lit(1)) / F.nullif(pos, F.lit(0.0)), exponent).alias("factor")
    )


def target_cell(cells: DataFrame, report: DataFrame, position: list[str] = ("hp",), min_contrast: float = 0.0) -> DataFrame:
    """Mean unit cell of the good frames, weighted by (hex_merit / 100)^2."""
    good = report.filter((F.col("hex_merit") > 0) & (F.col("contrast") > min_contrast))
    w = good.select("frame_id", F.pow(F.col("hex_merit") / 100, 2).alias("_w"))
    return cells.join(w, "frame_id").groupBy(*position).agg(
        F.round(F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).cast("long").alias("value")
    )


def cell_shifts(n: int) -> Column:
    """All shifts of the cell of radius n as a constant array."""
    pts = [
        (x, z) for x in range(-n, n) for z in range(-n, n) if -n <= x + z < n
    ]
    return F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(z).alias("dz")) for x, z in pts])


def best_shift(cells: DataFrame, target: DataFrame, n: int, key: str = "frame_id") -> DataFrame:
    """Correlation of each cell with the periodic target for every shift; the
    best one, and its square (or minus the root of a negative one)."""
    d = cells.select(key, "x", "z", "value", F.inline(cell_shifts(n)))
    d = d.withColumns({"x": F.col("x") - F.col("dx"), "z": F.col("z") - F.col("dz"), "y": F.lit(0)})
    d = H.with_wrap(d, n).withColumn("hp", H.hex_index("x", "z", n))
    t = target.select("hp", F.col("value").cast("double").alias("_t"))
    s = d.join(bounded(t), "hp").groupBy(key, "dx", "dz").agg(
        F.covar_pop("value", "_t").alias("_c"), F.stddev_pop("value").alias("_sv"), F.stddev_pop("_t").alias("_st")
    )
    norm = F.col("_sv") * F.col("_st")
    corr = F.when(norm > 1e-12, F.col("_c") / norm).otherwise(0.0)
    s = s.select(key, "dx", "dz", corr.alias("corr"))
    best = F.max(F.struct(F.round("corr", 9).alias("r"), (-F.col("dx")).alias("nx"), (-F.col("dz")).alias("nz"), "corr")).alias("b")
    c = F.col("b.corr")
    return s.groupBy(key).agg(best).select(
        key, (-F.col("b.nx")).alias("dx"), (-F.col("b.nz")).alias("dz"), c.alias("match"),
        F.when(c >= 0, c * c).otherwise(-F.sqrt(-c)).alias("score"),
    )


def hex_shape(cells: DataFrame, n: int, key: str = "frame_id", mirror: bool = True, target: DataFrame | None = None) -> DataFrame:
    """Shape quality of a summed cell of radius n, best over all shifts:
    moment * correlation with the symmetrised cell * (1 + least correlation of
    its copies) / 2. With a target (hp, value) the shift that fits it best is
    taken instead.

    Rows are spread by the frame once; a frame becomes a row with the list of its pixels,
    and a task takes blocks of frames through the shifts and copies, which are orders of
    the pixels of the home hexagon.
    """
    ship(cells.sparkSession)
    z = _zscore(spread(cells.select(key, "x", "z", "value"), key), [key], "value", "_v")
    lists = z.groupBy(key).agg(F.collect_list(F.struct("x", "z", "_v")).alias("_px"))  # one frame
    home = H.home_places(n)
    at = {p: k for k, p in enumerate(home)}
    px, pz = np.array(home).T
    ops = H.operation_table()[: 12 if mirror else 6]
    copies = [np.array([at[p] for p in zip(*H.fold(ia * px + ib * pz, ic * px + id_ * pz, n))]) for *_, ia, ib, ic, id_ in ops]
    far, pts = px * px + pz * pz + px * pz, len(home)
    asked = None
    if target is not None:  # one cell
        asked = np.full(pts, np.nan)
        for r in target.select("hp", F.col("value").cast("double").alias("t")).collect():
            asked[r["hp"]] = np.nan if r["t"] is None else r["t"]

    def shapes(x, zz, v, row, count):
        """Best (dx, dz, shape, moment) of frames whose pixels come as flat arrays."""
        x, zz = H.fold(x, zz, n)
        grid = np.full((2 * n, 2 * n), -1)
        grid[px + n, pz + n] = np.arange(pts)
        place = row * pts + grid[x + n, zz + n]
        ok = ~np.isnan(v)
        # a pixel that comes twice counts by its largest value, and by its mean in the mean copy
        top = np.full(count * pts, -np.inf)
        np.maximum.at(top, place[ok], v[ok])
        times = np.bincount(place[ok], minlength=count * pts).reshape(count, pts).astype(float)
        total = np.bincount(place[ok], weights=v[ok], minlength=count * pts).reshape(count, pts)
        top = np.where(times > 0, top.reshape(count, pts), 0.0)
        known = (times > 0).astype(float)
        inside = np.ones(pts) if asked is None else (~np.isnan(asked)).astype(float)
        best = [np.full(count, np.nan) for _ in range(5)]
        for k, (dx, dz) in enumerate(home):
            moved = np.array([at[p] for p in zip(*H.fold(px + dx, pz + dz, n))])
            v0, has, s, c = (a[:, moved] for a in (top, known, total, times))
            mine, here = v0 * inside, has * inside
            mean, often, least = np.zeros_like(v0), np.zeros_like(v0), np.full(count, np.nan)
            for q in copies:
                mean, often = mean + s[:, q], often + c[:, q]
                pair = (v0[:, q] * mine).sum(axis=1) / pts
                least = np.fmin(least, np.where((has[:, q] * here).any(axis=1), pair, np.nan))
            mean = np.where(often > 0, mean / often, 0.0)
            any_ = here.any(axis=1)
            moment = np.where(any_, (mine * far).sum(axis=1) * (10 / (pts * n * n)), np.nan)
            std = np.sqrt((mean * mean * inside).sum(axis=1) / pts)
            shape = moment * ((mean * mine).sum(axis=1) / pts) / np.where(std == 0, np.nan, std) * (1 + least) / 2
            rank = shape if asked is None else np.where(any_, (np.nan_to_num(asked) * mine).sum(axis=1) / pts, np.nan)
            rank = np.round(rank, 9)
            better = np.ones(count, bool) if k == 0 else (rank > best[0]) | (np.isnan(best[0]) & ~np.isnan(rank))
            for old, new in zip(best, (rank, dx, dz, shape, moment)):
                old[better] = np.broadcast_to(new, count)[better]
        return best[1:]

    def rows(batches):
        step = max(1, BLOCK // pts)
        for whole in batches:
            for lo in range(0, len(whole), step):
                batch = whole.slice(lo, step)
                sizes = pc.list_value_length(batch["_px"]).to_numpy(zero_copy_only=False)
                items = batch["_px"].flatten()
                x, zz, v = (items.field(c).to_numpy(zero_copy_only=False) for c in ("x", "z", "_v"))
                with np.errstate(all="ignore"):
                    dx, dz, shape, moment = shapes(x, zz, v.astype(float), np.repeat(np.arange(len(batch)), sizes), len(batch))
                yield pa.RecordBatch.from_arrays([
                    batch[key], pa.array(dx.astype(np.int32)), pa.array(dz.astype(np.int32)),
                    pa.array(shape, from_pandas=True), pa.array(moment, from_pandas=True)], names=out.names)

    out = T.StructType([z.schema[key], T.StructField("dx", T.IntegerType()), T.StructField("dz", T.IntegerType()),
                        T.StructField("hex_shape", T.DoubleType()), T.StructField("moment2", T.DoubleType())])
    return lists.mapInArrow(rows, out)
