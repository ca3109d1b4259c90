"""Operators on square and hexagonal pixel tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from honeyframe.functions import hexgrid as H, lattice as L
from honeyframe.functions.numbers import col
from honeyframe.session import apart, cut_lineage, ship, spread

# -- sparse form -------------------------------------------------------------


def sparse_encode(sf: DataFrame) -> DataFrame:
    """Per sub-frame and non-zero value its count and sorted positions. The
    list is bounded by the pixels of one sub-frame. A sub-frame without counts
    has one row of value 0, count 0 and no positions."""
    hp = F.when(F.col("value") > 0, F.col("hp"))
    d = sf.groupBy("sf_id", F.greatest("value", F.lit(0)).alias("value")).agg(
        F.count(hp).alias("n"), F.sort_array(F.collect_list(hp)).alias("positions")
    )
    most = F.max("value").over(W.partitionBy("sf_id"))  # one row for each value of a sub-frame
    return d.withColumn("_most", most).filter((F.col("value") > 0) | (F.col("_most") <= 0)).drop("_most")


def sparse_decode(enc: DataFrame, n: int, allow_empty: bool = False) -> DataFrame:
    """All pixels of every encoded sub-frame, zeros filled in. A sub-frame that
    sums to zero is an error unless it is allowed.

    Every sub-frame brings its own list of 3 n^2 positions; the encoded ones
    are added to it by one aggregate, so no join is needed.
    """
    if not allow_empty:
        message = F.concat(F.lit("sub-frame sums to zero: "), F.col("sf_id").cast("string"))
        enc = enc.withColumn("sf_id", F.when(F.col("value") > 0, F.col("sf_id")).otherwise(F.raise_error(message)))
    flat = enc.select("sf_id", F.explode("positions").alias("hp"), "value")
    zero = enc.select("sf_id").distinct().select(
        "sf_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3 * n * n - 1).cast("long"))).alias("hp"),
        F.lit(0).cast("long").alias("value"),
    )
    return (
        flat.select("sf_id", F.col("hp").cast("long"), F.col("value").cast("long"))
        .unionByName(zero).groupBy("sf_id", "hp").agg(F.max("value").alias("value"))
    )


def require_counts(sf: DataFrame) -> DataFrame:
    """Fail on a sub-frame without any count."""
    bad = sf.groupBy("sf_id").agg(F.sum("value").alias("s")).filter(F.col("s") == 0)
    if not bad.isEmpty():
        raise ValueError("there are sub-frames that sum to zero")
    return sf


def drop_empty_subframes(sf: DataFrame) -> DataFrame:
    full = sf.groupBy("sf_id").agg(F.sum("value").alias("_s")).filter(F.col("_s") != 0)
    return sf.join(full.select("sf_id"), "sf_id", "left_semi")


def count_empty_subframes(sf: DataFrame) -> DataFrame:
    s = sf.groupBy("sf_id").agg(F.sum("value").alias("_s"))
    return s.agg(
        F.count_if(F.col("_s") == 0).alias("empty"), F.count(F.lit(1)).alias("total")
    )


# -- neighbours --------------------------------------------------------------


def offsets_within(radius: int) -> list[tuple[int, int]]:
    """Cube steps (x, z) of all pixels up to a ring distance, centre first."""
    pts = [
        (dx, dz)
        for dx in range(-radius, radius + 1)
        for dz in range(max(-radius, -radius - dx), min(radius, radius - dx) + 1)
    ]
    return sorted(pts, key=lambda p: (p != (0, 0), p))


def _steps(offsets: list[tuple[int, int]]) -> Column:
    return F.array(
        *[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dz")) for a, b in offsets]
    )


def neighbor_join(
    df: DataFrame, n: int, offsets: list[tuple[int, int]], periodic: bool = True,
    keys: list[str] = ("frame_id",), carry: list[str] = ("value",),
) -> DataFrame:
    """Send every pixel to its neighbours on the home hexagon of radius n.

    Gives (keys, x, z, dx, dz, carry): the row says that the pixel at (x, z)
    has, at the step (dx, dz), a neighbour with these values. Pushing values to
    the neighbours instead of fetching them needs no join; an aggregate by
    (keys, x, z) finishes the work. Steps beyond the edge are folded home or
    dropped.
    """
    d = df.select(*keys, "x", "z", *carry, F.inline(_steps(offsets)))
    d = d.withColumns({"x": F.col("x") - F.col("dx"), "z": F.col("z") - F.col("dz")})
    d = d.withColumn("y", -F.col("x") - F.col("z"))
    d = H.with_wrap(d, n) if periodic else d.filter(H.in_home("x", "y", "z", n))
    return d.drop("y")


def smooth_7(
    df: DataFrame, n: int, passes: int = 1, integer: bool = False, keys: list[str] = ("frame_id",)
) -> DataFrame:
    """Mean of each pixel and its six neighbours, wrapped."""
    steps = [(0, 0), *H.NEIGHBOURS]
    d = df.select(*keys, "x", "z", "value")
    for _ in range(passes):
        s = neighbor_join(d, n, steps, keys=list(keys)).groupBy(*keys, "x", "z")
        mean = F.floor((F.sum("value") + 3) / 7) if integer else F.sum("value") / 7
        d = s.agg(mean.alias("value"))
    return d


def _kernel_value(mode: str, weight: int) -> Column:
    """Aggregate over (value, center) rows; the centre counts ``weight`` times."""
    times = F.when(F.col("center"), weight).otherwise(1)
    if mode == "mean":
        return F.floor(F.sum(F.col("value") * times) / F.sum(times) + 0.5)
    if mode == "min":
        return F.min("value")
    if mode == "max":
        return F.max("value")
    if mode != "median":
        raise ValueError(mode)
    # the kernel bounds the list
    vals = F.sort_array(F.flatten(F.collect_list(F.array_repeat("value", times))))
    size = F.size(vals)
    lo, hi = F.get(vals, F.floor((size - 1) / 2).cast("int")), F.get(vals, F.floor(size / 2).cast("int"))
    return F.floor((lo + hi) / 2 + 0.5)


def outlier_filter(
    df: DataFrame, n: int, r_detect: int = 1, r_replace: int | None = None, threshold: int = 0,
    mode: str = "median", weight: int = 1, bright: bool = True, dark: bool = True, passes: int = 1,
    hexagonal: bool = True, keys: list[str] = ("frame_id",),
) -> DataFrame:
    """Replace pixels that differ from their neighbourhood by the threshold.

    ``n`` is the radius of the hexagon, or the edge of the periodic square when
    ``hexagonal`` is False. Threshold 0 replaces every pixel.
    """
    r_replace = r_detect if r_replace is None else r_replace
    r = max(r_detect, r_replace)
    keys = list(keys)
    d = df.select(*keys, "x", "z", "value")
    for _ in range(passes):
        if hexagonal:
            pushed = neighbor_join(d, n, offsets_within(r), keys=keys)
            ring = F.shiftright(F.abs("dx") + F.abs("dz") + F.abs(F.col("dx") + F.col("dz")), 1)
        else:
            box = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)]
            pushed = d.select(*keys, "x", "z", "value", F.inline(_steps(box)))
            pushed = pushed.withColumns(
                {c: F.pmod(F.col(c) - F.col("d" + c), F.lit(n)) for c in ("x", "z")}
            )
            ring = F.greatest(F.abs("dx"), F.abs("dz"))
        pushed = pushed.withColumns({"center": ring == 0, "_ring": ring})
        if r_detect == r_replace or threshold == 0:
            g = pushed.groupBy(*keys, "x", "z").agg(
                _kernel_value(mode, weight).alias("_rep"),
                F.max(F.when(F.col("center"), F.col("value"))).alias("_old"),
            ).withColumn("_det", F.col("_rep"))
        else:
            def part(radius, name):
                return pushed.filter(F.col("_ring") <= radius).groupBy(*keys, "x", "z").agg(
                    _kernel_value(mode, weight).alias(name)
                )

            g = part(r_detect, "_det").join(part(r_replace, "_rep"), [*keys, "x", "z"])
            g = g.join(d.withColumnRenamed("value", "_old"), [*keys, "x", "z"])
        hit = F.lit(threshold == 0)
        if bright:
            hit = hit | (F.col("_old") - F.col("_det") >= threshold)
        if dark:
            hit = hit | (F.col("_det") - F.col("_old") >= threshold)
        d = g.select(*keys, "x", "z", F.when(hit, F.col("_rep")).otherwise(F.col("_old")).alias("value"))
    return d


# -- masks -------------------------------------------------------------------


def _mirror_pad(df: DataFrame, axis: str, size: int, reach: int) -> DataFrame:
    """Add the mirrored border pixels of one axis (edge pixel repeated)."""
    if reach > size:
        raise ValueError("the box is larger than the frame")
    a = F.col(axis)
    places = F.filter(
        F.array(a, -a - 1, 2 * size - 1 - a),
        lambda p: (p >= -reach) & (p < size + reach),
    )
    return df.withColumn(axis, F.explode(F.array_distinct(places)))


def _line_window(axis: str, other: str, lo: int, hi: int):
    return W.partitionBy("frame_id", other).orderBy(axis).rangeBetween(lo, hi)


def gaussian_blur(df: DataFrame, sigma: float, width: int, height: int, value: str = "value") -> DataFrame:
    """Separable Gaussian with mirrored borders, cut at four sigma."""
    if sigma <= 0:
        return df
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(r + 1)]
    norm = raw[0] + 2 * sum(raw[1:])
    wk = [v / norm for v in raw]
    d = df
    for axis, other, size in (("x", "y", width), ("y", "x", height)):
        d = _mirror_pad(d, axis, size, r)
        w = W.partitionBy("frame_id", other).orderBy(axis)
        s = wk[0] * F.col(value)
        for k in range(1, r + 1):
            s = s + wk[k] * (F.lag(value, k).over(w) + F.lead(value, k).over(w))
        d = d.withColumn("_b", s).filter((F.col(axis) >= 0) & (F.col(axis) < size))
        d = d.withColumn(value, F.col("_b")).drop("_b")
    return d


def box_means(df: DataFrame, columns: list[str], box: int, width: int, height: int) -> DataFrame:
    """Mean of several columns in a square box with mirrored borders."""
    h = box // 2
    d = df
    for axis, other, size in (("x", "y", width), ("y", "x", height)):
        d = _mirror_pad(d, axis, size, h)
        w = _line_window(axis, other, -h, h)
        d = d.withColumns({f"_s_{c}": F.sum(c).over(w) for c in columns})
        d = d.filter((F.col(axis) >= 0) & (F.col(axis) < size))
        d = d.withColumns({c: F.col(f"_s_{c}") for c in columns}).drop(*[f"_s_{c}" for c in columns])
    return d.withColumns({c: F.col(c) / (box * box) for c in columns})


def _odd(box: int) -> int:
    return box + 1 if box % 2 == 0 else box


def threshold_mask(
    df: DataFrame, threshold, box: int, width: int, height: int, sigma: float = 0.0, out: str = "dirt"
) -> DataFrame:
    """1 where most pixels of the box around are above the threshold."""
    d = spread(df, "frame_id").withColumn("_blur", F.col("value").cast("double"))
    d = gaussian_blur(d, sigma, width, height, "_blur")
    d = d.withColumn(out, (F.col("_blur") > col(threshold) if isinstance(threshold, str)
                           else F.col("_blur") > threshold).cast("int"))
    return box_means(d, [out], _odd(box), width, height).withColumn(
        out, F.bround(out).cast("int")
    ).drop("_blur")


def _square(df: DataFrame, n: int, column: str, agg) -> DataFrame:
    """Square min or max of edge n, anchored at n div 2, cut at the border."""
    lo, hi = -(n // 2), n - 1 - n // 2
    d = df.withColumn(column, agg(column).over(_line_window("x", "y", lo, hi)))
    return d.withColumn(column, agg(column).over(_line_window("y", "x", lo, hi)))


def erode(df: DataFrame, n: int, column: str = "value") -> DataFrame:
    return _square(df, n, column, F.min) if n > 1 else df


def dilate(df: DataFrame, n: int, column: str = "value") -> DataFrame:
    return _square(df, n, column, F.max) if n > 1 else df


def area_mask(
    df: DataFrame, clean: float, light: float, heavy: float, box: int, width: int, height: int,
    sigma: float = 0.0, border: int = 0, left_edge: int = 0,
) -> DataFrame:
    """Codes 1 clean, 4 light dirt, 16 heavy dirt, 0 none of them.

    The three masks share one blur and one pair of box windows. Frames are spread
    once; all windows lie within a frame.
    """
    d = spread(df, "frame_id").withColumn("_blur", F.col("value").cast("double"))
    d = gaussian_blur(d, sigma, width, height, "_blur")
    limits = {"_m_clean": clean, "_m_light": light, "_m_heavy": heavy}
    on = {k: v for k, v in limits.items() if v > 0}
    if light == heavy:
        on.pop("_m_light", None)
    d = d.withColumns({k: (F.col("_blur") > v).cast("int") for k, v in on.items()})
    if on:
        d = box_means(d, list(on), _odd(box), width, height)
        d = d.withColumns({k: F.bround(k).cast("int") for k in on})
    if border > 1:
        if "_m_clean" in on:
            d = erode(d, border, "_m_clean")
        if "_m_heavy" in on:
            d = dilate(d, border, "_m_heavy")
    m = F.col("_m_clean") if "_m_clean" in on else F.lit(1)
    if "_m_light" in on:
        m = F.when(F.col("_m_light") == 1, 4).otherwise(m)
    if "_m_heavy" in on:
        m = F.when(F.col("_m_heavy") == 1, 16).otherwise(m)
    if left_edge:
        m = F.when(F.col("x") < left_edge, 16).otherwise(m)
    return d.withColumn("mask", m).drop("_blur", *on)


def threshold_curve(
    df: DataFrame, box: int, width: int, height: int, sigma: float = 0.0, steps: int = 30
) -> DataFrame:
    """Masked share of every frame for rising thresholds, and the threshold
    that follows from where the share starts to fall and where it ends.

    All thresholds of one pass are columns of the same windows. The range
    starts at twice the frame mean and doubles for the frames whose mask has
    not vanished; it must vanish once the range is above the maximum. A frame
    without a positive mean has no such range: its end and threshold are null.
    """
    mean = df.groupBy("frame_id").agg(F.avg("value").cast("double").alias("_mean"))
    base = gaussian_blur(df.withColumn("value", F.col("value").cast("double")), sigma, width, height)
    base = base.select("frame_id", "x", "y", "value")
    scale, found, open_frames = 2.0, None, mean.withColumn("_start", F.lit(None).cast("double"))
    names = [f"_m{i}" for i in range(steps)]
    while True:
        d = base.join(open_frames, "frame_id")
        step = F.col("_mean") * scale / (steps - 1)
        d = d.withColumns(
            {c: (F.col("value") > step * i).cast("int") for i, c in enumerate(names)}
        )
        d = box_means(d, names, _odd(box), width, height)
        share = d.groupBy("frame_id").agg(
            F.first("_mean").alias("_mean"), F.first("_start").alias("_start"),
            *[F.avg(F.bround(c)).alias(c) for c in names],
        )
        step = F.col("_mean") * scale / (steps - 1)

        def first_below(limit):
            hits = [F.when(F.col(c) < limit, step * i) for i, c in enumerate(names)]
            return F.coalesce(*hits)

        share = share.select(
            "frame_id", "_mean", F.coalesce("_start", first_below(0.99)).alias("_start"),
            first_below(0.01).alias("_end"), step.alias("_step"), F.array(*names).alias("shares"),
        )
        share = cut_lineage(share)
        positive = F.coalesce((F.col("_mean") > 0) & (F.col("_mean") < float("inf")), F.lit(False))  # NaN is above all
        done = share.filter(F.col("_end").isNotNull() | ~positive).select(
            "frame_id", F.when(positive, F.col("_start")).alias("dirt_start"), F.when(positive, F.col("_end")).alias("dirt_end"),
            F.col("_step").alias("step"), "shares",
        )
        found = done if found is None else found.unionByName(done)
        open_frames = share.filter(F.col("_end").isNull() & positive).select("frame_id", "_mean", "_start")
        if open_frames.isEmpty():
            break
        scale *= 2
    narrow = F.col("dirt_end") - F.col("dirt_start") < 3 * F.col("step")
    return found.withColumn(
        "threshold", F.when(narrow, F.col("dirt_end")).otherwise(F.col("dirt_start")) * 1.25
    )


def row_artifact_mask(df: DataFrame, n: int, factor: float = 1.1) -> DataFrame:
    """Mask the first n rows of frames in which they are too bright. Pixels
    off the clean area count as the clean mean, and are set to it."""
    clean, top = F.col("mask") == 1, F.col("y") < n
    v = F.col("value").cast("double")
    s = df.groupBy("frame_id").agg(
        F.avg(F.when(clean, v)).alias("_clean"),
        F.sum(F.when(top & clean, v).otherwise(0.0)).alias("_sum"),
        F.count_if(top & ~clean).alias("_off"), F.count_if(top).alias("_n"),
    )
    s = s.withColumn(
        "_bad", (F.col("_sum") + F.col("_off") * F.col("_clean")) / F.col("_n") > factor * F.col("_clean")
    )
    d = df.join(s.select("frame_id", "_clean", "_bad"), "frame_id")
    hit = top & F.coalesce("_bad", F.lit(False))
    return d.withColumns(
        {
            "value": F.when(hit | ~clean, F.col("_clean")).otherwise(v),
            "mask": F.when(hit, 16).otherwise(F.col("mask")),
        }
    ).drop("_clean", "_bad")


def _chessboard(dirty: np.ndarray, far: int) -> np.ndarray:
    """Chessboard distance of every pixel of one frame to the nearest dirty one.

    A distance is at most k where the square of half width k holds dirt; its count
    is four look-ups in the integral image, and k is found by bisection for all
    pixels side by side, so the work does not depend on how far dirt is.
    """
    height, width = dirty.shape
    total = np.zeros((height + 1, width + 1), np.int64)
    total[1:, 1:] = dirty.cumsum(0).cumsum(1)
    y, x = np.mgrid[:height, :width]
    low, high = np.zeros(dirty.shape, np.int64), np.full(dirty.shape, far)
    while (low < high).any():
        k = (low + high) // 2
        top, bottom = np.maximum(y - k, 0), np.minimum(y + k + 1, height)
        left, right = np.maximum(x - k, 0), np.minimum(x + k + 1, width)
        hit = total[bottom, right] - total[top, right] - total[bottom, left] + total[top, left] > 0
        high = np.where(hit, k, high)
        low = np.where(hit, low, np.minimum(k + 1, high))
    return high


def dirt_distance(df: DataFrame, dirt: Column, width: int, height: int) -> DataFrame:
    """Chessboard distance of each pixel to the nearest dirty one; the larger side
    of the frame where a frame has no dirt.

    One shuffle by frame, whose size the geometry sets. Missing pixels are clean.
    """
    far = max(width, height)
    ship(df.sparkSession)

    def frame(t: pa.Table) -> pa.Table:
        x, y = t["x"].to_numpy(), t["y"].to_numpy()
        dirty = np.zeros((height, width), bool)
        dirty[y, x] = t["_dirt"].to_numpy()
        return t.drop(["_dirt"]).append_column("dist", pa.array(_chessboard(dirty, far)[y, x].astype(np.int32)))

    d = df.withColumn("_dirt", F.coalesce(dirt, F.lit(False)))
    return d.groupBy("frame_id").applyInArrow(frame, T.StructType([*df.schema.fields, T.StructField("dist", T.IntegerType())]))


def clean_spots(
    df: DataFrame, dirt: Column, width: int, height: int, radius: int, overlap: float = 0.1, limit: int | None = None
) -> DataFrame:
    """Centres of clean areas: farthest from dirt first, each suppressing the
    square of twice its reach around it; the first ``limit`` of a frame on request.

    Rounds give the same set as taking one centre at a time. Tiles as wide as
    the reach of a square hold one best pixel each; it is chosen once it beats
    the best of the eight tiles around, since then nothing better is near.
    """
    reach = int(round(radius * (1 - overlap)))
    d = dirt_distance(df, dirt, width, height)
    x, y = F.col("x"), F.col("y")
    inside = (x >= radius) & (x < width - radius) & (y >= radius) & (y < height - radius)
    rank = F.struct(F.col("dist"), (-y).alias("ny"), (-x).alias("nx"))
    live = cut_lineage(
        d.filter(inside & (F.col("dist") > reach)).select("frame_id", "x", "y", "dist", rank.alias("_rank"))
    )
    span = 2 * reach
    tile = {"_tx": F.floor(x / span), "_ty": F.floor(y / span)}
    around = _steps([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    live = live.withColumns(tile)
    chosen = None
    while not live.isEmpty():
        best = live.groupBy("frame_id", "_tx", "_ty").agg(F.max("_rank").alias("_rank"))
        near = best.select("frame_id", "_tx", "_ty", "_rank", F.inline(around)).groupBy(
            "frame_id", (F.col("_tx") + F.col("dx")).alias("_tx"), (F.col("_ty") + F.col("dz")).alias("_ty")
        ).agg(F.max("_rank").alias("_top"))
        now = best.join(apart(near), ["frame_id", "_tx", "_ty"]).filter(F.col("_rank") == F.col("_top"))
        now = now.select(
            "frame_id", (-F.col("_rank.nx")).alias("x"), (-F.col("_rank.ny")).alias("y"), F.col("_rank.dist").alias("dist")
        )
        now = cut_lineage(now)
        chosen = now if chosen is None else chosen.unionByName(now)
        boxes = now.withColumns(tile).select(
            "frame_id", F.col("x").alias("_cx"), F.col("y").alias("_cy"), "_tx", "_ty", F.inline(around)
        ).select(
            "frame_id", "_cx", "_cy", (F.col("_tx") + F.col("dx")).alias("_tx"), (F.col("_ty") + F.col("dz")).alias("_ty")
        )
        boxes = apart(boxes)
        hit = (
            (live.frame_id == boxes.frame_id) & (live._tx == boxes._tx) & (live._ty == boxes._ty)
            & (live.x >= boxes._cx - span) & (live.x < boxes._cx + span)
            & (live.y >= boxes._cy - span) & (live.y < boxes._cy + span)
        )
        live = cut_lineage(live.join(boxes, hit, "left_anti"))
    if chosen is None:
        return live.select("frame_id", "x", "y", "dist", F.lit(0).alias("place"))
    w = W.partitionBy("frame_id").orderBy(F.desc("dist"), "y", "x")
    placed = chosen.withColumn("place", F.row_number().over(w))
    return placed if limit is None else placed.filter(F.col("place") <= limit)


# -- counts --------------------------------------------------------------------


def count_divisor(df: DataFrame, eps: float = 1e-9, by: str = "frame_id") -> DataFrame:
    """Mean and spread of the smallest steps between the sorted values.

    Only distinct values matter for the steps, and each frame has few of
    them; equal neighbours are steps of zero.
    """
    v = df.select(by, F.greatest(F.col("value").cast("double"), F.lit(0.0)).alias("v")).distinct()
    step = F.col("v") - F.lag("v").over(W.partitionBy(by).orderBy("v"))
    s = v.select(by, step.alias("s")).filter(F.col("s") > eps)
    low = s.groupBy(by).agg(F.min("s").alias("_m"))
    return s.join(low, by).filter(F.col("s") < 1.5 * F.col("_m")).groupBy(by).agg(
        F.avg("s").alias("divisor"), F.stddev_pop("s").alias("spread")
    )


def clip_shift(
    sf: DataFrame, report: DataFrame, level: float = -1, top: int = -1, divisor: float = 1.0,
    min_contrast: float = 0.0,
) -> DataFrame:
    """Move the mean of each sub-frame to a new level and clip to 0..top.

    ``kind`` is regular, underflow or chopped for the counts of the report.
    """
    r = report.filter(F.col("contrast") >= min_contrast).select("frame_id", "hex_avg")
    d = sf.join(r, "frame_id")
    base = F.lit(int(level)) if level > 0 else F.col("hex_avg").cast("long")
    raw = ((F.col("value") - F.col("hex_avg")) / divisor + base + 0.5).cast("long")
    d = d.withColumn("_raw", raw)
    low = F.greatest(F.col("_raw"), F.lit(0).cast("long"))
    new = F.least(low, F.lit(top).cast("long")) if top > 0 else low
    kind = F.when(F.col("_raw") < 0, "underflow")
    if top > 0:
        kind = kind.when(F.col("_raw") > top, "chopped")
    return d.withColumns({"value": new, "kind": kind.otherwise("regular")}).drop("_raw", "hex_avg")


# -- unit cells --------------------------------------------------------------


def fold_cells(
    pixels: DataFrame, params: DataFrame, bond: int, res: int, width: int, height: int, sub: int = 1,
    keys: list[str] = ("frame_id",),
) -> DataFrame:
    """Cell hits: every clean count at its place in the unit cell, for the two
    orientations of the cell that tile the same lattice.

    ``params`` holds hel, tilt, excent, phi, off_x, off_y per ``keys``. A pixel
    is spread over sub x sub points. Gives (keys, orient, c1, c2, i, j, value,
    dirty); see clean_cells.
    """
    keys = list(keys)
    # the basis is computed once per row of params, not per pixel
    d = pixels.join(L.with_cell_basis(params, bond), [k for k in keys if k in pixels.columns])
    pts = F.array(
        *[
            F.struct(F.lit((a + 0.5) / sub).alias("sx"), F.lit((b + 0.5) / sub).alias("sy"))
            for a in range(sub) for b in range(sub)
        ]
    )
    d = d.select("*", F.inline(pts))
    dx, dy = F.col("x") + F.col("sx") - F.col("off_x"), F.col("y") + F.col("sy") - F.col("off_y")
    d = d.withColumns({"_f": F.col("i11") * dx + F.col("i12") * dy, "_g": F.col("i21") * dx + F.col("i22") * dy})
    both = F.array(
        F.struct(F.lit(0).alias("orient"), F.col("_f").alias("f1"), F.col("_g").alias("f2")),
        F.struct(F.lit(1).alias("orient"), (F.col("_f") + F.col("_g")).alias("f1"), (-F.col("_f")).alias("f2")),
    )
    geo = ["e1x", "e1y", "e2x", "e2y", "off_x", "off_y"]
    d = d.select(*keys, *geo, "value", "mask", F.inline(both))
    d = d.withColumns({"c1": F.floor("f1"), "c2": F.floor("f2")})
    d = d.filter(_cell_inside(width, height))
    return d.select(
        *keys, "orient", "c1", "c2",
        F.least(F.floor((F.col("f1") - F.col("c1")) * res), F.lit(res - 1)).alias("i"),
        F.least(F.floor((F.col("f2") - F.col("c2")) * res), F.lit(res - 1)).alias("j"),
        (F.col("value") / (sub * sub)).alias("value"), (F.col("mask") != 1).alias("dirty"),
    )


def _cell_inside(width: int, height: int) -> Column:
    """All four corners of the cell (c1, c2) of an orientation are inside."""
    # the second orientation is spanned by e2 and e2 - e1
    second = F.col("orient") == 1
    ux = F.when(second, F.col("e2x")).otherwise(F.col("e1x"))
    uy = F.when(second, F.col("e2y")).otherwise(F.col("e1y"))
    vx = F.when(second, F.col("e2x") - F.col("e1x")).otherwise(F.col("e2x"))
    vy = F.when(second, F.col("e2y") - F.col("e1y")).otherwise(F.col("e2y"))
    ok = F.lit(True)
    for d1, d2 in ((0, 0), (1, 0), (0, 1), (1, 1)):
        f1, f2 = F.col("c1") + d1, F.col("c2") + d2
        x = F.col("off_x") + f1 * ux + f2 * vx
        y = F.col("off_y") + f1 * uy + f2 * vy
        ok = ok & (x >= 0) & (x < width) & (y >= 0) & (y < height)
    return ok


def clean_cells(hits: DataFrame, keys: list[str] = ("frame_id",)) -> DataFrame:
    """Drop every cell that holds a pixel which is not clean.

    A cell has a fixed, small number of pixels, so one window over the cell
    decides it; ``lead`` marks one row of every cell that is kept.
    """
    w = W.partitionBy(*keys, "orient", "c1", "c2")
    d = hits.withColumns(
        {"_bad": F.max("dirty").over(w), "lead": (F.row_number().over(w.orderBy("i", "j")) == 1).cast("int")}
    )
    return d.filter(~F.col("_bad")).drop("_bad", "dirty")


def cell_sums(clean: DataFrame, keys: list[str] = ("frame_id",)) -> DataFrame:
    """Folded cell per orientation: sum of counts and mean per good cell."""
    keys = list(keys)
    s = clean.groupBy(*keys, "orient", "i", "j").agg(F.sum("value").alias("value"), F.sum("lead").alias("_n"))
    s = s.withColumn("cells", F.sum("_n").over(W.partitionBy(*keys, "orient"))).drop("_n")
    return s.withColumn("mean", F.col("value") / F.col("cells"))


def full_cell(cell: DataFrame, keys: list[str], res: int) -> DataFrame:
    """Add the empty bins of folded cells (keys, i, j, value): the res^2 bins of
    a cell are put in one list and read back by position."""
    entry = F.struct((F.col("i") + res * F.col("j")).cast("int").alias("k"), F.col("value").cast("double").alias("v"))
    m = cell.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    d = m.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(res * res - 1))).alias("_p"))
    return d.select(
        *keys, (F.col("_p") % res).cast("long").alias("i"), F.floor(F.col("_p") / res).alias("j"),
        F.coalesce(F.try_element_at("_m", F.col("_p")), F.lit(0.0)).alias("value"),
    )


def mirror_quality(cell: DataFrame, res: int, keys: list[str] = ("frame_id",)) -> DataFrame:
    """1 - mean asymmetry under the two mirrors for bins above half height.

    The mirror images of a bin form an orbit of up to four bins; grouping by
    the smallest bin of the orbit replaces three self joins.
    """
    keys = list(keys)
    w = W.partitionBy(*keys)  # res^2 rows
    cell = cell.withColumns({"_hi": F.max("value").over(w), "_lo": F.min("value").over(w)})
    i, j, last = F.col("i"), F.col("j"), res - 1
    images = F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in
                       ((i, j), (j, i), (last - i, last - j), (last - j, last - i))])
    orb = cell.withColumn("_orb", F.array_min(images)).groupBy(*keys, "_hi", "_lo", "_orb").agg(
        F.collect_list("value").alias("v")  # at most four
    )
    thr = F.floor(0.5 * F.col("_hi") + 0.5 * F.col("_lo"))
    floor_ = F.floor(0.25 * F.col("_hi") + 0.75 * F.col("_lo"))
    orb = orb.withColumns({"_thr": thr, "_min": floor_, "_w": F.lit(4) / F.size("v")})
    total = F.aggregate("v", F.lit(0.0), lambda a, e: a + e - F.col("_min")) * F.col("_w")
    orb = orb.withColumn("_sum", total)
    spread = F.aggregate(
        "v", F.lit(0.0), lambda a, e: a + F.abs(F.col("_sum") - 4 * (e - F.col("_min")))
    ) * F.col("_w")
    ds = spread / F.nullif(6 * F.col("_sum"), F.lit(0.0))
    ds = F.when((ds >= 0) & (ds <= 1), ds).otherwise(1.0)
    above = F.size(F.filter("v", lambda e: e > F.col("_thr")))
    return orb.withColumns({"_ds": ds, "_n": above}).groupBy(*keys).agg(
        (1 - F.sum(F.col("_ds") * F.col("_n")) / F.nullif(F.sum("_n"), F.lit(0))).alias("mirrorQ")
    )


def gaussian_template(res: int) -> list[float]:
    """Unit-height template of the two atoms of a cell and their neighbours,
    row by row (j * res + i). Fixed values: atom sites at thirds of the cell."""
    third = 1 / 3
    sites = [(third, third), (2 * third, 2 * third), (-third, 2 * third),
             (2 * third, -third), (4 * third, third), (third, 4 * third)]

    def xy(a, b):
        return (a + b) * math.cos(math.pi / 6), (b - a) * math.sin(math.pi / 6)

    sx, sy = xy(third, third)
    s2 = (sx * sx + sy * sy) / (2.35 * 2.35)
    centers = [xy(a, b) for a, b in sites]
    out = []
    for j in range(res):
        for i in range(res):
            px, py = xy(i / res, j / res)
            out.append(sum(math.exp(-((px - cx) ** 2 + (py - cy) ** 2) / s2) for cx, cy in centers))
    return out


def template_offset(
    cell: DataFrame, res: int, template: list[float] | None = None, keys: list[str] = ("frame_id",)
) -> DataFrame:
    """Residual of the cell to the template for each cyclic shift.

    Gives (keys, sx, sy, residual, merit): 1000 * sqrt(sum of squares) / sum,
    and the inverted merit with mean 1000. The square is expanded, so one pass
    of product sums per shift is all that depends on the shift; the template
    is a constant array of res^2 numbers. Cells must be complete.
    """
    keys = list(keys)
    t = template or gaussian_template(res)
    if len(t) != res * res:
        raise ValueError("the template must have res * res values")
    tmpl = F.array(*[F.lit(float(v)) for v in t])
    d = cell.select(*keys, "i", "j", "value", F.posexplode(tmpl).alias("_p", "_t"))
    d = d.withColumns(
        {
            "sx": F.pmod(F.col("i") - F.col("_p") % res, F.lit(res)),
            "sy": F.pmod(F.col("j") - F.floor(F.col("_p") / res), F.lit(res)),
        }
    )
    st, st2 = sum(t), sum(v * v for v in t)
    g = d.groupBy(*keys, "sx", "sy").agg(
        F.sum(F.col("value") * F.col("_t")).alias("c"), F.sum("value").alias("s"),
        F.sum(F.col("value") * F.col("value")).alias("s2"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
    )
    lo, amp = F.col("lo"), F.col("hi") - F.col("lo")
    sq = (
        F.col("s2") - 2 * lo * F.col("s") + res * res * lo * lo
        - 2 * amp * (F.col("c") - lo * st) + amp * amp * st2
    )
    g = g.select(*keys, "sx", "sy", (1000 * F.sqrt(F.greatest(sq, F.lit(0.0))) / F.nullif(F.col("s"), F.lit(0.0))).alias("residual"))
    w = W.partitionBy(*keys)  # res^2 rows
    mean, worst = F.avg("residual").over(w), F.max("residual").over(w)
    return g.withColumn("merit", 1000 * (F.col("residual") - worst) / F.nullif(mean - worst, F.lit(0.0)))


def best_template_shift(offsets: DataFrame, keys: list[str] = ("frame_id",)) -> DataFrame:
    return offsets.groupBy(*keys).agg(
        F.min(F.struct(F.round("residual", 9).alias("residual"), "sx", "sy")).alias("b")
    ).select(*keys, "b.sx", "b.sy", "b.residual")


def position_quality(offsets: DataFrame, res: int, keys: list[str] = ("frame_id",), flat: float = 1e-7) -> DataFrame:
    """Inverse second moment of the merit peak above half height, around the
    best shift; null for flat frames, whose residuals differ by ``flat`` at most,
    and for a peak without width."""
    keys = list(keys)
    over = W.partitionBy(*keys)  # res^2 rows
    half = res // 2
    d = offsets.withColumns(
        {
            "_w": F.max("residual").over(over), "_b": F.min("residual").over(over),
            "_best": F.min(F.struct(F.round("residual", 9).alias("residual"), "sx", "sy")).over(over),
        }
    )

    def centred(c):
        return (F.pmod(F.col(c) - F.col(f"_best.{c}") + half, F.lit(res)) - half) / F.lit(float(res))

    span = F.col("_w") - F.col("_b")
    rel = F.when(span > flat, (F.col("_w") - F.col("residual")) / span - 0.5)
    d = d.select(*keys, centred("sx").alias("dx"), centred("sy").alias("dy"), F.when(rel > 0, rel).alias("w"))
    w, dx, dy = F.col("w"), F.col("dx"), F.col("dy")
    m = d.groupBy(*keys).agg(
        F.sum(w).alias("s"), F.sum(w * dx).alias("sx"), F.sum(w * dy).alias("sy"),
        F.sum(w * dx * dx).alias("sxx"), F.sum(w * dy * dy).alias("syy"),
    )
    s = F.col("s")
    var = F.abs(F.col("sxx") / s - F.pow(F.col("sx") / s, 2)) + F.abs(F.col("syy") / s - F.pow(F.col("sy") / s, 2))
    return m.select(*keys, (1 / F.nullif(30 * var, F.lit(0.0))).alias("positionQ"))


# -- spectra -------------------------------------------------------------------


def structure_factor(pixels: DataFrame, kvecs: list[tuple[float, float]], keys: list[str] = ("frame_id",)) -> DataFrame:
    """Spectral power |sum v exp(2 pi i k r)|^2 at the given frequencies.

    The frequencies are a constant array; the sums are combined on the map
    side, so what is shuffled is frames x frequencies, not pixels.
    """
    ks = F.array(
        *[F.struct(F.lit(i).alias("k"), F.lit(float(a)).alias("kx"), F.lit(float(b)).alias("ky"))
          for i, (a, b) in enumerate(kvecs)]
    )
    d = pixels.select(*keys, "x", "y", "value", F.inline(ks))
    arg = 2 * math.pi * (F.col("kx") * F.col("x") + F.col("ky") * F.col("y"))
    s = d.groupBy(*keys, "k", "kx", "ky").agg(
        F.sum(F.col("value") * F.cos(arg)).alias("re"), F.sum(F.col("value") * F.sin(arg)).alias("im")
    )
    return s.select(*keys, "k", "kx", "ky", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def six_fold_peaks(
    spectrum: DataFrame, expected: float, tol: int, first_sigma: float = 6.0, other_sigma: float = 5.0,
    second_order: bool = False, ratio: float = 0.213 / 0.123,
) -> DataFrame:
    """Six peaks of a spectrum (frame_id, kx, ky, power), k = 0 at the centre.

    The first is the brightest pixel in the ring 0.6667..1.5 of the expected
    radius that stands out of its box by ``first_sigma``; the others are the
    maxima of boxes at its rotations by 60 degrees that stand out by
    ``other_sigma``. The second order sits 30 degrees further, ``ratio`` times
    as far out.
    """
    p = spectrum.select("frame_id", F.col("kx").cast("long"), F.col("ky").cast("long"), "power")

    def box_stats(d: DataFrame, reach: int) -> DataFrame:
        out = d.withColumns({"_n": F.lit(1), "_s": F.col("power"), "_q": F.col("power") * F.col("power")})
        for axis, other in (("kx", "ky"), ("ky", "kx")):
            w = W.partitionBy("frame_id", other).orderBy(axis).rangeBetween(-reach, reach)
            out = out.withColumns({c: F.sum(c).over(w) for c in ("_n", "_s", "_q")})
        mean = F.col("_s") / F.col("_n")
        std = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))
        return out.withColumns({"_mean": mean, "_std": std}).drop("_n", "_s", "_q")

    r = F.sqrt(F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky"))
    ring = box_stats(p, tol).filter((r >= expected * 0.6667) & (r <= expected * 1.5))
    ring = ring.filter(F.col("power") >= F.col("_mean") + first_sigma * F.col("_std"))
    first = ring.groupBy("frame_id").agg(
        F.max_by(F.struct("kx", "ky", "power"), F.struct(F.col("power"), -F.col("kx"), -F.col("ky"))).alias("f")
    ).select("frame_id", "f.kx", "f.ky", "f.power")
    out = first.select("frame_id", F.lit(1).alias("order"), F.lit(0).alias("peak"), "kx", "ky", "power")

    def boxes(order: int, start: float, scale: float, reach: int, skip_first: bool) -> DataFrame:
        spots = F.array(
            *[
                F.struct(F.lit(i).alias("peak"), F.lit(math.cos(a) * scale).alias("c"), F.lit(math.sin(a) * scale).alias("s"))
                for i, a in ((i, i * math.pi / 3 + start) for i in range(6))
                if not (skip_first and i == 0)
            ]
        )
        b = first.select("frame_id", "kx", "ky", F.inline(spots))
        # rotation in (ky, kx) order, as rows are the first axis of an image
        b = b.select(
            "frame_id", "peak",
            F.bround(F.col("s") * F.col("ky") + F.col("c") * F.col("kx")).cast("long").alias("bx"),
            F.bround(F.col("c") * F.col("ky") - F.col("s") * F.col("kx")).cast("long").alias("by"),
        )
        span = F.sequence(F.lit(-reach), F.lit(reach))
        cells = b.select("frame_id", "peak", "bx", "by", F.explode(span).alias("dx"))
        cells = cells.select(
            "frame_id", "peak", (F.col("bx") + F.col("dx")).alias("kx"), "by", F.explode(span).alias("dy")
        ).select("frame_id", "peak", "kx", (F.col("by") + F.col("dy")).alias("ky"))
        hit = cells.join(p, ["frame_id", "kx", "ky"]).groupBy("frame_id", "peak").agg(
            F.avg("power").alias("_mean"), F.stddev_pop("power").alias("_std"),
            F.max_by(F.struct("kx", "ky", "power"), F.struct(F.col("power"), -F.col("kx"), -F.col("ky"))).alias("f"),
        )
        hit = hit.filter(F.col("f.power") > F.col("_mean") + other_sigma * F.col("_std"))
        return hit.select("frame_id", F.lit(order).alias("order"), "peak", "f.kx", "f.ky", "f.power")

    out = out.unionByName(boxes(1, 0.0, 1.0, tol, True))
    if second_order:
        out = out.unionByName(boxes(2, math.pi / 6, ratio, int(round(tol * math.sqrt(3.0))), False))
    return out
