"""Operators on points, hexagon areas and rasters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from honeyframe.functions import hexgrid as H
from honeyframe.functions.numbers import col
from honeyframe.session import bounded


def bilinear_shares(df: DataFrame, x="x", y="y", value="w") -> DataFrame:
    """Share each value among the four pixels around its position."""
    d = df.select(
        F.floor(x).alias("px"), F.floor(y).alias("py"), F.col(value).alias("_v"),
        (col(x) - F.floor(x)).alias("_fx"), (col(y) - F.floor(y)).alias("_fy"),
    )
    fx, fy, v = F.col("_fx"), F.col("_fy"), F.col("_v")
    parts = F.array(
        *[
            F.struct(
                (F.col("px") + dx).alias("px"),
                (F.col("py") + dy).alias("py"),
                (v * (fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("share"),
            )
            for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))
        ]
    )
    return (
        d.select(F.explode(parts).alias("s")).select("s.*")
        .groupBy("px", "py").agg(F.sum("share").alias("share"))
    )


def raster(width: int, height: int):
    """All (sx, sy) of a raster as a constant array column of its own size."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(width * height - 1)),
        lambda i: F.struct((i % width).alias("sx"), F.floor(i / width).alias("sy")),
    )


def hex_view(
    hex_pixels: DataFrame, width: int, height: int, pitch: float = 1.0,
    border: int = 0, periodic: tuple[int, int] | None = None,
) -> DataFrame:
    """Render hexagons on a square raster: every raster pixel shows the
    hexagon it lies in, 0 where there is none."""
    frames = hex_pixels.select("frame_id").distinct()
    view = frames.select("frame_id", F.explode(raster(width, height)).alias("s")).select(
        "frame_id", "s.sx", "s.sy"
    )
    row = pitch * math.sqrt(3.0) / 2
    view = view.withColumn("_p2", F.col("sy") / F.lit(row))
    view = view.withColumn("_p1", F.col("sx") / F.lit(float(pitch)) - F.col("_p2") / 2)
    view = H.with_hex_round(view, "_p1", "_p2").drop("_p1", "_p2")
    if border:
        x = F.col("q") - F.shiftright("r", 1) - border
        z = F.col("r") - border
        view = view.withColumns({"q": x + F.shiftright(z, 1), "r": z})
    elif periodic:
        view = view.withColumns(
            {"q": F.pmod("q", F.lit(periodic[0])), "r": F.pmod("r", F.lit(periodic[1]))}
        )
    src = hex_pixels.select("frame_id", "q", "r", "value")
    return view.join(src, ["frame_id", "q", "r"], "left").select(
        "frame_id", "sx", "sy", F.coalesce("value", F.lit(0)).alias("value")
    )


def clone_area(
    df: DataFrame, background: DataFrame, center: tuple[int, int], n: int,
    full: bool = False, blank_center: bool = False,
) -> DataFrame:
    """Keep the pixels of one hexagon, take all others from the background."""
    inside = H.in_hexagon("q", "r", center, n, full)
    if blank_center:
        inside = inside & ~((F.col("q") == center[0]) & (F.col("r") == center[1]))
    bg = background.select("q", "r", F.col("value").alias("_bg"))
    return df.join(bounded(bg), ["q", "r"], "left").select(
        "frame_id", "q", "r",
        F.when(inside, F.col("value")).otherwise(F.coalesce("_bg", F.lit(0))).alias("value"),
    )


def polygon_filter(
    points: DataFrame, corners: list[tuple[int, int]], x="x", z="z", n: int | None = None,
    full: bool = False,
) -> DataFrame:
    """Keep cube points strictly inside four half-planes.

    The corners are four (x, z) pairs; every edge faces the corner mean. With
    ``n`` all six corners of the hexagon around the point must be inside.
    """
    mx = sum(c[0] for c in corners) / 4
    mz = sum(c[1] for c in corners) / 4
    edges = []
    for (x1, z1), (x2, z2) in zip(corners, corners[1:] + corners[:1]):
        # in x, z coordinates the side of a line is the sign of a determinant
        a, b = z2 - z1, x1 - x2
        c = a * x1 + b * z1
        s = 1 if a * mx + b * mz >= c else -1
        edges.append((s * a, s * b, s * c))
    if n is None:
        shifts = [(0, 0)]
    else:
        big = n + 1 if full else n
        shifts = [(big, 0), (-n, 0), (0, big), (0, -n), (big, -big), (-n, n)]
    keep = F.lit(True)
    for dx, dz in shifts:
        for a, b, c in edges:
            keep = keep & (a * (col(x) + dx) + b * (col(z) + dz) > c)
    return points.filter(keep)


def mask_filter(cells: DataFrame, mask: DataFrame, n: int, full: bool = False) -> DataFrame:
    """Keep cells (frame_id, x, z) whose six hexagon corners all lie on the
    mask (frame_id, x, z, value > 0)."""
    big = n + 1 if full else n
    shifts = [(big, 0), (-n, 0), (0, big), (0, -n), (big, -big), (-n, n)]
    corner = F.explode(
        F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dz")) for a, b in shifts])
    )
    c = cells.select("frame_id", "x", "z", corner.alias("c")).select(
        "frame_id", F.col("x").alias("cx"), F.col("z").alias("cz"),
        (F.col("x") + F.col("c.dx")).alias("x"), (F.col("z") + F.col("c.dz")).alias("z"),
    )
    on = mask.filter(F.col("value") > 0).select("frame_id", "x", "z")
    good = (
        c.join(on, ["frame_id", "x", "z"])
        .groupBy("frame_id", "cx", "cz").agg(F.count(F.lit(1)).alias("hit"))
        .filter(F.col("hit") == len(shifts))
    )
    return good.select("frame_id", F.col("cx").alias("x"), F.col("cz").alias("z"))
