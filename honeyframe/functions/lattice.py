"""Lattice geometry of a frame as column expressions.

A frame is described by the pixel edge length ``hel``, the tilt, an elliptic
distortion (excentricity ``excent`` along the axis ``phi``) and an origin. The
y axis of an image points down, so angles enter with a minus sign.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from honeyframe.functions.numbers import col


def undistort(dx: Column, dy: Column, excent, phi) -> tuple[Column, Column]:
    """Shrink the component along the second ellipse axis by ``excent``."""
    phi = col(phi)
    c, s = F.cos(phi), F.sin(phi)
    along = dx * c - dy * s
    across = (-dx * s - dy * c) / col(excent)
    return along * c - across * s, -along * s - across * c


def with_lattice_coords(
    df: DataFrame, bond: int, x="x", y="y", hel="hel", tilt="tilt",
    excent="excent", phi="phi", off_x="off_x", off_y="off_y",
) -> DataFrame:
    """Add a1, a2 (unit cell) and p1, p2 (pixel) fractional coordinates.

    The cell axes lie at -tilt-30 and -tilt+30 degrees, the pixel axes at
    -tilt and -tilt+60 degrees; both pairs enclose 60 degrees.
    """
    ux, uy = undistort(col(x) - col(off_x), col(y) - col(off_y), excent, phi)
    d = df.withColumns({"_ux": ux, "_uy": uy})
    ux, uy = F.col("_ux"), F.col("_uy")
    hel, t = col(hel), -col(tilt)
    s60 = math.sin(math.pi / 3)

    def pair(length: Column, first: float):
        # solve u = f1 * e(first) + f2 * e(first + 60 degrees)
        a, b = t + first, t + first + math.pi / 3
        f1 = (F.sin(b) * ux - F.cos(b) * uy) / (length * s60)
        f2 = (F.cos(a) * uy - F.sin(a) * ux) / (length * s60)
        return f1, f2

    a1, a2 = pair(3 * bond * hel, -math.pi / 6)
    p1, p2 = pair(math.sqrt(3.0) * hel, 0.0)
    return d.withColumns({"a1": a1, "a2": a2, "p1": p1, "p2": p2}).drop("_ux", "_uy")


def _with_basis(params: DataFrame, length, first: float, p: str) -> DataFrame:
    t, d = -col("tilt"), params
    for k, ang in (("1", first), ("2", first + math.pi / 3)):
        x, y = undistort(length * F.cos(t + ang), length * F.sin(t + ang), 1 / col("excent"), "phi")
        d = d.withColumns({f"{p}{k}x": x, f"{p}{k}y": y})
    det = col(p + "1x") * col(p + "2y") - col(p + "1y") * col(p + "2x")
    return d.withColumns(
        {
            "i11": col(p + "2y") / det, "i12": -col(p + "2x") / det,
            "i21": -col(p + "1y") / det, "i22": col(p + "1x") / det,
        }
    )


def with_cell_basis(params: DataFrame, bond: int) -> DataFrame:
    """Add the distorted unit-cell vectors e1, e2 and their inverse i11..i22.

    One row per frame or trial: pixels then need only products and sums.
    """
    return _with_basis(params, 3 * bond * col("hel"), -math.pi / 6, "e")


def with_pixel_basis(params: DataFrame) -> DataFrame:
    """Same for the vectors p1, p2 between neighbouring hexagons."""
    return _with_basis(params, math.sqrt(3.0) * col("hel"), 0.0, "p")


def ellipse_radius(theta, a, b, rot) -> Column:
    theta, a, b, rot = col(theta), col(a), col(b), col(rot)
    return a * b / F.sqrt(
        F.pow(b * F.cos(theta - rot), 2) + F.pow(a * F.sin(theta - rot), 2)
    )
