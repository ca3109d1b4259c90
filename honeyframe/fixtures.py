"""Stand-in tables derived from the given parquet files.

They have the shape of the real inputs: frames of 8 x 8 pixels (hexagon radius
4), scan lines, points and report rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from honeyframe.functions import hexgrid as H
from honeyframe.session import spread_rows

RADIUS = 4


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def px(spark: SparkSession, sf: str) -> DataFrame:
    """Square frames: (frame_id, grp, pos, q, r, value, mask)."""
    e = table(spark, sf, "embeddings")
    flat = e.select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    pos, v = F.col("pos").cast("long"), F.col("v")
    return flat.select(
        F.col("vec_id").alias("frame_id"),
        F.col("label").alias("grp"),
        pos.alias("pos"),
        (pos % 8).alias("q"),
        F.floor(pos / 8).alias("r"),
        F.floor(F.abs(v.cast("double")) * 20).alias("value"),
        F.when(v < -0.25, 16).when(v > 0.25, 4).otherwise(1).cast("long").alias("mask"),
    )


def hx(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels inside the hexagon with centred cube columns and index hp."""
    d = H.with_cube(px(spark, sf), "q", "r", center=(2, 4))
    d = d.filter(H.in_home("x", "y", "z", RADIUS))
    return d.withColumn("hp", H.hex_index("x", "z", RADIUS))


def sf_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Each stand-in frame is one sub-frame: (sf_id, grp, hp, x, z, value)."""
    return hx(spark, sf).select(
        F.col("frame_id").alias("sf_id"), "grp", "hp", "x", "y", "z", "q", "r", "value"
    )


def ev(spark: SparkSession, sf: str) -> DataFrame:
    """Scan lines: (line, pos, value); pos is the place along the line."""
    from honeyframe.operators.runs import running_position

    e = table(spark, sf, "events").select(
        F.col("user_id").alias("line"), "ts", "event_id", "value"
    )
    hour = F.date_trunc("hour", "ts")
    return running_position(e, "line", hour, ["ts", "event_id"], "pos").select("line", "pos", "value")


def pt(spark: SparkSession, sf: str) -> DataFrame:
    """Points in the plane: (id, x, y, w)."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        ((k * 7919 % 1009) / F.lit(10.0)).alias("x"),
        ((k * 104729 % 997) / F.lit(10.0)).alias("y"),
        F.floor(F.col("o_totalprice") / 10000).alias("w"),
    )


def rp(spark: SparkSession, sf: str) -> DataFrame:
    """Report rows, one per frame."""
    o = table(spark, sf, "orders")
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    d = o.select(
        k.alias("frame_id"),
        F.col("o_orderpriority").alias("grp"),
        F.concat_ws("_", k.cast("string"), c.cast("string"), F.lit("7.tif")).alias("label"),
        (p / 10000).alias("hex_merit"),
        (p / 1000).alias("hex_avg"),
        ((c % 50) / F.lit(100.0)).alias("contrast"),
        ((k % 360 - 180) * F.lit(3.141592653589793) / 180).alias("tilt"),
        (c % 13).alias("n_sf"),
    )
    return d.withColumn("hex_std", F.col("hex_avg") * F.col("contrast"))


def group_models(spark: SparkSession, sf: str, levels: int = 16, scale: float = 3.0) -> DataFrame:
    """One mean image per group, mapped to gray levels: (m, hp, level)."""
    return hx(spark, sf).groupBy(F.col("grp").cast("long").alias("m"), "hp").agg(
        F.least(
            F.lit(levels - 1), F.round(F.avg("value") * scale).cast("long")
        ).cast("long").alias("level")
    )


# -- honeycomb mesh ----------------------------------------------------------------
#
# Every order is a hexagon cell on a honeycomb 40 cells wide. Corners have integer
# places (vx, vy); at a few regular places a bond is turned by 90 degrees, which
# makes two 5-rings and two 7-rings.

MESH_WIDTH = 40


def _turned(vx, vy):
    """Upper atom of a turned bond."""
    return (vx % 20 == 7) & (vy % 30 == 13)


def _atom_id(vx, vy):
    return (vy + 10) * 100000 + vx + 10


def mesh_rings(spark: SparkSession, sf: str) -> DataFrame:
    """(view, ring_id, seq, atom_id), corners in order around each ring."""
    k = F.col("o_orderkey")
    c, r = k % MESH_WIDTH, F.floor(k / MESH_WIDTH)
    # orders are spread before they become corners: the few tasks that read the packed file
    # would hold all corners, and a ring stays where it is for what follows
    o = spread_rows(table(spark, sf, "orders").select(k.alias("ring_id")), "ring_id")
    d = o.withColumnRenamed("ring_id", "o_orderkey").select(
        k.alias("ring_id"), (2 * c + r % 2).alias("X"), (3 * r).alias("Y")
    )
    X, Y = F.col("X"), F.col("Y")
    corners = ((0, 2), (1, 1), (1, -1), (0, -2), (-1, -1), (-1, 1))
    items = [F.struct(F.lit(float(s)).alias("s"), (X + a).alias("vx"), (Y + b).alias("vy")) for s, (a, b) in enumerate(corners)]
    d = d.select("ring_id", "X", "Y", F.inline(F.array(*items)))
    vx, vy, s = F.col("vx"), F.col("vy"), F.col("s")
    # the cell left of a turned bond loses its lower atom, the right one its upper
    drop = ((s == 2) & _turned(vx, vy + 2)) | ((s == 5) & _turned(vx, vy))
    d = d.filter(~drop)
    # the cells above and below gain the other atom of the bond
    extra = F.when((s == 3) & _turned(vx, vy), F.struct(F.lit(2.5).alias("s"), vx.alias("vx"), (vy - 2).alias("vy")))
    extra = extra.when((s == 0) & _turned(vx, vy + 2), F.struct(F.lit(5.5).alias("s"), vx.alias("vx"), (vy + 2).alias("vy")))
    own = F.struct(s.alias("s"), vx.alias("vx"), vy.alias("vy"))
    d = d.select("ring_id", F.inline(F.array_compact(F.array(own, extra))))
    from pyspark.sql import Window as W

    seq = F.row_number().over(W.partitionBy("ring_id").orderBy("s")) - 1
    return d.select(F.lit(0).alias("view"), "ring_id", seq.cast("long").alias("seq"), _atom_id(vx, vy).alias("atom_id"))


def mesh_atoms(spark: SparkSession, sf: str, rings: DataFrame | None = None) -> DataFrame:
    """(view, atom_id, x, y, z, weight): bond length 1, turned bonds lie flat. ``rings`` are
    the ``mesh_rings`` where they are written already."""
    a = (mesh_rings(spark, sf) if rings is None else rings).select("atom_id").distinct()
    vx, vy = F.col("atom_id") % 100000 - 10, F.floor(F.col("atom_id") / 100000) - 10
    a = a.select("atom_id", vx.alias("vx"), vy.alias("vy"))
    vx, vy = F.col("vx"), F.col("vy")
    up, low = _turned(vx, vy), _turned(vx, vy + 2)
    x = vx * F.lit(0.8660254037844386) + F.when(up, -0.5).when(low, 0.5).otherwise(0.0)
    y = (vy + F.when(up, -1).when(low, 1).otherwise(0)) * F.lit(0.5)
    return a.select(
        F.lit(0).alias("view"), "atom_id", x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"),
        (F.lit(1.0) + (F.col("atom_id") % 7) / F.lit(10.0)).alias("weight"),
    )


def mesh_bonds(spark: SparkSession, sf: str, rings: DataFrame | None = None) -> DataFrame:
    """(view, a, b) with a < b: consecutive corners of the rings (``rings`` as above)."""
    from honeyframe.operators.topology import ring_edges

    return ring_edges(mesh_rings(spark, sf) if rings is None else rings).select("view", "a", "b").distinct()


# -- patches around one bond ---------------------------------------------------------
#
# Every order is a patch: a bond between atoms 0 and 1 with a ring on each side and
# one (even orders) or two (odd orders) rings at each end. Ring sizes follow from the
# customer, so that some patches are defects and others are not.


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    """(ring_id, k, atoms): the rings of order k, a row each."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    two = k % 2 == 1
    up, down = F.lit(5) + (c % 4 == 0).cast("int"), F.lit(5) + (c % 5 == 0).cast("int")
    third_a, third_b = F.when(two, 2).otherwise(20), F.when(two, 3).otherwise(10)
    rings = [  # first atoms, number of the next one, size
        ([F.lit(0), F.lit(1)], 10, up),
        ([F.lit(1), F.lit(0)], 20, down),
        ([up + 7, F.lit(0), third_a], 30, 5 + c % 4),
        ([down + 17, F.lit(1), third_b], 40, 5 + F.floor(c / 4) % 4),
        ([F.lit(2), F.lit(0), F.lit(20)], 50, F.when(two, 5 + F.floor(c / 2) % 3).otherwise(0)),
        ([F.lit(3), F.lit(1), F.lit(10)], 60, F.when(two, 5 + F.floor(c / 3) % 3).otherwise(0)),
    ]
    items = [
        F.struct(F.lit(r).alias("r"), F.slice(F.concat(
            F.array(*[h.cast("long") for h in head]), F.sequence(F.lit(rest).cast("long"), F.lit(rest + 9).cast("long"))
        ), 1, size.cast("int")).alias("atoms"))
        for r, (head, rest, size) in enumerate(rings)
    ]
    d = table(spark, sf, "orders").select(k.alias("k"), F.inline(F.array(*items)))
    return d.select((F.col("k") * 10 + F.col("r")).alias("ring_id"), "k", "atoms")


def _patch_corners(rings: DataFrame) -> DataFrame:
    d = rings.select("ring_id", "k", F.posexplode("atoms").alias("seq", "atom"))
    return d.select(F.lit(0).alias("view"), "ring_id", F.col("seq").cast("long").alias("seq"), (F.col("k") * 100 + F.col("atom")).alias("atom_id"))


def patch_rings(spark: SparkSession, sf: str, parts: int | None = None) -> DataFrame:
    """(view, ring_id, seq, atom_id): atoms are order * 100 and a number, rings order * 10.
    With ``parts`` the rings are dealt to so many hash partitions before they become corners."""
    rings = _patches(spark, sf)
    return _patch_corners(rings if parts is None else rings.repartition(parts, "ring_id"))


def patch_atoms(spark: SparkSession, sf: str) -> DataFrame:
    a = patch_rings(spark, sf).select("view", "atom_id").distinct()
    n = F.col("atom_id") % 100
    return a.select("view", "atom_id", (n * 1.5).alias("x"), (n * 7 % 13 * 0.5).alias("y"), F.lit(0.0).alias("z"))
