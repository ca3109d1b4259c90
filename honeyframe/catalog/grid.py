"""Queries on coordinates and rasters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from honeyframe import fixtures as X
from honeyframe.catalog import query
from honeyframe.catalog.views import HX, PT, PX, SYM12, r6 as S6, with_, wrap_home
from honeyframe.functions import hexgrid as H, lattice as L
from honeyframe.functions.numbers import r6
from honeyframe.operators import geometry as G


def _lint(*cols):
    return [F.col(c).cast("long").alias(c) for c in cols]


@query("to_cube", with_(PT, body="""
SELECT id, q, r, x, -x - z AS y, z, x + (z - z % 2) // 2 AS q2 FROM (
 SELECT id, q, r, q - (r - r % 2) // 2 AS x, r AS z FROM (
  SELECT id, CAST(floor(x) AS BIGINT) AS q, CAST(floor(y) AS BIGINT) AS r FROM pt))"""))
def to_cube(spark, sf):
    p = X.pt(spark, sf).select("id", F.floor("x").alias("q"), F.floor("y").alias("r"))
    p = p.withColumn("c", H.to_cube("q", "r"))
    return p.select(
        "id", "q", "r", "c.x", "c.y", "c.z", H.from_cube("c.x", "c.z")["q"].alias("q2")
    )


@query("hex_wrap", with_(PT, "p AS (SELECT id, CAST(floor(x) AS BIGINT) - 50 AS x, "
       "CAST(floor(y) AS BIGINT) - 50 AS z FROM pt)",
       body=f"SELECT id, wx, -wx - wz AS wy, wz FROM ({wrap_home('p', 20, 'id')})"))
def hex_wrap(spark, sf):
    p = X.pt(spark, sf).select(
        "id", (F.floor("x") - 50).alias("wx"), (F.floor("y") - 50).alias("wz")
    )
    p = p.withColumn("wy", -F.col("wx") - F.col("wz"))
    return H.with_wrap(p, 20, "wx", "wy", "wz").select("id", *_lint("wx", "wy", "wz"))


@query("in_hexagon", with_(PX, body="""
SELECT frame_id, q, r, x >= -3 AND x < 3 AND y > -3 AND y <= 3 AND z >= -3 AND z < 3 AS half_open,
       abs(x) + abs(y) + abs(z) <= 6 AS closed
FROM (SELECT *, -x - z AS y FROM (
  SELECT frame_id, q, r, q - (r - r % 2) // 2 - 2 AS x, r - 4 AS z FROM px))"""))
def in_hexagon(spark, sf):
    return X.px(spark, sf).select(
        "frame_id", "q", "r",
        H.in_hexagon("q", "r", (4, 4), 3).alias("half_open"),
        H.in_hexagon("q", "r", (4, 4), 3, full=True).alias("closed"),
    )


@query("hex_distance", with_(HX, body="""
SELECT frame_id, q, r, (abs(x) + abs(y) + abs(z)) // 2 AS ring, x * x + z * z + x * z AS sq FROM hx"""))
def hex_distance(spark, sf):
    return X.hx(spark, sf).select(
        "frame_id", "q", "r",
        H.hex_distance("x", "y", "z").alias("ring"), H.sq_distance("x", "z").alias("sq"),
    )


@query("periodic_sqdist", with_(PT, "p AS (SELECT id, CAST(floor(x) AS BIGINT) - 50 AS x, "
       "CAST(floor(y) AS BIGINT) - 50 AS z FROM pt)",
       body=f"SELECT id, wx * wx + wz * wz + wx * wz AS sq FROM ({wrap_home('p', 16, 'id')})"))
def periodic_sqdist(spark, sf):
    p = X.pt(spark, sf).select(
        "id", (F.floor("x") - 50).alias("x"), (F.floor("y") - 50).alias("z")
    ).withColumn("y", -F.col("x") - F.col("z"))
    return H.with_wrap(p, 16).select("id", H.sq_distance("x", "z").cast("long").alias("sq"))


@query("hex_index", with_(HX, body="SELECT frame_id, x, z, hp FROM hx"))
def hex_index(spark, sf):
    return X.hx(spark, sf).select("frame_id", "x", "z", "hp")


# Fixed lattice of the checks: edge length, tilt, excentricity, phi, origin.
_LAT = dict(hel=1.37, tilt=0.21, excent=1.06, phi=0.4, off_x=50.3, off_y=49.1)


def _with_lattice(df):
    return df.withColumns({k: F.lit(v) for k, v in _LAT.items()})


def _lat_sql(src: str = "pt", bond: int = 2) -> str:
    """The same numbers through explicit distorted basis vectors."""
    hel, t, e, ph = _LAT["hel"], _LAT["tilt"], _LAT["excent"], _LAT["phi"]

    def vec(length, ang):
        vx, vy = length * math.cos(ang), length * math.sin(ang)
        u = vx * math.cos(ph) - vy * math.sin(ph)
        v = (-vx * math.sin(ph) - vy * math.cos(ph)) * e
        return u * math.cos(ph) - v * math.sin(ph), -u * math.sin(ph) - v * math.cos(ph)

    def coords(v1, v2):
        det = v1[0] * v2[1] - v1[1] * v2[0]
        return (
            f"({v2[1]!r} * dx - {v2[0]!r} * dy) / {det!r}",
            f"({v1[0]!r} * dy - {v1[1]!r} * dx) / {det!r}",
        )

    la, lp = 3 * bond * hel, math.sqrt(3) * hel
    a1, a2 = coords(vec(la, -t - math.pi / 6), vec(la, -t + math.pi / 6))
    p1, p2 = coords(vec(lp, -t), vec(lp, -t + math.pi / 3))
    return (
        f"lat AS (SELECT *, {a1} AS a1, {a2} AS a2, {p1} AS p1, {p2} AS p2 FROM "
        f"(SELECT *, x - {_LAT['off_x']} AS dx, y - {_LAT['off_y']} AS dy FROM {src}))"
    )


@query("lattice_coords", with_(PT, _lat_sql(), body=
       f"SELECT id, {S6('a1')} AS a1, {S6('a2')} AS a2, {S6('p1')} AS p1, {S6('p2')} AS p2 FROM lat"))
def lattice_coords(spark, sf):
    d = L.with_lattice_coords(_with_lattice(X.pt(spark, sf)), bond=2)
    return d.select("id", *[r6(c).alias(c) for c in ("a1", "a2", "p1", "p2")])


@query("hex_round", with_(PT, _lat_sql(), body="""
SELECT id, x0 + dx + (z0 + dz - (z0 + dz) % 2) // 2 AS q, z0 + dz AS r FROM (
 SELECT *, row_number() OVER (PARTITION BY id ORDER BY
   (p1 - x0 - dx) ** 2 + (p2 - z0 - dz) ** 2 + (p1 - x0 - dx) * (p2 - z0 - dz)) AS k
 FROM (SELECT id, p1, p2, CAST(floor(p1) AS BIGINT) AS x0, CAST(floor(p2) AS BIGINT) AS z0 FROM lat),
      (SELECT a AS dx, b AS dz FROM range(2) t(a), range(2) u(b)) c) WHERE k = 1""".replace(
          "(z0 + dz - (z0 + dz) % 2) // 2", "((z0 + dz) >> 1)")))
def hex_round(spark, sf):
    d = L.with_lattice_coords(_with_lattice(X.pt(spark, sf)), bond=2)
    return H.with_hex_round(d, "p1", "p2").select("id", *_lint("q", "r"))


_T_ROT = """CASE rot WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN z WHEN 3 THEN -x WHEN 4 THEN y ELSE -z END"""
_T_ROTY = """CASE rot WHEN 0 THEN y WHEN 1 THEN -z WHEN 2 THEN x WHEN 3 THEN -y WHEN 4 THEN z ELSE -x END"""
# every pixel of the frame under the twelve copies, not yet folded home
ORBIT_RAW = SYM12 + f""",
rot AS (SELECT frame_id, grp, hp, value, sym, x, y, z, {_T_ROT} AS rx, {_T_ROTY} AS ry, mirror FROM hx, sym),
raw AS (SELECT *, CASE WHEN mirror = 1 THEN ry ELSE -rx - ry END AS rz FROM rot)"""
ORBIT = (
    ORBIT_RAW
    + f""",
orb0 AS ({wrap_home('raw', 4, 'frame_id, grp, hp, value, sym', 'rx', 'rz')}),
grid AS (SELECT DISTINCT x AS gx, z AS gz, hp AS gp FROM hx),
orbit AS (SELECT frame_id, grp, hp, value, sym, gp AS hp_to FROM orb0 JOIN grid ON wx = gx AND wz = gz)"""
)


@query("hex_transform", with_(HX, ORBIT, body="SELECT frame_id, hp, sym, hp_to, hp AS hp_back FROM orbit"))
def hex_transform(spark, sf):
    d = X.hx(spark, sf).select("frame_id", "hp", "x", "z")
    d = d.select("*", F.inline(H.symmetry_array(4, 4)))
    d = H.with_transform(d, 4)
    d = H.with_inverse_transform(d, 4, x="tx", z="tz", out=("bx", "bz"))
    return d.select(
        "frame_id", "hp", F.col("sym").cast("long").alias("sym"),
        H.hex_index("tx", "tz", 4).alias("hp_to"), H.hex_index("bx", "bz", 4).alias("hp_back"),
    )


@query("hex_view", with_(PX, body="""
SELECT frame_id, sx, sy, coalesce(value, 0) AS value FROM (
 SELECT f.frame_id, v.sx, v.sy, v.q, v.r FROM (SELECT DISTINCT frame_id FROM px) f, (
  SELECT sx, sy, x0 + dx + ((z0 + dz) >> 1) AS q, z0 + dz AS r FROM (
   SELECT *, row_number() OVER (PARTITION BY sx, sy ORDER BY
     (p1 - x0 - dx) ** 2 + (p2 - z0 - dz) ** 2 + (p1 - x0 - dx) * (p2 - z0 - dz)) AS k
   FROM (SELECT *, CAST(floor(p1) AS BIGINT) AS x0, CAST(floor(p2) AS BIGINT) AS z0 FROM (
     SELECT sx, sy, sy / (1.07 * sqrt(3) / 2) AS p2, sx / 1.07 - (sy / (1.07 * sqrt(3) / 2)) / 2 AS p1
     FROM (SELECT CAST(i % 9 AS BIGINT) AS sx, CAST(i // 9 AS BIGINT) AS sy FROM range(81) t(i)))),
    (SELECT a AS dx, b AS dz FROM range(2) t(a), range(2) u(b)) c) WHERE k = 1) v) w
LEFT JOIN (SELECT frame_id, q, r, value FROM px) s USING (frame_id, q, r)"""))
def hex_view(spark, sf):
    d = G.hex_view(X.px(spark, sf), 9, 9, pitch=1.07)
    return d.select("frame_id", *_lint("sx", "sy", "value"))


@query("clone_area", with_(PX, body="""
SELECT frame_id, p.q, p.r, CASE WHEN x >= -2 AND x < 2 AND -x - z > -2 AND -x - z <= 2 AND z >= -2 AND z < 2
   AND NOT (p.q = 4 AND p.r = 4) THEN value ELSE bg END AS value
FROM (SELECT *, q - (r - r % 2) // 2 - 2 AS x, r - 4 AS z FROM px) p
JOIN (SELECT q, r, max(value) AS bg FROM px GROUP BY q, r) b USING (q, r)"""))
def clone_area(spark, sf):
    p = X.px(spark, sf)
    bg = p.groupBy("q", "r").agg(F.max("value").alias("value"))
    return G.clone_area(p, bg, (4, 4), 2, blank_center=True)


@query("polygon_filter", with_(PT, body="""
SELECT id, px, pz FROM (SELECT id, CAST(floor(x) AS BIGINT) AS px, CAST(floor(y) AS BIGINT) AS pz FROM pt)
WHERE 60 * (px - 10) - 10 * (pz - 10) > 0 AND 10 * (px - 20) + 60 * (pz - 70) < 780 - 0 * px
  AND -70 * (px - 80) + 10 * (pz - 60) > 0 AND -20 * (px - 90) * 1.0 + 80 * (pz + 10) * 1.0 > 0""".replace(
      "10 * (px - 20) + 60 * (pz - 70) < 780 - 0 * px", "10 * (px - 20) + 60 * (pz - 70) < 0").replace(
      "-70 * (px - 80) + 10 * (pz - 60) > 0", "70 * (px - 80) + 10 * (pz - 60) < 0").replace(
      "-20 * (px - 90) * 1.0 + 80 * (pz + 10) * 1.0 > 0", "20 * (px - 90) + 80 * (pz + 10) > 0")))
def polygon_filter(spark, sf):
    p = X.pt(spark, sf).select("id", F.floor("x").alias("px"), F.floor("y").alias("pz"))
    return G.polygon_filter(p, [(10, 10), (20, 70), (80, 60), (90, -10)], "px", "pz")


@query("mask_filter", with_(PX, body="""
, c AS (SELECT frame_id, q - (r - r % 2) // 2 AS x, r AS z, mask FROM px),
k AS (SELECT frame_id, x, z, x + dx AS cx, z + dz AS cz FROM c,
  (VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)) s(dx, dz))
SELECT k.frame_id, k.x, k.z FROM k LEFT JOIN c ON c.frame_id = k.frame_id AND c.x = cx AND c.z = cz
GROUP BY ALL HAVING bool_and(coalesce(c.mask = 1, FALSE))""".lstrip()))
def mask_filter(spark, sf):
    p = H.with_cube(X.px(spark, sf), "q", "r").select(
        "frame_id", "x", "z", (F.col("mask") == 1).cast("int").alias("value")
    )
    return G.mask_filter(p, p, 1)


@query("site_number", with_(HX, "b AS (SELECT frame_id, hp, x, z FROM hx)", f"w AS ({wrap_home('b', 2, 'frame_id, hp')})",
       "c AS (SELECT frame_id, hp, [wx, -wz, -wx - wz, -wx, wz, wx + wz] AS t, greatest(abs(wx), abs(wz), abs(wx + wz)) AS d FROM w)",
       "k AS (SELECT *, list_position(t, d) AS k FROM c)", body="""
SELECT frame_id, hp, CASE WHEN d = 0 THEN 0 ELSE (1 + 3 * d * (d - 1) + (k - 1) * d + t[k % 6 + 1] - CASE WHEN d = 2 AND k BETWEEN 2 AND 4 THEN 3 ELSE 0 END + 24) % 12 END AS number FROM k"""))
def site_number(spark, sf):
    d = H.with_wrap(X.hx(spark, sf), 2)
    return d.select("frame_id", "hp", H.site_number("x", "y", "z", 2).alias("number"))


@query("level_intensity", with_(PX, body="""
SELECT DISTINCT value, CAST(least(15, greatest(0, round((value - 0.5) / (10.0 - 0.5) * 15))) AS BIGINT) AS level,
  round(0.5 + (10.0 - 0.5) * least(15, greatest(0, round((value - 0.5) / (10.0 - 0.5) * 15))) / 15, 6) AS back
FROM px"""))
def level_intensity(spark, sf):
    from honeyframe.functions import tables as T

    d = X.px(spark, sf).select("value").distinct()
    d = d.withColumn("level", T.intensity_to_level("value", 0.5, 10.0, 16))
    return d.withColumn("back", r6(T.level_to_intensity("level", 0.5, 10.0, 16)))


@query("ellipse_radius", with_(PT, body="""
SELECT id, round(5.0 * 3.0 / sqrt((3.0 * cos(x / 16 - 0.3)) ** 2 + (5.0 * sin(x / 16 - 0.3)) ** 2), 6) AS radius
FROM pt"""))
def ellipse_radius(spark, sf):
    return X.pt(spark, sf).select(
        "id",
        r6(L.ellipse_radius(F.col("x") / 16, F.lit(5.0), F.lit(3.0), F.lit(0.3))).alias("radius"),
    )


@query("bilinear_shares", with_(PT, body="""
SELECT px, py, round(sum(share), 6) AS share FROM (
 SELECT CAST(floor(x) AS BIGINT) + dx AS px, CAST(floor(y) AS BIGINT) + dy AS py,
   w * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END)
     * (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS share
 FROM pt, (SELECT a AS dx, b AS dy FROM range(2) t(a), range(2) u(b)) c) GROUP BY px, py"""))
def bilinear_shares(spark, sf):
    d = G.bilinear_shares(X.pt(spark, sf))
    return d.select(*_lint("px", "py"), r6("share").alias("share"))


@query("site_class", with_(HX, "b AS (SELECT frame_id, hp, x, z FROM hx)",
       f"w AS ({wrap_home('b', 2, 'frame_id, hp')})", body="""
SELECT frame_id, hp, CASE m WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 + k END AS wedge FROM (
 SELECT frame_id, hp, greatest(abs(wx), abs(wz), abs(wx + wz)) AS m,
   least(abs(wx), abs(wz), abs(wx + wz)) AS k FROM w)"""))
def site_class(spark, sf):
    d = H.with_wrap(X.hx(spark, sf), 2)
    return d.select("frame_id", "hp", H.site_class("x", "y", "z", 2).alias("wedge"))
