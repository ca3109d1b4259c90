"""Queries on lattice search and sub-frames."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from honeyframe import fixtures as X
from honeyframe.catalog import query
from honeyframe.catalog.frames import _PAR, RES, params, square
from honeyframe.catalog.report import RPX, report_rows
from honeyframe.catalog.views import PT, PX, r6 as S6, with_
from honeyframe.functions.numbers import r6
from honeyframe.operators import lattice as Q


@query("candidate_grid", with_(RPX, body=f"""
SELECT frame_id, cand, {S6('hel * (1 + 0.02 * i / 2)')} AS hel, {S6('tilt + pi() / 90 * j / 2')} AS tilt, abs(i) = 2 OR abs(j) = 2 AS edge FROM (
 SELECT frame_id, hel, tilt, c AS cand, CASE WHEN c = 0 THEN 0 ELSE (c - 1) // 5 - 2 END AS i, CASE WHEN c = 0 THEN 0 ELSE (c - 1) % 5 - 2 END AS j FROM rpx, range(26) t(c))"""))
def candidate_grid(spark, sf):
    d = report_rows(spark, sf).withColumns({"excent": F.col("ellA") / F.col("ellB"), "phi": F.col("ellPhi")})
    g = Q.candidate_grid(d.select("frame_id", "hel", "tilt", "excent", "phi"), 0, 1, 2)
    return g.select("frame_id", F.col("cand").cast("long"), r6("hel").alias("hel"), r6("tilt").alias("tilt"), "edge")


def _cand_sql():
    t, ph, e = _PAR["tilt"], _PAR["phi"], _PAR["excent"]
    dt = math.pi / 90

    def vec(ang):
        a = f"(-({t} + {dt!r}::DOUBLE * j) + {ang!r}::DOUBLE)"
        u = f"(cos({a}) * {math.cos(ph)!r} - sin({a}) * {math.sin(ph)!r})"
        v = f"((-cos({a}) * {math.sin(ph)!r} - sin({a}) * {math.cos(ph)!r}) * {e})"
        return (f"len * ({u} * {math.cos(ph)!r} - {v} * {math.sin(ph)!r})", f"len * (-{u} * {math.sin(ph)!r} - {v} * {math.cos(ph)!r})")

    ux, uy = vec(-math.pi / 6)
    vx, vy = vec(math.pi / 6)
    inside = " AND ".join(
        f"((c1 + {a}) * ux + (c2 + {b}) * vx + ox) >= 0 AND ((c1 + {a}) * ux + (c2 + {b}) * vx + ox) < 8 AND ((c1 + {a}) * uy + (c2 + {b}) * vy + oy) >= 0 AND ((c1 + {a}) * uy + (c2 + {b}) * vy + oy) < 8"
        for a in (0, 1) for b in (0, 1))
    return with_(PX, f"""
cd AS (SELECT frame_id, c AS cand, 6 * ({_PAR['hel']}::DOUBLE + (frame_id % 5) * 0.01::DOUBLE) * (1 + 0.02::DOUBLE * i) AS len, j, {_PAR['off_x']}::DOUBLE AS ox, {_PAR['off_y']}::DOUBLE AS oy FROM (SELECT DISTINCT frame_id FROM px),
  (SELECT c, CASE WHEN c = 0 THEN 0 ELSE (c - 1) // 3 - 1 END AS i, CASE WHEN c = 0 THEN 0 ELSE (c - 1) % 3 - 1 END AS j FROM range(10) t(c))),
bs AS (SELECT frame_id, cand, ox, oy, {ux} AS ux, {uy} AS uy, {vx} AS vx, {vy} AS vy FROM cd),
fr AS (SELECT b.*, value, mask, (vy * dx - vx * dy) / (ux * vy - uy * vx) AS f1, (ux * dy - uy * dx) / (ux * vy - uy * vx) AS f2 FROM (SELECT frame_id, value, mask, q + 0.5::DOUBLE - {_PAR['off_x']} AS dx, r + 0.5::DOUBLE - {_PAR['off_y']} AS dy FROM px) p JOIN bs b USING (frame_id)),
ce AS (SELECT *, floor(f1) AS c1, floor(f2) AS c2 FROM fr),
hi AS (SELECT frame_id, cand, c1, c2, floor((f1 - c1) * {RES}) AS i, floor((f2 - c2) * {RES}) AS j, value, bool_or(mask <> 1) OVER (PARTITION BY frame_id, cand, c1, c2) AS bad FROM ce WHERE {inside}),
bn AS (SELECT frame_id, cand, i, j, sum(value) AS v FROM hi WHERE NOT bad GROUP BY ALL)""", body=f"""
SELECT frame_id, cand, {S6(f'500 * sqrt(sum(v * v) / {RES * RES} - (sum(v) / {RES * RES}) ** 2) / nullif(sum(v) / {RES * RES}, 0)')} AS contrast FROM bn GROUP BY ALL""")


@query("score_candidates", _cand_sql())
def score_candidates(spark, sf):
    g = Q.candidate_grid(params(spark, sf), 0, 1, 1)
    d = Q.score_candidates(square(spark, sf), g, 2, RES, 8, 8, shape=False)
    return d.select("frame_id", F.col("cand").cast("long"), r6("contrast").alias("contrast"))


@query("coarse_to_fine")
def coarse_to_fine(spark, sf):
    return Q.coarse_to_fine(square(spark, sf), params(spark, sf), 2, RES, 8, 8)


@query("coordinate_refine")
def coordinate_refine(spark, sf):
    return Q.coordinate_refine(square(spark, sf), params(spark, sf), 2, RES, 8, 8)


def _recenter_sql():
    t, ph, e = "tilt", '"ellPhi"', '("ellA" / "ellB")'

    def vec(ang):
        a = f"(-{t} + {ang!r}::DOUBLE)"
        u = f"(cos({a}) * cos({ph}) - sin({a}) * sin({ph}))"
        v = f"((-cos({a}) * sin({ph}) - sin({a}) * cos({ph})) * {e})"
        return f"6 * hel * ({u} * cos({ph}) - {v} * sin({ph}))", f"6 * hel * (-{u} * sin({ph}) - {v} * cos({ph}))"

    ux, uy = vec(-math.pi / 6)
    vx, vy = vec(math.pi / 6)
    return with_(RPX, f"""
b AS (SELECT frame_id, "offX" AS ox, "offY" AS oy, 300.37::DOUBLE - "offX" AS dx, 280.11::DOUBLE - "offY" AS dy, {ux} AS ux, {uy} AS uy, {vx} AS vx, {vy} AS vy FROM rpx),
n AS (SELECT *, floor((vy * dx - vx * dy) / (ux * vy - uy * vx) + 0.5) AS n1, floor((ux * dy - uy * dx) / (ux * vy - uy * vx) + 0.5) AS n2 FROM b)""", body=f"""
SELECT frame_id, {S6('ox + n1 * ux + n2 * vx')} AS off_x, {S6('oy + n1 * uy + n2 * vy')} AS off_y FROM n""")


@query("recenter_offset", _recenter_sql())
def recenter_offset(spark, sf):
    d = report_rows(spark, sf).select(
        "frame_id", "hel", "tilt", (F.col("ellA") / F.col("ellB")).alias("excent"), F.col("ellPhi").alias("phi"),
        F.col("offX").alias("off_x"), F.col("offY").alias("off_y"), F.lit(300.37).alias("clean_x"), F.lit(280.11).alias("clean_y"),
    )
    return Q.recenter_offset(d, 2).select("frame_id", r6("off_x").alias("off_x"), r6("off_y").alias("off_y"))


_HEX = dict(hel=0.83, tilt=0.21, excent=1.04, phi=0.4, off_x=3.77, off_y=4.13)


def _sample_sql():
    t, ph, e = _HEX["tilt"], _HEX["phi"], _HEX["excent"]

    def vec(ang):
        length = math.sqrt(3) * _HEX["hel"]
        vx, vy = math.cos(-t + ang), math.sin(-t + ang)
        u, v = vx * math.cos(ph) - vy * math.sin(ph), (-vx * math.sin(ph) - vy * math.cos(ph)) * e
        return length * (u * math.cos(ph) - v * math.sin(ph)), length * (-u * math.sin(ph) - v * math.cos(ph))

    (ux, uy), (vx, vy) = vec(0.0), vec(math.pi / 3)
    det = ux * vy - uy * vx
    corners = [(1 / 3, 1 / 3), (-1 / 3, 2 / 3), (-2 / 3, 1 / 3), (-1 / 3, -1 / 3), (1 / 3, -2 / 3), (2 / 3, -1 / 3)]
    out = " OR ".join(
        f"{_HEX['off_x']} + (hx_ + {a!r}) * {ux!r} + (hz + {b!r}) * {vx!r} NOT BETWEEN 0 AND 8 OR {_HEX['off_y']} + (hx_ + {a!r}) * {uy!r} + (hz + {b!r}) * {vy!r} NOT BETWEEN 0 AND 8"
        for a, b in corners)
    return with_(PX, f"""
sp AS (SELECT frame_id, q, r, value, mask, i, j, q + (i + 0.5::DOUBLE) / 3 - {_HEX['off_x']} AS dx, r + (j + 0.5::DOUBLE) / 3 - {_HEX['off_y']} AS dy FROM px, range(3) a(i), range(3) b(j)),
fc AS (SELECT *, ({vy!r}::DOUBLE * dx - {vx!r}::DOUBLE * dy) / {det!r} AS p1, ({ux!r}::DOUBLE * dy - {uy!r}::DOUBLE * dx) / {det!r} AS p2 FROM sp),
nr AS (SELECT *, CAST(floor(p1) AS BIGINT) + a AS hx_, CAST(floor(p2) AS BIGINT) + b AS hz, row_number() OVER (PARTITION BY frame_id, q, r, i, j ORDER BY
  (p1 - floor(p1) - a) ** 2 + (p2 - floor(p2) - b) ** 2 + (p1 - floor(p1) - a) * (p2 - floor(p2) - b)) AS k FROM fc, range(2) u(a), range(2) v(b)),
hg AS (SELECT frame_id, hx_, hz, sum(CASE WHEN mask = 1 THEN value ELSE 0 END) AS v, count(*) AS points, max(mask) AS m FROM nr WHERE k = 1 GROUP BY ALL)""", body=f"""
SELECT frame_id, hx_ + (hz >> 1) AS q, hz AS r, {S6('v / 9.0::DOUBLE')} AS value, CASE WHEN {out} THEN 32 ELSE m END AS mask, points FROM hg""")


@query("sample_hexagons", _sample_sql())
def sample_hexagons(spark, sf):
    p = X.px(spark, sf).select("frame_id").distinct().withColumns({k: F.lit(v) for k, v in _HEX.items()})
    d = Q.sample_hexagons(square(spark, sf), p, 8, 8, sub=3)
    return d.select("frame_id", F.col("q").cast("long"), F.col("r").cast("long"), r6("value").alias("value"),
                    F.col("mask").cast("long"), "points")


_SCAN = """c AS (SELECT frame_id, q - (r - r % 2) // 2 AS x, r AS z, mask FROM px),
foot AS (SELECT a AS dx, b AS dz FROM range(-2, 2) t(a), range(-2, 2) u(b) WHERE a + b >= -2 AND a + b < 2),
fp AS (SELECT c.frame_id, c.x, c.z, count(o.mask) FILTER (o.mask = 1) AS clean, count(o.mask) FILTER (o.mask = 4) AS light FROM c, foot
  LEFT JOIN c o ON o.frame_id = c.frame_id AND o.x = c.x + dx AND o.z = c.z + dz GROUP BY ALL),
cand AS (SELECT frame_id, x, z FROM fp WHERE clean = 12)"""


@query("scan_subframes", with_(PX, _SCAN, body="SELECT frame_id, x, z FROM cand"))
def scan_subframes(spark, sf):
    return Q.scan_subframes(X.px(spark, sf), 2, None, border=1)


@query("scan_subframes_light", with_(PX, _SCAN, body="SELECT frame_id, x, z FROM fp WHERE clean + light = 12 AND light / 12.0 BETWEEN 0.05 AND 0.3"))
def scan_subframes_light(spark, sf):
    return Q.scan_subframes(X.px(spark, sf), 2, None, border=1, light=(0.05, 0.3))


@query("best_tiling_offset", with_(PX, _SCAN, """
k AS (SELECT frame_id, ((2 * x + z) // 3 % 2 + 2) % 2 AS dx, ((x + 2 * z) // 3 % 2 + 2) % 2 AS dz, count(*) AS n FROM cand WHERE (2 * x + z) % 3 = 0 AND (x + 2 * z) % 3 = 0 GROUP BY ALL)""", body="""
SELECT frame_id, arg_max(dx, (n, -dx, -dz)) AS dx, arg_max(dz, (n, -dx, -dz)) AS dz, max(n) AS n FROM k GROUP BY frame_id"""))
def best_tiling_offset(spark, sf):
    c = Q.scan_subframes(X.px(spark, sf), 2, 1, border=1)
    return Q.best_tiling_offset(c, 4, 1)


def _grid_points(spark, sf):
    p = X.pt(spark, sf)
    return p.select((F.col("id") % 3).alias("frame_id"), F.floor("x").alias("x"), F.floor("y").alias("z")).distinct()


_GP = "gp AS (SELECT DISTINCT id % 3 AS frame_id, CAST(floor(x) AS BIGINT) AS x, CAST(floor(y) AS BIGINT) AS z FROM pt)"
_PAIRS = """pr AS (SELECT a.frame_id, a.x, a.z, b.x AS x2, b.z AS z2 FROM gp a JOIN gp b ON b.frame_id = a.frame_id AND (a.x, a.z) < (b.x, b.z)
  AND b.x BETWEEN a.x - 4 AND a.x + 4 AND abs(a.x - b.x) + abs(a.z - b.z) + abs(a.x - b.x + a.z - b.z) < 8)"""


@query("conflict_pairs", with_(PT, _GP, _PAIRS, body="SELECT * FROM pr"))
def conflict_pairs(spark, sf):
    return Q.conflict_pairs(_grid_points(spark, sf), 4)


@query("conflict_counts", with_(PT, _GP, _PAIRS, body="""
SELECT g.frame_id, g.x, g.z, count(p.x) AS conflicts FROM gp g LEFT JOIN (SELECT frame_id, x, z FROM pr UNION ALL SELECT frame_id, x2, z2 FROM pr) p
 ON p.frame_id = g.frame_id AND p.x = g.x AND p.z = g.z GROUP BY ALL"""))
def conflict_counts(spark, sf):
    g = _grid_points(spark, sf)
    return Q.conflict_counts(g, Q.conflict_pairs(g, 4))


@query("greedy_tiling")
def greedy_tiling(spark, sf):
    return Q.greedy_tiling(Q.scan_subframes(X.px(spark, sf), 2, 1, border=1), 4, 1)


@query("extract_subframes", with_(PX, _SCAN, """
ct AS (SELECT frame_id, x, z FROM cand WHERE (2 * x + z) % 3 = 0 AND (x + 2 * z) % 3 = 0),
fo AS (SELECT dx, dz, CAST(row_number() OVER (ORDER BY dx, dz) - 1 AS BIGINT) AS hp FROM foot)""", body="""
SELECT ct.frame_id, ct.x AS cx, ct.z AS cz, dx AS x, dz AS z, hp, value FROM ct, fo JOIN (SELECT frame_id, q - (r - r % 2) // 2 AS px_, r AS pz, value FROM px) p
 ON p.frame_id = ct.frame_id AND px_ = ct.x + dx AND pz = ct.z + dz"""))
def extract_subframes(spark, sf):
    c = Q.scan_subframes(X.px(spark, sf), 2, 1, border=1)
    return Q.extract_subframes(X.px(spark, sf), c, 4)


@query("collect_subframes", with_(PX, _SCAN, body="""
SELECT frame_id, x, z, concat(frame_id, '_', x, '_', z) AS label, row_number() OVER (ORDER BY frame_id, x, z) AS slice FROM cand"""))
def collect_subframes(spark, sf):
    c = Q.scan_subframes(X.px(spark, sf), 2, None, border=1)
    c = c.withColumn("label", F.concat_ws("_", "frame_id", "x", "z"))
    parts = [c.filter(F.col("frame_id") % 2 == k) for k in (1, 0)]
    return Q.collect_subframes(parts, ["frame_id", "x", "z"])
