"""Queries on frames, masks, runs and unit cells."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from honeyframe import fixtures as X
from honeyframe.catalog import query
from honeyframe.catalog.views import EV, HX, PT, PX, r6 as S6, with_, wrap_home
from honeyframe.functions import hexgrid as H
from honeyframe.functions.numbers import r6
from honeyframe.operators import pixels as P, runs as R


def _lint(*cols):
    return [F.col(c).cast("long").alias(c) for c in cols]


def square(spark, sf):
    """Stand-in frames as square pixels."""
    return X.px(spark, sf).select(
        "frame_id", F.col("q").alias("x"), F.col("r").alias("y"), "value", "mask"
    )


# -- sparse ----------------------------------------------------------------------

@query("sparse_encode", with_(HX, body="""
SELECT frame_id AS sf_id, value, count(*) AS n, string_agg(CAST(hp AS VARCHAR), ',' ORDER BY hp) AS positions
FROM hx WHERE value > 0 AND frame_id % 7 <> 0 GROUP BY frame_id, value
UNION ALL SELECT DISTINCT frame_id, 0, 0, '' FROM hx WHERE frame_id % 7 = 0 OR frame_id NOT IN (SELECT frame_id FROM hx WHERE value > 0)"""))
def sparse_encode(spark, sf):
    """Every seventh sub-frame is set to zero: it must not vanish."""
    s = X.sf_pixels(spark, sf).select(
        "sf_id", "hp", F.when(F.col("sf_id") % 7 == 0, 0).otherwise(F.col("value")).alias("value")
    )
    return P.sparse_encode(s).withColumn(
        "positions", F.concat_ws(",", F.col("positions").cast("array<string>"))
    )


@query("sparse_decode", with_(HX, body="SELECT frame_id AS sf_id, hp, value FROM hx"))
def sparse_decode(spark, sf):
    return P.sparse_decode(P.sparse_encode(X.sf_pixels(spark, sf)), X.RADIUS)


@query("drop_empty_subframes", with_(HX, """
t AS (SELECT frame_id AS sf_id, hp, CASE WHEN frame_id % 7 = 0 THEN 0 ELSE value END AS value FROM hx)""", body="""
SELECT sf_id, hp, value FROM t WHERE sf_id IN (SELECT sf_id FROM t GROUP BY sf_id HAVING sum(value) <> 0)"""))
def drop_empty_subframes(spark, sf):
    s = X.sf_pixels(spark, sf).select(
        "sf_id", "hp", F.when(F.col("sf_id") % 7 == 0, 0).otherwise(F.col("value")).alias("value")
    )
    return P.drop_empty_subframes(s).select("sf_id", "hp", "value")


@query("count_empty_subframes", with_(HX, body="""
SELECT count(*) FILTER (s = 0) AS empty, count(*) AS total FROM (
 SELECT frame_id, sum(CASE WHEN frame_id % 7 = 0 THEN 0 ELSE value END) AS s FROM hx GROUP BY frame_id)"""))
def count_empty_subframes(spark, sf):
    s = X.sf_pixels(spark, sf).select(
        "sf_id", F.when(F.col("sf_id") % 7 == 0, 0).otherwise(F.col("value")).alias("value")
    )
    return P.count_empty_subframes(s)


# -- neighbours --------------------------------------------------------------------

_NB = """off AS (SELECT a AS dx, b AS dz FROM range(-1, 2) t(a), range(-1, 2) u(b) WHERE abs(a) + abs(b) + abs(a + b) <= 2),
nb0 AS (SELECT frame_id, hp, value, dx, dz, x + dx AS nx, z + dz AS nz FROM hx, off)"""
NB = _NB + f""",
nb AS (SELECT w.frame_id, w.hp, w.value, w.dx, w.dz, h.value AS nv, h.x AS hx_, h.z AS hz_ FROM ({wrap_home('nb0', 4, 'frame_id, hp, value, dx, dz', 'nx', 'nz')}) w
  JOIN hx h ON h.frame_id = w.frame_id AND h.x = wx AND h.z = wz)"""


@query("neighbor_join", with_(HX, NB, body="""
SELECT nb.frame_id, hp, dx, dz, nv FROM nb"""))
def neighbor_join(spark, sf):
    d = P.neighbor_join(X.hx(spark, sf), X.RADIUS, P.offsets_within(1))
    return d.select(
        "frame_id", H.hex_index("x", "z", X.RADIUS).alias("hp"), *_lint("dx", "dz"),
        F.col("value").alias("nv"),
    )


@query("smooth_7", with_(HX, NB, body="""
SELECT frame_id, hp, CAST(floor((sum(nv) + 3) / 7) AS BIGINT) AS value, round(sum(nv) / 7.0, 6) AS mean
FROM nb GROUP BY frame_id, hp"""))
def smooth_7(spark, sf):
    h = X.hx(spark, sf)
    a = P.smooth_7(h, X.RADIUS, integer=True)
    b = P.smooth_7(h, X.RADIUS).withColumnRenamed("value", "mean")
    return a.join(b, ["frame_id", "x", "z"]).select(
        "frame_id", H.hex_index("x", "z", X.RADIUS).alias("hp"), "value", r6("mean").alias("mean")
    )


@query("outlier_filter", with_(HX, NB, body="""
SELECT frame_id, hp, CASE WHEN old - rep >= 2 OR rep - old >= 2 THEN rep ELSE old END AS value FROM (
 SELECT frame_id, hp, any_value(value) AS old, CAST(floor(quantile_disc(nv, 0.5)) AS BIGINT) AS rep FROM nb GROUP BY frame_id, hp)"""))
def outlier_filter(spark, sf):
    d = P.outlier_filter(X.hx(spark, sf), X.RADIUS, threshold=2)
    return d.select("frame_id", H.hex_index("x", "z", X.RADIUS).alias("hp"), F.col("value").cast("long").alias("value"))


@query("outlier_filter_square", with_(PX, """
nb AS (SELECT p.frame_id, p.q, p.r, p.value AS old, o.value AS nv, CASE WHEN o.q = p.q AND o.r = p.r THEN 2 ELSE 1 END AS wt
 FROM px p, (SELECT a AS dx, b AS dy FROM range(-1, 2) t(a), range(-1, 2) u(b)) c JOIN px o
 ON o.frame_id = p.frame_id AND o.q = (p.q + dx + 8) % 8 AND o.r = (p.r + dy + 8) % 8)""", body="""
SELECT frame_id, q, r, CASE WHEN old - rep >= 1 THEN rep ELSE old END AS value FROM (
 SELECT frame_id, q, r, any_value(old) AS old, CAST(floor(sum(nv * wt) / CAST(sum(wt) AS DOUBLE) + 0.5) AS BIGINT) AS rep FROM nb GROUP BY ALL)"""))
def outlier_filter_square(spark, sf):
    p = X.px(spark, sf).select("frame_id", F.col("q").alias("x"), F.col("r").alias("z"), "value")
    d = P.outlier_filter(p, 8, threshold=1, mode="mean", weight=2, dark=False, hexagonal=False)
    return d.select("frame_id", F.col("x").alias("q"), F.col("z").alias("r"), *_lint("value"))


# -- masks ------------------------------------------------------------------------

def _reflect(e):
    return f"CASE WHEN {e} < 0 THEN -({e}) - 1 WHEN {e} >= 8 THEN 15 - ({e}) ELSE {e} END"


def _box_sql(src, cols, h=1):
    """Mirrored box sums of the columns of ``src`` (frame_id, q, r, ...)."""
    sums = ", ".join(f"sum(s.{c}) AS {c}" for c in cols)
    return f"""(SELECT p.frame_id, p.q, p.r, {sums} FROM {src} p,
      (SELECT a AS dx, b AS dy FROM range({-h}, {h + 1}) t(a), range({-h}, {h + 1}) u(b)) c
      JOIN {src} s ON s.frame_id = p.frame_id AND s.q = {_reflect('p.q + dx')} AND s.r = {_reflect('p.r + dy')}
      GROUP BY p.frame_id, p.q, p.r)"""


def _gauss(sigma):
    r = int(4 * sigma + 0.5)
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return r, [v / sum(w) for v in w]


def _blur_sql(sigma):
    r, w = _gauss(sigma)
    k = ", ".join(f"({i - r}, {v!r}::DOUBLE)" for i, v in enumerate(w))
    return f"""bx AS (SELECT p.frame_id, p.q, p.r, sum(s.value * k.w) AS v FROM px p, (VALUES {k}) k(d, w)
    JOIN px s ON s.frame_id = p.frame_id AND s.r = p.r AND s.q = {_reflect('p.q + d')} GROUP BY ALL),
blur AS (SELECT p.frame_id, p.q, p.r, sum(s.v * k.w) AS v FROM bx p, (VALUES {k}) k(d, w)
    JOIN bx s ON s.frame_id = p.frame_id AND s.q = p.q AND s.r = {_reflect('p.r + d')} GROUP BY ALL)"""


@query("gaussian_blur", with_(PX, _blur_sql(0.6), body="SELECT frame_id, q, r, round(v, 6) AS v FROM blur"))
def gaussian_blur(spark, sf):
    d = P.gaussian_blur(square(spark, sf).withColumn("value", F.col("value").cast("double")), 0.6, 8, 8)
    return d.select("frame_id", F.col("x").alias("q"), F.col("y").alias("r"), r6("value").alias("v"))


@query("threshold_mask", with_(PX, _blur_sql(0.6), "t AS (SELECT frame_id, q, r, CASE WHEN v > 2.05 THEN 1 ELSE 0 END AS m FROM blur)",
       body=f"SELECT frame_id, q, r, CASE WHEN m >= 5 THEN 1 ELSE 0 END AS dirt FROM {_box_sql('t', ['m'])}"))
def threshold_mask(spark, sf):
    d = P.threshold_mask(square(spark, sf), 2.05, 3, 8, 8, sigma=0.6)
    return d.select("frame_id", F.col("x").alias("q"), F.col("y").alias("r"), "dirt")


def _square_sql(src, agg, n):
    lo, hi = -(n // 2), n - 1 - n // 2
    return f"""(SELECT p.frame_id, p.q, p.r, {agg}(s.m) AS m FROM {src} p JOIN {src} s ON s.frame_id = p.frame_id
      AND s.q BETWEEN p.q + {lo} AND p.q + {hi} AND s.r BETWEEN p.r + {lo} AND p.r + {hi} GROUP BY ALL)"""


@query("erode_dilate", with_(PX, "t AS (SELECT frame_id, q, r, value AS m FROM px)", body=f"""
SELECT frame_id, q, r, a.m AS eroded, b.m AS dilated FROM {_square_sql('t', 'min', 3)} a
JOIN {_square_sql('t', 'max', 4)} b USING (frame_id, q, r)"""))
def erode_dilate(spark, sf):
    d = square(spark, sf).withColumn("big", F.col("value"))
    d = P.dilate(P.erode(d, 3), 4, "big")
    return d.select("frame_id", F.col("x").alias("q"), F.col("y").alias("r"),
                    F.col("value").alias("eroded"), F.col("big").alias("dilated"))


@query("area_mask", with_(PX, _blur_sql(0.6), """
t AS (SELECT frame_id, q, r, CASE WHEN v > 1.55 THEN 1 ELSE 0 END AS a, CASE WHEN v > 2.45 THEN 1 ELSE 0 END AS b,
  CASE WHEN v > 3.05 THEN 1 ELSE 0 END AS c FROM blur)""",
       f"m AS (SELECT frame_id, q, r, CASE WHEN a >= 5 THEN 1 ELSE 0 END AS a, CASE WHEN b >= 5 THEN 1 ELSE 0 END AS b, CASE WHEN c >= 5 THEN 1 ELSE 0 END AS c FROM {_box_sql('t', ['a', 'b', 'c'])})",
       "ma AS (SELECT frame_id, q, r, a AS m FROM m)", "mc AS (SELECT frame_id, q, r, c AS m FROM m)", body=f"""
SELECT frame_id, q, r, CASE WHEN q < 1 THEN 16 WHEN h.m = 1 THEN 16 WHEN b = 1 THEN 4 ELSE e.m END AS mask
FROM m JOIN {_square_sql('ma', 'min', 2)} e USING (frame_id, q, r) JOIN {_square_sql('mc', 'max', 2)} h USING (frame_id, q, r)"""))
def area_mask(spark, sf):
    d = P.area_mask(square(spark, sf).drop("mask"), 1.55, 2.45, 3.05, 3, 8, 8, sigma=0.6, border=2, left_edge=1)
    return d.select("frame_id", F.col("x").alias("q"), F.col("y").alias("r"), "mask")


@query("threshold_curve", with_(PX, """
th AS (SELECT frame_id, pass, i, m * (2 ** pass) / 29 * i AS t, m * (2 ** pass) / 29 AS step
  FROM (SELECT frame_id, avg(value) AS m FROM px GROUP BY frame_id), range(1, 4) p(pass), range(30) k(i))""", f"""
m AS (SELECT frame_id, pass, i, t, step, avg(CASE WHEN hit >= 5 THEN 1.0 ELSE 0.0 END) AS share FROM (
  SELECT p.frame_id, p.q, p.r, pass, i, t, step, count(*) FILTER (s.value > t) AS hit FROM px p JOIN th USING (frame_id),
   (SELECT a AS dx, b AS dy FROM range(-1, 2) t(a), range(-1, 2) u(b)) c
   JOIN px s ON s.frame_id = p.frame_id AND s.q = {_reflect('p.q + dx')} AND s.r = {_reflect('p.r + dy')} GROUP BY ALL) GROUP BY ALL),
f AS (SELECT frame_id, min_by(t, pass * 100 + i) FILTER (share < 0.01) AS e, min_by(step, pass * 100 + i) FILTER (share < 0.01) AS step,
  min_by(t, pass * 100 + i) FILTER (share < 0.99) AS s FROM m GROUP BY frame_id)""", body="""
SELECT frame_id, round(s, 6) AS dirt_start, round(e, 6) AS dirt_end,
  round(CASE WHEN e - s < 3 * step THEN e ELSE s END * 1.25, 6) AS threshold FROM f"""))
def threshold_curve(spark, sf):
    d = P.threshold_curve(square(spark, sf).drop("mask"), 3, 8, 8)
    return d.select("frame_id", *[r6(c).alias(c) for c in ("dirt_start", "dirt_end", "threshold")])


@query("row_artifact_mask", with_(PX, """
s AS (SELECT frame_id, avg(value) FILTER (mask = 1) AS clean FROM px GROUP BY frame_id),
b AS (SELECT frame_id, any_value(clean) AS clean, avg(CASE WHEN mask = 1 THEN value ELSE clean END) > 1.1 * any_value(clean) AS bad
  FROM px JOIN s USING (frame_id) WHERE r < 2 GROUP BY frame_id)""", body="""
SELECT frame_id, q, r, round(CASE WHEN (bad AND r < 2) OR mask <> 1 THEN clean ELSE value END, 6) AS value,
  CASE WHEN bad AND r < 2 THEN 16 ELSE mask END AS mask FROM px JOIN b USING (frame_id)"""))
def row_artifact_mask(spark, sf):
    d = P.row_artifact_mask(square(spark, sf), 2)
    return d.select("frame_id", F.col("x").alias("q"), F.col("y").alias("r"), r6("value").alias("value"), *_lint("mask"))


DIST = """dist AS (SELECT p.frame_id, p.q, p.r, coalesce(min(greatest(abs(p.q - d.q), abs(p.r - d.r))), 8) AS dist
FROM px p LEFT JOIN px d ON d.frame_id = p.frame_id AND d.mask = 16 GROUP BY ALL)"""


@query("dirt_distance", with_(PX, DIST, body="SELECT frame_id, q, r, dist FROM dist"))
def dirt_distance(spark, sf):
    d = P.dirt_distance(square(spark, sf), F.col("mask") == 16, 8, 8)
    return d.select("frame_id", F.col("x").alias("q"), F.col("y").alias("r"), *_lint("dist"))


@query("clean_spots", "WITH RECURSIVE " + ",\n".join([PX, DIST, """
spots(frame_id, place, best, rest) AS (
  SELECT frame_id, 1, s[1], list_filter(s, lambda c: NOT (c.q >= s[1].q - 2 AND c.q < s[1].q + 2 AND c.r >= s[1].r - 2 AND c.r < s[1].r + 2)) FROM (
    SELECT frame_id, list({'dist': dist, 'q': q, 'r': r} ORDER BY dist DESC, r, q) AS s FROM dist WHERE dist > 1 AND q BETWEEN 1 AND 6 AND r BETWEEN 1 AND 6 GROUP BY frame_id)
  UNION ALL SELECT frame_id, place + 1, rest[1], list_filter(rest, lambda c: NOT (c.q >= rest[1].q - 2 AND c.q < rest[1].q + 2 AND c.r >= rest[1].r - 2 AND c.r < rest[1].r + 2))
  FROM spots WHERE len(rest) > 0)"""]) + """
SELECT frame_id, best.q AS x, best.r AS y, best.dist AS dist, CAST(place AS BIGINT) AS place FROM spots""")
def clean_spots(spark, sf):
    d = P.clean_spots(square(spark, sf), F.col("mask") == 16, 8, 8, radius=1)
    return d.select("frame_id", "x", "y", *_lint("dist", "place"))


# -- runs ---------------------------------------------------------------------------

def _runs_sql(src, key, level, max_len, n):
    return f"""(SELECT {key}, b AS pos, len AS length, mean, CAST(round_even(mean / {level}, 0) AS BIGINT) AS count FROM (
 SELECT {key}, b, count(*) AS len, avg(value) AS mean, any_value(e) AS e FROM (
  SELECT {key}, pos, value, e, st + ((pos - st) // {max_len}) * {max_len} AS b FROM (
   SELECT {key}, pos, value, coalesce(max(CASE WHEN value < {level} / 2 THEN pos END) OVER (PARTITION BY {key} ORDER BY pos), -1) + 1 AS st,
     max(pos) OVER (PARTITION BY {key}) AS e FROM {src}) WHERE value >= {level} / 2) GROUP BY {key}, b) WHERE b + len <= e)"""


@query("count_runs", with_(EV, body=f"""
SELECT line, pos, length, {S6('mean')} AS mean, count FROM {_runs_sql('ev', 'line', '100.0', 5, 0)}"""))
def count_runs(spark, sf):
    d = R.count_runs(X.ev(spark, sf), ["line"], 100.0, 5)
    return d.select("line", "pos", "length", r6("mean").alias("mean"), "count")


@query("count_runs_frames", with_(PX, "t AS (SELECT frame_id * 8 + r AS line, q AS pos, CAST(value AS DOUBLE) AS value FROM px)", body=f"""
SELECT line, pos, length, {S6('mean')} AS mean, count FROM {_runs_sql('t', 'line', '3.0', 4, 0)}"""))
def count_runs_frames(spark, sf):
    t = X.px(spark, sf).select((F.col("frame_id") * 8 + F.col("r")).alias("line"), F.col("q").alias("pos"), "value")
    d = R.count_runs(t, ["line"], 3.0, 4)
    return d.select("line", "pos", "length", r6("mean").alias("mean"), "count")


@query("finish_models", with_(EV, """
h AS (SELECT line AS m, pos AS step, value > 150 AS accepted FROM ev),
g AS (SELECT m, step, step - coalesce(max(CASE WHEN accepted THEN step END) OVER (PARTITION BY m ORDER BY step), -1) AS fails FROM h)""", body="""
SELECT m, min(CASE WHEN fails > 25 THEN step END) AS finished_at,
  CASE WHEN max(fails) > 25 THEN 'Finished' ELSE 'Continue' END AS state FROM g GROUP BY m"""))
def finish_models(spark, sf):
    h = X.ev(spark, sf).select(F.col("line").alias("m"), F.col("pos").alias("step"), (F.col("value") > 150).alias("accepted"))
    return R.finish_models(h, 25)


@query("top_points", with_(EV, body=f"""
SELECT line, p, {S6('score')} AS score, place FROM (
 SELECT *, row_number() OVER (PARTITION BY line ORDER BY score DESC, p) AS place FROM (
  SELECT line, pos % 23 AS p, avg(value) AS score FROM ev GROUP BY ALL)) WHERE place <= 5"""))
def top_points(spark, sf):
    d = X.ev(spark, sf).select("line", (F.col("pos") % 23).alias("p"), F.col("value").alias("score"))
    return R.top_points(d, "line", 5, "score", ["p"]).select("line", "p", r6("score").alias("score"), "place")


@query("parabola_vertex", with_(EV, """
k AS (SELECT line, pos AS x, value AS y, row_number() OVER (PARTITION BY line ORDER BY value DESC, pos) AS k FROM ev),
p AS (SELECT line, max(x) FILTER (k = 1) AS x1, max(x) FILTER (k = 2) AS x2, max(x) FILTER (k = 3) AS x3,
  max(y) FILTER (k = 1) AS y1, max(y) FILTER (k = 2) AS y2, max(y) FILTER (k = 3) AS y3 FROM k WHERE k <= 3 GROUP BY line),
c AS (SELECT *, ((y1 - y2) * (x2 - x3) - (y2 - y3) * (x1 - x2)) / ((x1 * x1 - x2 * x2) * (x2 - x3) - (x2 * x2 - x3 * x3) * (x1 - x2)) AS a,
  ((y1 - y2) * (x2 * x2 - x3 * x3) - (y2 - y3) * (x1 * x1 - x2 * x2)) / ((x1 - x2) * (x2 * x2 - x3 * x3) - (x2 - x3) * (x1 * x1 - x2 * x2)) AS b FROM p)""", body="""
SELECT line, round(CASE WHEN ok THEN -b / (2 * a) ELSE (x1 + coalesce(x2, x1)) / 2.0 END, 4) + 0.0 AS vertex, ok AS is_maximum
FROM (SELECT *, coalesce(y1 > y2 AND y2 > y3 AND a < 0, FALSE) AS ok FROM c)"""))
def parabola_vertex(spark, sf):
    d = R.parabola_vertex(X.ev(spark, sf), "line", "pos", "value")
    return d.select("line", (F.round("vertex", 4) + F.lit(0.0)).alias("vertex"), "is_maximum")


@query("nearest_within", with_(EV, """
want AS (SELECT DISTINCT line, i * 17.25::DOUBLE AS target FROM ev, range(12) t(i))""", body="""
SELECT line, target, CASE WHEN d <= 2 THEN pos END AS pos, CASE WHEN d <= 2 THEN value END AS value FROM (
 SELECT w.line, target, arg_min(pos, (abs(value - target), pos)) AS pos, arg_min(value, (abs(value - target), pos)) AS value,
   min(abs(value - target)) AS d FROM want w JOIN ev USING (line) GROUP BY ALL)"""))
def nearest_within(spark, sf):
    e = X.ev(spark, sf)
    want = e.select("line").distinct().select(
        "line", F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: i * F.lit(17.25))).alias("target")
    )
    return R.nearest_within(want, e, "line", "target", "value", "pos", 2.0)


# -- counts and shifts ---------------------------------------------------------------

@query("count_divisor", with_(PX, """
v AS (SELECT DISTINCT frame_id, value * (0.37::DOUBLE + frame_id / 1000.0::DOUBLE) + CASE WHEN mask = 4 THEN 0.01::DOUBLE ELSE 0 END AS v FROM px),
s AS (SELECT frame_id, v - lag(v) OVER (PARTITION BY frame_id ORDER BY v) AS s FROM v),
l AS (SELECT frame_id, s, min(s) OVER (PARTITION BY frame_id) AS m FROM s WHERE s > 1e-9)""", body=f"""
SELECT frame_id, {S6('avg(s)')} AS divisor, {S6('stddev_pop(s)')} AS spread FROM l WHERE s < 1.5 * m GROUP BY frame_id"""))
def count_divisor(spark, sf):
    p = X.px(spark, sf)
    v = F.col("value") * (F.lit(0.37) + F.col("frame_id") / F.lit(1000.0)) + F.when(F.col("mask") == 4, 0.01).otherwise(0.0)
    d = P.count_divisor(p.select("frame_id", v.alias("value")))
    return d.select("frame_id", r6("divisor").alias("divisor"), r6("spread").alias("spread"))


_REP = "rep AS (SELECT frame_id, avg(value) AS hex_avg, stddev_pop(value) / avg(value) AS contrast FROM hx GROUP BY frame_id)"


def _frame_report(h):
    return h.groupBy("frame_id").agg(
        F.avg("value").alias("hex_avg"), (F.stddev_pop("value") / F.avg("value")).alias("contrast")
    )


@query("clip_shift", with_(HX, _REP, body="""
SELECT frame_id, hp, CASE WHEN raw < 0 THEN 0 WHEN raw > 6 THEN 6 ELSE raw END AS value,
 CASE WHEN raw < 0 THEN 'underflow' WHEN raw > 6 THEN 'chopped' ELSE 'regular' END AS kind FROM (
 SELECT frame_id, hp, CAST(trunc((value - hex_avg) / 0.8 + 2 + 0.5) AS BIGINT) AS raw FROM hx JOIN rep USING (frame_id) WHERE contrast >= 0.7)"""))
def clip_shift(spark, sf):
    h = X.hx(spark, sf)
    d = P.clip_shift(h, _frame_report(h), level=2, top=6, divisor=0.8, min_contrast=0.7)
    return d.select("frame_id", "hp", "value", "kind")


# -- unit cells ------------------------------------------------------------------------

_PAR = dict(hel=0.37, tilt=0.21, excent=1.04, phi=0.4, off_x=3.77, off_y=4.13)
RES = 4


def params(spark, sf):
    """One lattice per frame; the edge length differs a little."""
    d = X.px(spark, sf).select("frame_id").distinct()
    return d.withColumns(
        {k: F.lit(v) for k, v in _PAR.items() if k != "hel"}
    ).withColumn("hel", F.lit(_PAR["hel"]) + (F.col("frame_id") % 5) * F.lit(0.01))


def _basis(ang, length):
    """Distorted basis vector as SQL, cell axis at -tilt + ang."""
    t, e, ph = _PAR["tilt"], _PAR["excent"], _PAR["phi"]
    vx, vy = math.cos(-t + ang), math.sin(-t + ang)
    u = vx * math.cos(ph) - vy * math.sin(ph)
    v = (-vx * math.sin(ph) - vy * math.cos(ph)) * e
    x = u * math.cos(ph) - v * math.sin(ph)
    y = -u * math.sin(ph) - v * math.cos(ph)
    return f"({x!r} * {length})", f"({y!r} * {length})"


def _fold_sql(extra_hel="(frame_id % 5) * 0.01::DOUBLE", bond=2):
    length = f"({3 * bond} * ({_PAR['hel']}::DOUBLE + {extra_hel}))"
    ax, ay = _basis(-math.pi / 6, length)
    bx, by = _basis(math.pi / 6, length)
    cx, cy = _basis(math.pi / 2, length)
    ox, oy = _PAR["off_x"], _PAR["off_y"]

    def part(o, ux, uy, vx, vy):
        return f"""SELECT frame_id, {o} AS orient, value, mask, dx, dy, {ux} AS ux, {uy} AS uy, {vx} AS vx, {vy} AS vy FROM pp"""

    return f"""pp AS (SELECT frame_id, value, mask, q + 0.5::DOUBLE - {ox} AS dx, r + 0.5::DOUBLE - {oy} AS dy FROM px),
o2 AS ({part(0, ax, ay, bx, by)} UNION ALL {part(1, bx, by, cx, cy)}),
fr AS (SELECT *, (vy * dx - vx * dy) / (ux * vy - uy * vx) AS f1, (ux * dy - uy * dx) / (ux * vy - uy * vx) AS f2 FROM o2),
ce AS (SELECT *, CAST(floor(f1) AS BIGINT) AS c1, CAST(floor(f2) AS BIGINT) AS c2 FROM fr),
hits AS (SELECT frame_id, orient, c1, c2, CAST(floor((f1 - c1) * {RES}) AS BIGINT) AS i, CAST(floor((f2 - c2) * {RES}) AS BIGINT) AS j, value, mask <> 1 AS dirty FROM ce
  WHERE {' AND '.join(f'((c1 + {a}) * ux + (c2 + {b}) * vx + {ox}) >= 0 AND ((c1 + {a}) * ux + (c2 + {b}) * vx + {ox}) < 8 AND ((c1 + {a}) * uy + (c2 + {b}) * vy + {oy}) >= 0 AND ((c1 + {a}) * uy + (c2 + {b}) * vy + {oy}) < 8' for a in (0, 1) for b in (0, 1))}),
clean AS (SELECT * FROM hits WHERE (frame_id, orient, c1, c2) NOT IN (SELECT (frame_id, orient, c1, c2) FROM hits WHERE dirty)),
cell AS (SELECT frame_id, orient, i, j, sum(value) AS value FROM clean GROUP BY ALL)"""


# complete cells in SQL: grid joined on its own keys
_FOLD = _fold_sql() + f""",
fc AS (SELECT g.frame_id, g.orient, g.i, g.j, CAST(coalesce(c.value, 0) AS DOUBLE) AS value FROM
  (SELECT frame_id, orient, a AS i, b AS j FROM (SELECT DISTINCT frame_id, orient FROM cell), range({RES}) t(a), range({RES}) u(b)) g
  LEFT JOIN cell c ON c.frame_id = g.frame_id AND c.orient = g.orient AND c.i = g.i AND c.j = g.j)"""


def _hits(spark, sf):
    return P.fold_cells(square(spark, sf), params(spark, sf), bond=2, res=RES, width=8, height=8)


def cells(spark, sf):
    s = P.cell_sums(P.clean_cells(_hits(spark, sf)))
    return P.full_cell(s, ["frame_id", "orient"], RES)


@query("clean_cells", with_(PX, _FOLD, body="""
SELECT frame_id, orient, c1, c2, count(*) AS n, CAST(sum(value) AS BIGINT) AS value FROM clean GROUP BY ALL"""))
def clean_cells(spark, sf):
    d = P.clean_cells(_hits(spark, sf))
    return d.groupBy("frame_id", "orient", *_lint("c1", "c2")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").cast("long").alias("value")
    )


@query("fold_cells", with_(PX, _FOLD, body=f"""
SELECT c.frame_id, c.orient, c.i, c.j, CAST(value AS BIGINT) AS value, cells, {S6('value / cells')} AS mean FROM cell c
JOIN (SELECT frame_id, orient, count(DISTINCT (c1, c2)) AS cells FROM clean GROUP BY ALL) g USING (frame_id, orient)"""))
def fold_cells(spark, sf):
    d = P.cell_sums(P.clean_cells(_hits(spark, sf)))
    return d.select("frame_id", "orient", *_lint("i", "j", "value"), "cells", r6("mean").alias("mean"))


def _images(o):
    return f"(SELECT value FROM fc o WHERE o.frame_id = c.frame_id AND o.orient = c.orient AND {o})"


@query("mirror_quality", with_(PX, _FOLD, f"""
lim AS (SELECT frame_id, orient, floor(0.5 * max(value) + 0.5 * min(value)) AS thr, floor(0.25 * max(value) + 0.75 * min(value)) AS lo FROM fc GROUP BY ALL),
im AS (SELECT c.frame_id, c.orient, c.value - lo AS v0, a.value - lo AS v1, b.value - lo AS v2, d.value - lo AS v3 FROM fc c JOIN lim USING (frame_id, orient)
  JOIN fc a ON a.frame_id = c.frame_id AND a.orient = c.orient AND a.i = c.j AND a.j = c.i
  JOIN fc b ON b.frame_id = c.frame_id AND b.orient = c.orient AND b.i = {RES - 1} - c.i AND b.j = {RES - 1} - c.j
  JOIN fc d ON d.frame_id = c.frame_id AND d.orient = c.orient AND d.i = {RES - 1} - c.j AND d.j = {RES - 1} - c.i WHERE c.value > thr),
ds AS (SELECT *, (abs(s - 4 * v0) + abs(s - 4 * v1) + abs(s - 4 * v2) + abs(s - 4 * v3)) / nullif(6 * s, 0) AS ds FROM (SELECT *, v0 + v1 + v2 + v3 AS s FROM im))""", body=f"""
SELECT l.frame_id, l.orient, {S6('1 - avg(CASE WHEN ds >= 0 AND ds <= 1 THEN ds ELSE 1 END)')} AS "mirrorQ"
FROM lim l LEFT JOIN ds USING (frame_id, orient) GROUP BY ALL""".replace("1 - avg(CASE WHEN ds >=", "1 - avg(CASE WHEN ds.frame_id IS NULL THEN NULL WHEN ds >=")))
def mirror_quality(spark, sf):
    d = P.mirror_quality(cells(spark, sf), RES, ["frame_id", "orient"])
    return d.select("frame_id", "orient", r6("mirrorQ").alias("mirrorQ"))


_T = P.gaussian_template(RES)
_TEMPLATE = f"""tp AS (SELECT * FROM (VALUES {', '.join(f'({p % RES}, {p // RES}, {v!r}::DOUBLE)' for p, v in enumerate(_T))}) t(ti, tj, t)),
mm AS (SELECT frame_id, orient, min(value) AS lo, max(value) AS hi, sum(value) AS s FROM fc GROUP BY ALL),
res AS (SELECT c.frame_id, c.orient, sx, sy, 1000 * sqrt(sum((c.value - (lo + (hi - lo) * t)) ** 2)) / any_value(s) AS residual
  FROM fc c JOIN mm USING (frame_id, orient), (SELECT a AS sx, b AS sy FROM range({RES}) t(a), range({RES}) u(b)) sh
  JOIN tp ON ti = (c.i - sx + {RES}) % {RES} AND tj = (c.j - sy + {RES}) % {RES} GROUP BY ALL),
off AS (SELECT *, max(residual) OVER w AS worst, min(residual) OVER w AS best, avg(residual) OVER w AS mean FROM res WINDOW w AS (PARTITION BY frame_id, orient))"""


def _offsets(spark, sf):
    return P.template_offset(cells(spark, sf), RES, keys=["frame_id", "orient"])


@query("template_offset", with_(PX, _FOLD, _TEMPLATE, body="""
SELECT frame_id, orient, sx, sy, round(residual, 4) AS residual,
  round(1000 * (residual - worst) / (CASE WHEN worst - best > 1e-7 THEN mean - worst END), 3) + 0.0 AS merit FROM off"""))
def template_offset(spark, sf):
    d = _offsets(spark, sf)
    lim = d.groupBy("frame_id", "orient").agg((F.max("residual") - F.min("residual")).alias("span"))
    d = d.join(lim, ["frame_id", "orient"])
    return d.select(
        "frame_id", "orient", *_lint("sx", "sy"), F.round("residual", 4).alias("residual"),
        F.when(F.col("span") > 1e-7, F.round("merit", 3) + F.lit(0.0)).alias("merit"),
    )


@query("position_quality", with_(PX, _FOLD, _TEMPLATE, f"""
bst AS (SELECT frame_id, orient, arg_min(sx, (round(residual, 9), sx, sy)) AS bx, arg_min(sy, (round(residual, 9), sx, sy)) AS byy FROM off GROUP BY ALL),
pk AS (SELECT frame_id, orient, ((sx - bx + {RES // 2} + {RES}) % {RES} - {RES // 2}) / {RES}.0::DOUBLE AS dx, ((sy - byy + {RES // 2} + {RES}) % {RES} - {RES // 2}) / {RES}.0::DOUBLE AS dy,
  CASE WHEN worst - best > 1e-7 AND (worst - residual) / (worst - best) - 0.5 > 1e-9 THEN (worst - residual) / (worst - best) - 0.5 END AS w FROM off JOIN bst USING (frame_id, orient))""", body="""
SELECT frame_id, orient, round(1 / nullif(30 * (abs(sum(w * dx * dx) / sum(w) - (sum(w * dx) / sum(w)) ** 2)
  + abs(sum(w * dy * dy) / sum(w) - (sum(w * dy) / sum(w)) ** 2)), 0), 5) AS "positionQ" FROM pk GROUP BY ALL"""))
def position_quality(spark, sf):
    """Flat frames have no position: null."""
    q = P.position_quality(_offsets(spark, sf), RES, ["frame_id", "orient"])
    return q.select("frame_id", "orient", F.round("positionQ", 5).alias("positionQ"))


# -- spectra ---------------------------------------------------------------------------

_KS = [(i / 8, j / 8) for i in range(-2, 3) for j in range(0, 3)]


@query("structure_factor", with_(PX, f"ks AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)' for i, (a, b) in enumerate(_KS))}) t(k, kx, ky))", body="""
SELECT frame_id, k, round(sum(value * cos(2 * pi() * (kx * q + ky * r))) ** 2 + sum(value * sin(2 * pi() * (kx * q + ky * r))) ** 2, 4) + 0.0 AS power
FROM px, ks GROUP BY frame_id, k"""))
def structure_factor(spark, sf):
    d = P.structure_factor(square(spark, sf), _KS)
    return d.select("frame_id", "k", (F.round("power", 4) + F.lit(0.0)).alias("power"))


def spectrum(spark, sf):
    """A full spectrum of 101 x 101 bins from the points, for two frames."""
    p = X.pt(spark, sf).select(
        (F.col("id") % 2).alias("frame_id"), (F.floor("x") - 50).alias("kx"), (F.floor("y") - 50).alias("ky"),
        F.col("w").cast("double").alias("power"),
    )
    i = F.explode(F.sequence(F.lit(0), F.lit(101 * 101 - 1))).alias("i")
    zero = p.select("frame_id").distinct().select("frame_id", i).select(
        "frame_id", (F.col("i") % 101 - 50).cast("long").alias("kx"), (F.floor(F.col("i") / 101) - 50).alias("ky"),
        F.lit(0.0).alias("power"),
    )
    return p.unionByName(zero).groupBy("frame_id", "kx", "ky").agg(F.sum("power").alias("power"))


@query("six_fold_peaks", with_(PT, f"""
sp AS (SELECT frame_id, kx, ky, CAST(sum(w) AS DOUBLE) AS power FROM (
  SELECT id % 2 AS frame_id, CAST(floor(x) AS BIGINT) - 50 AS kx, CAST(floor(y) AS BIGINT) - 50 AS ky, w FROM pt
  UNION ALL SELECT f, i % 101 - 50, i // 101 - 50, 0 FROM range(2) a(f), range(10201) b(i)) GROUP BY ALL),
ring AS (SELECT * FROM sp WHERE sqrt(kx * kx + ky * ky) BETWEEN 20 * 0.6667 AND 30),
st AS (SELECT a.frame_id, a.kx, a.ky, any_value(a.power) AS power, avg(b.power) AS m, stddev_pop(b.power) AS s FROM ring a JOIN sp b
  ON b.frame_id = a.frame_id AND abs(b.kx - a.kx) <= 3 AND abs(b.ky - a.ky) <= 3 GROUP BY ALL),
f AS (SELECT frame_id, arg_max(kx, (power, -kx, -ky)) AS kx, arg_max(ky, (power, -kx, -ky)) AS ky, max(power) AS power FROM st WHERE power >= m + 1.5 * s GROUP BY frame_id),
bx AS (SELECT frame_id, 1 AS ord, i AS peak, round_even(sin(i * pi() / 3) * ky + cos(i * pi() / 3) * kx, 0) AS bx, round_even(cos(i * pi() / 3) * ky - sin(i * pi() / 3) * kx, 0) AS byy, 3 AS t FROM f, range(1, 6) r(i)
 UNION ALL SELECT frame_id, 2, i, round_even(1.7::DOUBLE * (sin(i * pi() / 3 + pi() / 6) * ky + cos(i * pi() / 3 + pi() / 6) * kx), 0),
   round_even(1.7::DOUBLE * (cos(i * pi() / 3 + pi() / 6) * ky - sin(i * pi() / 3 + pi() / 6) * kx), 0), 5 FROM f, range(6) r(i)),
h AS (SELECT b.frame_id, ord, peak, arg_max(s.kx, (s.power, -s.kx, -s.ky)) AS kx, arg_max(s.ky, (s.power, -s.kx, -s.ky)) AS ky, max(s.power) AS power, avg(s.power) AS m, stddev_pop(s.power) AS sd
  FROM bx b JOIN sp s ON s.frame_id = b.frame_id AND abs(s.kx - bx) <= t AND abs(s.ky - byy) <= t GROUP BY ALL)""", body="""
SELECT frame_id, 1 AS "order", 0 AS peak, kx, ky, power FROM f UNION ALL SELECT frame_id, ord, peak, kx, ky, power FROM h WHERE power > m + 1.2 * sd"""))
def six_fold_peaks(spark, sf):
    return P.six_fold_peaks(spectrum(spark, sf), 20.0, 3, 1.5, 1.2, second_order=True, ratio=1.7)
