"""Queries on symmetry, alignment and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from honeyframe import fixtures as X
from honeyframe.catalog import query
from honeyframe.catalog.views import HX, MODELS, SYM12, r6 as S6, with_, wrap_home
from honeyframe.functions.numbers import r6
from honeyframe.operators import symmetry as Y
from honeyframe.session import cut_lineage

N = X.RADIUS

# position maps of the twelve copies and of all shifts, from the pixel grid
POS = "pos AS (SELECT DISTINCT hp, x, y, z FROM hx)"
SYMM = (
    POS + ",\n" + SYM12 + """,
rot AS (SELECT hp, sym, x, y, z, mirror, CASE rot WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN z WHEN 3 THEN -x WHEN 4 THEN y ELSE -z END AS rx,
  CASE rot WHEN 0 THEN y WHEN 1 THEN -z WHEN 2 THEN x WHEN 3 THEN -y WHEN 4 THEN z ELSE -x END AS ry FROM pos, sym),
raw AS (SELECT *, CASE WHEN mirror = 1 THEN ry ELSE -rx - ry END AS rz FROM rot),
""" + f"symm AS (SELECT o.hp, o.sym, p.hp AS hp_to FROM ({wrap_home('raw', 4, 'hp, sym', 'rx', 'rz')}) o JOIN pos p ON p.x = wx AND p.z = wz)"
)
TRANS = f"""tr0 AS (SELECT a.hp, b.x AS dx, b.z AS dz, a.x - b.x AS sx, a.z - b.z AS sz FROM pos a, pos b),
trans AS (SELECT o.hp, dx, dz, p.hp AS hp_to, p.x, p.z FROM ({wrap_home('tr0', 4, 'hp, dx, dz', 'sx', 'sz')}) o JOIN pos p ON p.x = wx AND p.z = wz)"""


@query("expand_orbit", with_(HX, SYMM, body="SELECT frame_id AS sf_id, sym, hp_to AS hp, value FROM hx JOIN symm USING (hp)"))
def expand_orbit(spark, sf):
    return Y.expand_orbit(X.sf_pixels(spark, sf), N, N)


@query("expand_orbit_lattice", with_(HX, POS, """
lp AS (SELECT CAST(row_number() OVER (ORDER BY CASE WHEN x = 0 AND z = 0 THEN 0 ELSE 1 END, x, z) - 1 AS BIGINT) AS lp, x AS lx, z AS lz FROM pos
  WHERE (2 * x + z) % 6 = 0 AND (x + 2 * z) % 6 = 0),
m0 AS (SELECT hp, mir * 24 + rot * 4 + lp AS sym, rot, mir, x + lx AS x, z + lz AS z, -(x + lx) - (z + lz) AS y FROM pos, lp, range(6) r(rot), range(2) u(mir)),
m1 AS (SELECT hp, sym, mir, CASE rot WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN z WHEN 3 THEN -x WHEN 4 THEN y ELSE -z END AS sx, CASE rot WHEN 0 THEN y WHEN 1 THEN -z WHEN 2 THEN x WHEN 3 THEN -y WHEN 4 THEN z ELSE -x END AS sy FROM m0),
m AS (SELECT hp, sym, sx, CASE WHEN mir = 1 THEN sy ELSE -sx - sy END AS sz FROM m1)""", f"t AS (SELECT o.hp, sym, p.hp AS hp_to FROM ({wrap_home('m', 4, 'hp, sym', 'sx', 'sz')}) o JOIN pos p ON p.x = wx AND p.z = wz)", body="""
SELECT frame_id AS sf_id, sym, hp_to AS hp, sum(value) AS value FROM hx JOIN t USING (hp) GROUP BY ALL""".replace("sum(value)", "CAST(sum(value) AS BIGINT)")))
def expand_orbit_lattice(spark, sf):
    """Four lattice shifts times twelve operations."""
    return Y.expand_orbit(X.sf_pixels(spark, sf), N, 2)


@query("orbit_median", with_(HX, SYMM, """
o AS (SELECT frame_id AS sf_id, hp_to AS hp, CAST(quantile_disc(value, 0.5) AS BIGINT) AS median FROM hx JOIN symm USING (hp) GROUP BY ALL)""", body="""
SELECT sf_id, o.hp, median, value, value + 32768 - median AS difference FROM o JOIN hx ON hx.frame_id = sf_id AND hx.hp = o.hp"""))
def orbit_median(spark, sf):
    s = X.sf_pixels(spark, sf)
    return Y.orbit_median(Y.expand_orbit(s, N, N), subtract=s).select("sf_id", "hp", "median", "value", "difference")


_ALIGN = """img AS (SELECT hp, avg(value) AS v FROM hx WHERE grp = 1 GROUP BY hp), bgi AS (SELECT hp, avg(value) AS v FROM hx GROUP BY hp),
k0 AS (SELECT a.hp, (a.v - (SELECT avg(v) FROM img)) / (SELECT stddev_pop(v) FROM img) - (b.v - (SELECT avg(v) FROM bgi)) / (SELECT stddev_pop(v) FROM bgi) AS v FROM img a JOIN bgi b USING (hp)),
kern AS (SELECT hp, (v - (SELECT avg(v) FROM k0)) / (SELECT stddev_pop(v) FROM k0) AS k FROM k0),
ring AS (SELECT x, z FROM pos WHERE abs(x) + abs(z) + abs(y) <= 2),
ops AS (SELECT mir, rot, x AS lx, z AS lz, CAST(row_number() OVER (ORDER BY mir, rot, CASE WHEN x = 0 AND z = 0 THEN 0 ELSE 1 END, x, z) - 1 AS BIGINT) AS t FROM ring, range(6) r(rot), range(2) m(mir)),
s0 AS (SELECT p.hp, t, rot, mir, p.x + lx AS x, p.z + lz AS z, -(p.x + lx) - (p.z + lz) AS y FROM pos p, ops),
s1 AS (SELECT hp, t, mir, CASE rot WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN z WHEN 3 THEN -x WHEN 4 THEN y ELSE -z END AS rx,
  CASE rot WHEN 0 THEN y WHEN 1 THEN -z WHEN 2 THEN x WHEN 3 THEN -y WHEN 4 THEN z ELSE -x END AS ry FROM s0),
s2 AS (SELECT hp, t, rx, CASE WHEN mir = 1 THEN ry ELSE -rx - ry END AS rz FROM s1),
tmap AS (SELECT o.hp, t, p.hp AS hp_from FROM (""" + wrap_home('s2', 4, 'hp, t', 'rx', 'rz') + """) o JOIN pos p ON p.x = wx AND p.z = wz),
zz AS (SELECT frame_id, hp, value, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM hx WINDOW w AS (PARTITION BY frame_id)),
sc AS (SELECT frame_id, t, avg(k * zz.z) AS match FROM zz JOIN tmap ON tmap.hp_from = zz.hp JOIN kern ON kern.hp = tmap.hp GROUP BY frame_id, t),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY round(match, 9) DESC, t) AS k FROM sc)"""


def _align(spark, sf):
    h = X.hx(spark, sf)
    lattice = h.filter(F.col("grp") == 1).groupBy("hp").agg(F.avg("value").alias("value"))
    bg = h.groupBy("hp").agg(F.avg("value").alias("value"))
    return Y.align_frames(h, lattice, N, bg, radius=1)


@query("align_frames", with_(HX, POS, _ALIGN, body=f"""
SELECT a.frame_id, a.t, {S6('a.match')} AS match, {S6('b.match')} AS second FROM rk a JOIN rk b ON b.frame_id = a.frame_id AND b.k = 2 WHERE a.k = 1"""))
def align_frames(spark, sf):
    best, _ = _align(spark, sf)
    return best.select("frame_id", F.col("t").cast("long"), r6("match").alias("match"), r6("second").alias("second"))


@query("move_frames", with_(HX, POS, _ALIGN, body="""
SELECT rk.frame_id, tmap.hp, value FROM rk JOIN tmap USING (t) JOIN zz ON zz.frame_id = rk.frame_id AND zz.hp = hp_from WHERE k = 1"""))
def move_frames(spark, sf):
    _, moved = _align(spark, sf)
    return moved[0].select("frame_id", "hp", "value")


_CORR = "coalesce(CASE WHEN stddev_pop(a) * stddev_pop(b) > 1e-12 THEN corr(a, b) END, 0)"


@query("molecule_match", with_(HX, "mol AS (SELECT grp AS mol, hp, avg(value) AS b FROM hx GROUP BY ALL)",
       f"pr AS (SELECT frame_id, mol, {_CORR} AS c FROM (SELECT frame_id, hp, value AS a FROM hx) JOIN mol USING (hp) GROUP BY ALL)",
       "rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY round(c, 9) DESC, mol) AS k FROM pr)", body=f"""
SELECT frame_id, max(mol) FILTER (k = 1) AS best, {S6('max(c)')} AS best_match, {S6('max(c) FILTER (k = 2)')} AS second_match, {S6('min(c)')} AS worst_match,
  {S6('sum(greatest(c, 0))')} AS summed, round(sqrt(count(*) / sum(greatest(c, 0))), 4) AS inv_avg FROM rk GROUP BY frame_id"""))
def molecule_match(spark, sf):
    h = X.hx(spark, sf)
    mol = h.groupBy(F.col("grp").alias("mol"), "hp").agg(F.avg("value").alias("value"))
    d = Y.molecule_match(h, mol, exponent=0.5)
    return d.select("frame_id", "best", *[r6(c).alias(c) for c in ("best_match", "second_match", "worst_match", "summed")],
                    F.round("inv_avg", 4).alias("inv_avg"))


@query("model_symmetry_factor", with_(HX, MODELS, SYMM,
       f"pr AS (SELECT m, sym, {_CORR} AS c FROM (SELECT o.m, o.sym, o.level AS a, k.level AS b FROM (SELECT m, sym, hp_to AS hp, level FROM models JOIN symm USING (hp)) o JOIN models k ON k.m = o.m AND k.hp = o.hp) GROUP BY ALL)", body=f"""
SELECT m, {S6('sum(greatest(c, 0))')} AS summed, {S6('count(*) / sum(greatest(c, 0))')} AS factor FROM pr GROUP BY m"""))
def model_symmetry_factor(spark, sf):
    m = models_xz(spark, sf)
    d = Y.model_symmetry_factor(m, N, N)
    return d.select("m", r6("summed").alias("summed"), r6("factor").alias("factor"))


def models_xz(spark, sf):
    """Group models with their cube columns."""
    g = X.hx(spark, sf).groupBy(F.col("grp").cast("long").alias("m"), "hp", "x", "z").agg(
        F.least(F.lit(15), F.round(F.avg("value") * 3).cast("long")).cast("long").alias("level")
    )
    return cut_lineage(g)


@query("target_cell", with_(HX, "rep AS (SELECT frame_id, (frame_id * 37 % 211) - 20.0::DOUBLE AS hex_merit, (frame_id % 10) / 10.0::DOUBLE AS contrast FROM hx GROUP BY frame_id)", body="""
SELECT hp, CAST(round(sum(value * (hex_merit / 100) ** 2) / sum((hex_merit / 100) ** 2)) AS BIGINT) AS value FROM hx JOIN rep USING (frame_id)
WHERE hex_merit > 0 AND contrast > 0.15 GROUP BY hp"""))
def target_cell(spark, sf):
    h = X.hx(spark, sf)
    k = F.col("frame_id")
    rep = h.select("frame_id").distinct().select(
        "frame_id", ((k * 37 % 211) - F.lit(20.0)).alias("hex_merit"), ((k % 10) / F.lit(10.0)).alias("contrast")
    )
    return Y.target_cell(h, rep, ["hp"], 0.15)


@query("best_shift", with_(HX, POS, TRANS, "tgt AS (SELECT hp, sum(value) AS t FROM hx GROUP BY hp)", """
sc AS (SELECT frame_id, dx, dz, corr(value, t) AS c FROM hx JOIN trans USING (hp) JOIN tgt ON tgt.hp = hp_to GROUP BY frame_id, dx, dz),
b AS (SELECT frame_id, arg_max(dx, (round(c, 9), -dx, -dz)) AS dx, arg_max(dz, (round(c, 9), -dx, -dz)) AS dz, max(c) AS c FROM sc GROUP BY frame_id)""", body=f"""
SELECT frame_id, dx, dz, {S6('c')} AS match, {S6('CASE WHEN c >= 0 THEN c * c ELSE -sqrt(-c) END')} AS score FROM b"""))
def best_shift(spark, sf):
    h = X.hx(spark, sf)
    t = h.groupBy("hp").agg(F.sum("value").alias("value"))
    d = Y.best_shift(h, t, N)
    return d.select("frame_id", F.col("dx").cast("long"), F.col("dz").cast("long"), r6("match").alias("match"), r6("score").alias("score"))


@query("hex_shape", with_(HX, SYMM, TRANS, """
zz AS (SELECT frame_id, hp, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS v FROM hx WINDOW w AS (PARTITION BY frame_id)),
sh AS (SELECT frame_id, dx, dz, hp_to AS hp, trans.x * trans.x + trans.z * trans.z + trans.x * trans.z AS rr, v FROM zz JOIN trans USING (hp)),
ob AS (SELECT s.frame_id, s.dx, s.dz, s.hp, s.v AS v0, s.rr, m.sym, o.v AS vs FROM sh s JOIN symm m ON m.hp_to = s.hp JOIN sh o ON o.frame_id = s.frame_id AND o.dx = s.dx AND o.dz = s.dz AND o.hp = m.hp),
px_ AS (SELECT frame_id, dx, dz, hp, any_value(v0) AS v0, any_value(rr) AS rr, avg(vs) AS sy FROM ob GROUP BY ALL),
ag AS (SELECT frame_id, dx, dz, 10 * sum(v0 * rr) / 16 / 48 AS moment, sum(sy * v0) / 48 / sqrt(sum(sy * sy) / 48) AS cr FROM px_ GROUP BY ALL),
mn AS (SELECT frame_id, dx, dz, min(c) AS c FROM (SELECT frame_id, dx, dz, sym, sum(vs * v0) / 48 AS c FROM ob GROUP BY ALL) GROUP BY ALL),
hs AS (SELECT *, moment * cr * (1 + c) / 2 AS h FROM ag JOIN mn USING (frame_id, dx, dz))""", body="""
SELECT frame_id, arg_max(dx, (round(h, 9), -dx, -dz)) AS dx, arg_max(dz, (round(h, 9), -dx, -dz)) AS dz, round(max(h), 5) + 0.0 AS hex_shape,
 round(arg_max(moment, (round(h, 9), -dx, -dz)), 5) + 0.0 AS moment2 FROM hs GROUP BY frame_id"""))
def hex_shape(spark, sf):
    d = Y.hex_shape(X.hx(spark, sf), N)
    return d.select("frame_id", F.col("dx").cast("long"), F.col("dz").cast("long"),
                    (F.round("hex_shape", 5) + F.lit(0.0)).alias("hex_shape"), (F.round("moment2", 5) + F.lit(0.0)).alias("moment2"))
