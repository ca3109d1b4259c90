"""Queries on probability tables and start models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from honeyframe import fixtures as X
from honeyframe.catalog import query
from honeyframe.catalog import stats as ST
from honeyframe.catalog.views import HX, MODELS, r6 as S6, with_
from honeyframe.functions.numbers import r6
from honeyframe.operators import probability as P, statistics as S
from honeyframe.operators.numbering import scalar
from honeyframe.session import cut_lineage

LEVELS = 16

# ln Poisson in SQL with the rules of poisson_table
_LP = """CASE WHEN {m} <= 0 THEN (CASE WHEN {x} = 0 THEN 0.0 END) WHEN {x} = 0 THEN -({m}) ELSE {x} * ln(CASE WHEN {m} > 0 THEN {m} END) - {m} - lgamma({x} + 1) END"""


def lp_sql(x, m):
    return "(" + _LP.format(x=x, m=m) + ")"


def soft_sql(e, floor):
    return f"CASE WHEN {e} < {floor} THEN {floor} * (1 + tanh(({e} - {floor}) / {floor})) ELSE {e} END"


# the table over the value range of the data, 16 levels up to 10 counts
PTABLE = f"""lims AS (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS mean FROM hx),
aoff AS (SELECT avg({lp_sql('value', 'mean')}) AS o FROM hx, lims),
pt0 AS (SELECT level, value, level * 10.0::DOUBLE / 15 AS mean, o FROM (SELECT CAST(i AS BIGINT) AS level FROM range(16) t(i)) l,
  (SELECT CAST(v AS BIGINT) AS value FROM range(100) t(v), lims WHERE v BETWEEN lo AND hi) v, aoff),
pt1 AS (SELECT level, value, CASE WHEN mean = 0 AND value > 0 THEN 1.2 * {lp_sql('value', '(10.0::DOUBLE / 15)')} ELSE {lp_sql('value', 'mean')} END - o AS lp FROM pt0),
ptable AS (SELECT level, value, {soft_sql('lp', '-60.0')} AS lp FROM pt1)"""


def prob_table(spark, sf):
    """Poisson table over the value range of the data, with its own offset."""
    h = X.hx(spark, sf)
    n = cut_lineage(h.groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    mean = scalar(n, F.sum(F.col("value") * F.col("n")) / F.sum("n"))
    off = scalar(P.auto_offset(n.withColumn("_mean", mean), "_mean"), F.col("offset"))
    lo, hi = scalar(n, F.min("value")), scalar(n, F.max("value"))
    return P.poisson_table(spark, LEVELS, lo, hi, high=10.0, offset=off)


@query("poisson_table", with_(HX, PTABLE, body=f"SELECT level, value, {S6('lp')} AS lp FROM ptable"))
def poisson_table(spark, sf):
    return prob_table(spark, sf).select("level", "value", r6("lp").alias("lp"))


@query("auto_offset", with_(HX, "g AS (SELECT grp, avg(value) AS mean FROM hx GROUP BY grp)", body=f"""
SELECT grp, {S6('avg(' + lp_sql('value', 'mean') + ')')} AS "offset" FROM hx JOIN g USING (grp) GROUP BY grp"""))
def auto_offset(spark, sf):
    n = X.hx(spark, sf).groupBy("grp", "value").agg(F.count(F.lit(1)).alias("n"))
    mean = n.groupBy("grp").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    d = n.join(mean, "grp")
    from honeyframe.functions import tables as T

    s = F.sum(F.col("n") * T.log_poisson("value", "mean")) / F.sum("n")
    return d.groupBy("grp").agg(r6(s).alias("offset"))


_LV = """lvl AS (SELECT level, avg, CASE WHEN TRUE THEN {c} END AS std FROM (
  SELECT CAST(i AS BIGINT) AS level, lo + (hi - lo) * i / 11 AS avg FROM range(12) t(i), (SELECT min(avg) * 0.5 AS lo, max(avg) * 1.6 AS hi FROM moments)))"""
LVL = _LV.format(c=ST.curve_sql("avg"))


def _tables(spark, sf):
    h = ST.hist(spark, sf)
    m = cut_lineage(S.family_params(S.class_moments(h)))
    curve = S.curve_of(S.fit_std_curve(m))
    lv = P.level_means(spark, 12, scalar(m, F.min("avg")) * 0.5, scalar(m, F.max("avg")) * 1.6, curve)
    return cut_lineage(lv), h, m


_EMP = f"""lg AS (SELECT l.level, l.avg, l.std, h.value FROM lvl l, (SELECT DISTINCT value FROM hist) h),
br AS (SELECT lg.*, (SELECT arg_max(class, (m.avg, class)) FROM moments m WHERE m.avg <= lg.avg) AS ca, (SELECT arg_min(class, (m.avg, class)) FROM moments m WHERE m.avg >= lg.avg) AS cb FROM lg),
mx AS (SELECT b.*, a.avg AS aa, c.avg AS ba, greatest(ha.p, 0.001 * CASE WHEN b.value > b.avg THEN b.std / a.std ELSE a.std / b.std END / a.n) AS pa,
  greatest(hb.p, 0.001 * CASE WHEN b.value > b.avg THEN b.std / c.std ELSE c.std / b.std END / c.n) AS pb FROM br b LEFT JOIN moments a ON a.class = ca LEFT JOIN moments c ON c.class = cb
  LEFT JOIN hist ha ON ha.class = ca AND ha.value = b.value LEFT JOIN hist hb ON hb.class = cb AND hb.value = b.value),
fsrc AS (SELECT *, std AS sf FROM mx), fpar AS (SELECT * FROM {ST.fit_sql('fsrc')}),
pp AS (SELECT level, value, cb, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN (CASE WHEN ba = aa THEN pa ELSE (1 - (avg - aa) / (ba - aa)) * pa + (avg - aa) / (ba - aa) * pb END)
  ELSE {ST.d_gamma('(value + og)', 'f_k', 'f_theta')} END AS p FROM fpar),
emp AS (SELECT level, value, CASE WHEN cb IS NOT NULL THEN p / sum(p) OVER (PARTITION BY level) ELSE p END AS p FROM pp),
toff AS (SELECT sum(CASE WHEN p > 0 THEN w * p * ln(CASE WHEN p > 0 THEN p END) END) AS o FROM (SELECT p, sum(n) OVER (PARTITION BY class) / (sum(n) OVER ())::DOUBLE AS w FROM hist))"""


@query("empirical_table", with_(HX, ST.CLS, ST.FAM, ST.CURVE, ST.BEST, LVL, _EMP, body=f"""
SELECT level, value, CASE WHEN NOT isnan(p) THEN {S6('p')} END AS p, round(CASE WHEN p > 0 AND NOT isnan(p) THEN {soft_sql('(ln(CASE WHEN p > 0 THEN p END) - o)', '-20.0')} ELSE -40.0 END, 4) + 0.0 AS lp FROM emp, toff"""))
def empirical_table(spark, sf):
    lv, h, m = _tables(spark, sf)
    t = P.empirical_table(lv, h, m, family="gamma")
    lp = P.log_table(t, scalar(P.table_offset(h), F.col("offset")), -20.0)
    d = t.join(lp, ["level", "value"])
    return d.select("level", "value", r6("p").alias("p"), (F.round("lp", 4) + F.lit(0.0)).alias("lp"))


_STR = ST.stretched_sql("st", "(SELECT level, avg, std, value FROM lvl, (SELECT DISTINCT value FROM hist))", ["level"])


@query("stretched_table", with_(HX, ST.CLS, ST.FAM, ST.CURVE, ST.BEST, LVL, _STR, body=f"""
SELECT level, value, {S6('p / sum(p) OVER (PARTITION BY level)')} AS p FROM st"""))
def stretched_table(spark, sf):
    lv, h, m = _tables(spark, sf)
    return P.stretched_table(lv, h, m).select("level", "value", r6("p").alias("p"))


@query("tail_table", with_(HX, ST.CLS, ST.FAM, ST.CURVE, ST.BEST, LVL, """
ls AS (SELECT class, avg AS la, n AS ln FROM moments WHERE class = (SELECT max(class) FROM moments)),
tl AS (SELECT level, v.value, any_value(l.avg - la) AS sh, any_value(1.0 / ln) AS mn, sum(CASE WHEN v.value > h.value THEN w * greatest(h.p, 1.0 / ln) END) AS a, sum(CASE WHEN v.value > h.value THEN w END) AS w FROM (
  SELECT l.level, l.avg, v.value, h.value AS m, h.p, la, ln, """ + ST.d_exp("(v.value - h.value)", "(l.avg - la - 0.5)") + """ AS w
  FROM lvl l, (SELECT DISTINCT value FROM hist) v, ls JOIN hist h ON h.class = ls.class) l, (SELECT 1) q(one), LATERAL (SELECT l.value AS value) v, LATERAL (SELECT l.m AS value, l.p AS p) h GROUP BY level, v.value)""", body=f"""
SELECT level, value, {S6('p / sum(p) OVER (PARTITION BY level)')} AS p FROM (SELECT level, value, CASE WHEN sh >= 0 AND w > 0 THEN a / w ELSE mn END AS p FROM tl)"""))
def tail_table(spark, sf):
    lv, h, m = _tables(spark, sf)
    return P.tail_table(lv, h, m).select("level", "value", r6("p").alias("p"))


def _kernel(sigma):
    r = math.ceil(3 * sigma)
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return ", ".join(f"({i - r}, {v / sum(w)!r}::DOUBLE)" for i, v in enumerate(w))


@query("blur_rows", with_(HX, ST.CLS, f"k AS (SELECT * FROM (VALUES {_kernel(0.8)}) t(d, w))", body=f"""
SELECT a.class, a.value, {S6('sum(k.w * b.p)')} AS p FROM hist a, lim, k JOIN hist b ON b.class = a.class AND b.value = least(greatest(a.value + k.d, lo), hi) GROUP BY a.class, a.value"""))
def blur_rows(spark, sf):
    h = ST.hist(spark, sf).select("class", "value", "p")
    return P.blur_rows(h, 0.8, by="class").select("class", "value", r6("p").alias("p"))


_LVSQL = "CAST(least(15, greatest(0, round(({v} - 0.0) / 5.0 * 15))) AS BIGINT)"


@query("seed_models", with_(HX, ST.CLS, body=f"""
SELECT m, hp, level FROM (SELECT DISTINCT hp, class FROM cls) c JOIN (SELECT class, {_LVSQL.format(v='avg')} AS level FROM moments) USING (class), range(3) t(m)"""))
def seed_models(spark, sf):
    c = ST.classes(spark, sf)
    m = ST.moments(spark, sf)
    return P.seed_models(c, m, "class", "avg", 0.0, 5.0, LEVELS, 3)


@query("seed_models_mean", with_(HX, body=f"""
SELECT m, hp, level FROM (SELECT hp, {_LVSQL.format(v='avg(value)')} AS level FROM hx GROUP BY hp), range(2) t(m)"""))
def seed_models_mean(spark, sf):
    s = X.sf_pixels(spark, sf)
    return P.seed_models(s, S.sum_image(s), "hp", "mean", 0.0, 5.0, LEVELS, 2)


WEIGHTS = """weights AS (SELECT CAST(grp AS BIGINT) AS m, count(DISTINCT frame_id) / (SELECT count(DISTINCT frame_id) FROM hx)::DOUBLE AS weight FROM hx GROUP BY grp)"""


def weights(spark, sf):
    n = X.px(spark, sf).select("frame_id", F.col("grp").cast("long").alias("m")).distinct().groupBy("m").agg(
        F.count(F.lit(1)).alias("n")
    )
    n = cut_lineage(n)
    return n.select("m", (F.col("n") / scalar(n, F.sum("n"))).alias("weight"))


@query("rescale_models", with_(HX, MODELS, WEIGHTS, """
a AS (SELECT sum(weight * a) / sum(weight) AS now FROM (SELECT m, avg(level) AS a FROM models GROUP BY m) JOIN weights USING (m))""", body="""
SELECT m, hp, least(greatest(CAST(round(level * (9.0 / now)) AS BIGINT), 1), 15) AS level FROM models, a"""))
def rescale_models(spark, sf):
    return P.rescale_models(X.group_models(spark, sf), weights(spark, sf), 9.0, LEVELS)
