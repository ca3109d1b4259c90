"""Queries on statistics, histograms and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from honeyframe import fixtures as X
from honeyframe.catalog import query
from honeyframe.catalog.views import HX, PT, PX, r6 as S6, with_, wrap_home
from honeyframe.functions import hexgrid as H, tables as T
from honeyframe.functions.numbers import r6
from honeyframe.operators import statistics as S
from honeyframe.operators.numbering import scalar
from honeyframe.session import cut_lineage


def _r(df, *names):
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, *[r6(n).alias(n) for n in names])


@query("frame_stats", with_(HX, body=f"""
SELECT sf_id, n, sum, min, max, {S6('mean')} AS mean, {S6('std')} AS std, nonzero,
  CASE WHEN sf_id IS NOT NULL THEN 2 * (1 + max - min) + nonzero END AS encoded FROM (
 SELECT frame_id AS sf_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS sum, min(value) AS min, max(value) AS max, avg(value) AS mean,
  stddev_pop(value) AS std, count(*) FILTER (value > 0) AS nonzero FROM hx GROUP BY GROUPING SETS ((frame_id), ()))"""))
def frame_stats(spark, sf):
    return _r(S.frame_stats(X.sf_pixels(spark, sf)), "mean", "std")


CLS = """cls AS (SELECT *, CASE m WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 + k WHEN 3 THEN 4 + k ELSE 6 + k END AS class FROM (
  SELECT *, greatest(abs(x), abs(y), abs(z)) AS m, least(abs(x), abs(y), abs(z)) AS k FROM hx)),
lim AS (SELECT min(value) AS lo, max(value) AS hi FROM cls),
hist AS (SELECT g.class, g.value, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.class) AS DOUBLE) AS p
  FROM (SELECT class, v AS value FROM (SELECT DISTINCT class FROM cls), lim, range(0, 100) t(v) WHERE v BETWEEN lo AND hi) g
  LEFT JOIN (SELECT class, value, count(*) AS n FROM cls GROUP BY class, value) c ON c.class = g.class AND c.value = g.value),
mom0 AS (SELECT class, CAST(sum(n) AS BIGINT) AS n, sum(p * value) AS avg, arg_max(value, (p, -value)) AS mode, max(p) AS peak FROM hist GROUP BY class),
mom AS (SELECT m.class, any_value(m.n) AS n, any_value(avg) AS avg, any_value(mode) AS mode, any_value(peak) AS peak,
  sum(p * (value - avg) ** 2) AS var, sum(p * (value - avg) ** 3) AS c3, sum(p * (value - avg) ** 4) AS c4 FROM hist h JOIN mom0 m ON m.class = h.class GROUP BY m.class),
moments AS (SELECT class, n, avg, mode, peak, var, sqrt(var) AS std, c3 / (var * sqrt(var)) AS skew, c4 / (var * var) AS kurtosis FROM mom)"""


def classes(spark, sf):
    return X.hx(spark, sf).withColumn("class", H.site_class("x", "y", "z", 4))


def hist(spark, sf):
    """The class histogram, written once: all that follows reads only it."""
    return cut_lineage(S.value_histogram(classes(spark, sf), "class", fill=True))


def moments(spark, sf):
    return S.class_moments(hist(spark, sf))


@query("value_histogram", with_(HX, CLS, body=f"SELECT class, value, n, {S6('p')} AS p FROM hist"))
def value_histogram(spark, sf):
    return _r(hist(spark, sf), "p")


@query("sum_image", with_(HX, body=f"SELECT hp, CAST(sum(value) AS BIGINT) AS sum, {S6('avg(value)')} AS mean FROM hx GROUP BY hp"))
def sum_image(spark, sf):
    return _r(S.sum_image(X.sf_pixels(spark, sf)), "mean")


@query("background_stats", with_(HX, "b AS (SELECT value, x, z FROM hx)", f"w AS ({wrap_home('b', 2, 'value')})", body=f"""
SELECT cells, {S6('m')} AS mean, {S6('sqrt(v)')} AS std, {S6('m * m / v')} AS k, {S6('v / m')} AS theta FROM (
 SELECT count(*) AS cells, avg(value) AS m, var_pop(value) AS v FROM w WHERE wx = 0 AND wz = 0)"""))
def background_stats(spark, sf):
    return _r(S.background_stats(X.sf_pixels(spark, sf), 2), "mean", "std", "k", "theta")


@query("masked_hex_mean", with_(HX, body=f"SELECT frame_id, {S6('avg(value) FILTER (mask = 1)')} AS hex_avg FROM hx GROUP BY frame_id"))
def masked_hex_mean(spark, sf):
    return _r(S.masked_hex_mean(X.hx(spark, sf)), "hex_avg")


@query("zscore_hex", with_(HX, body=f"""
SELECT frame_id, hp, {S6('(value - avg(value) OVER w) / stddev_pop(value) OVER w')} AS z_score FROM hx WINDOW w AS (PARTITION BY frame_id)"""))
def zscore_hex(spark, sf):
    return S.zscore_hex(X.hx(spark, sf)).select("frame_id", "hp", r6("z_score").alias("z_score"))


@query("subframe_intensity", with_(HX, body="""
SELECT frame_id % 20 AS sfq, frame_id // 20 AS sfr, CAST(sum(value) AS BIGINT) AS intensity FROM hx GROUP BY ALL"""))
def subframe_intensity(spark, sf):
    s = X.sf_pixels(spark, sf).withColumns({"sfq": F.col("sf_id") % 20, "sfr": F.floor(F.col("sf_id") / 20)})
    return S.subframe_intensity(s)


@query("center_of_mass_shift", with_(HX, "b AS (SELECT frame_id, value, x, z FROM hx)", f"w AS ({wrap_home('b', 3, 'frame_id, value')})", body=f"""
SELECT frame_id, {S6('sum(value * wx) / nullif(sum(value), 0)')} AS shift_x, {S6('sum(value * wz) / nullif(sum(value), 0)')} AS shift_z
FROM (SELECT frame_id, value, wx, wz FROM w WHERE abs(wx) + abs(wz) + abs(wx + wz) < 1 UNION ALL SELECT frame_id, 0, 0, 0 FROM w WHERE FALSE) GROUP BY frame_id"""))
def center_of_mass_shift(spark, sf):
    return _r(S.center_of_mass_shift(X.hx(spark, sf), 1), "shift_x", "shift_z")


@query("center_of_mass_shift_wide", with_(HX, body=f"""
SELECT frame_id, {S6('sum(value * x) / nullif(sum(value), 0)')} AS shift_x, {S6('sum(value * z) / nullif(sum(value), 0)')} AS shift_z
FROM hx WHERE abs(x) + abs(z) + abs(y) < 3 GROUP BY frame_id"""))
def center_of_mass_shift_wide(spark, sf):
    return _r(S.center_of_mass_shift(X.hx(spark, sf), 2), "shift_x", "shift_z")


@query("class_moments", with_(HX, CLS, body=f"""
SELECT class, n, {S6('avg')} AS avg, mode, {S6('peak')} AS peak, {S6('var')} AS var, {S6('std')} AS std, {S6('skew')} AS skew,
  {S6('kurtosis')} AS kurtosis FROM moments"""))
def class_moments(spark, sf):
    return _r(moments(spark, sf), "avg", "peak", "var", "std", "skew", "kurtosis")


FAM = """fam0 AS (SELECT *, (2 / skew) ** 2 AS g_k, std * skew / 2 AS g_theta, var - avg AS p_x0,
  6 * skew ** 2 + 4 AS ib, skew ** 2 AS g2,
  cbrt((skew * sqrt(4 + skew ** 2) + skew ** 2 + 2) / 2) AS t FROM moments),
fam1 AS (SELECT *, g_k * g_theta - avg AS g_x0,
  (ib + sqrt(CASE WHEN ib * ib - 4 * g2 * (9 * g2 - 8) >= 0 THEN ib * ib - 4 * g2 * (9 * g2 - 8) END)) / (2 * g2) AS ig_alpha,
  CASE WHEN skew > 0 THEN (4 * (g2 * var / 4 + var) + sqrt(16 * (g2 * var / 4 + var) ** 2 - g2 * var * (g2 * var + 4 * var - 1))) / (g2 * var / 2) END AS ib_c, (t * t - t + 1) / t AS u FROM fam0),
fam2 AS (SELECT *, sqrt(CASE WHEN ig_alpha >= 2 THEN ig_alpha - 2 END) AS ra,
  ib_c + 1 AS ib_beta, ib_c * (sqrt(1 + 4 * var * (ib_c - 1)) - 1) / 2 AS ib_alpha, ln(u) AS ln_var,
  ln(CASE WHEN u * u - u > 0 THEN var / (u * u - u) END) / 2 AS ln_mu FROM fam1),
fam AS (SELECT *, ra * (ig_alpha - 1) * std AS ig_beta, ra * std - avg AS ig_x0, ib_alpha / ib_c - avg AS ib_x0,
  exp(ln_mu + ln_var / 2) - avg AS ln_x0 FROM fam2)"""

_FCOLS = ("g_k", "g_theta", "p_x0", "g_x0", "ig_alpha", "ig_beta", "ig_x0", "ib_alpha", "ib_beta", "ib_x0", "ln_var", "ln_mu", "ln_x0")


@query("family_params", with_(HX, CLS, FAM, body=f"SELECT class, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in _FCOLS)} FROM fam"))
def family_params(spark, sf):
    d = S.family_params(moments(spark, sf))
    return d.select("class", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in _FCOLS])


CURVE = """c0 AS (SELECT avg(avg) AS x0, avg(std) AS y0, regr_slope(std, avg) AS k FROM moments),
pts AS (SELECT avg - x0 AS d, std AS y, x0, y0, k FROM moments, c0),
sm AS (SELECT any_value(x0) AS x0, any_value(y0) AS y0, any_value(k) AS k, count(*)::DOUBLE AS p0, sum(d) AS p1, sum(d ** 2) AS p2, sum(d ** 3) AS p3, sum(d ** 4) AS p4,
  sum(y * y) AS v0, sum(y * y * d) AS v1, sum(y * y * d * d) AS v2 FROM pts),
dt AS (SELECT *, p0 * (p2 * p4 - p3 * p3) - p1 * (p1 * p4 - p3 * p2) + p2 * (p1 * p3 - p2 * p2) AS dd FROM sm),
curves AS (SELECT 'const' AS kind, x0, y0 AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2 FROM dt UNION ALL SELECT 'linear', x0, y0, k, 0.0 FROM dt UNION ALL
  SELECT 'root', x0, (v0 * (p2 * p4 - p3 * p3) - p1 * (v1 * p4 - p3 * v2) + p2 * (v1 * p3 - p2 * v2)) / dd,
   (p0 * (v1 * p4 - p3 * v2) - v0 * (p1 * p4 - p3 * p2) + p2 * (p1 * v2 - v1 * p2)) / dd,
   (p0 * (p2 * v2 - v1 * p3) - p1 * (p1 * v2 - v1 * p2) + v0 * (p1 * p3 - p2 * p2)) / dd FROM dt),
fits AS (SELECT kind, c.x0, c0, c1, c2, sqrt(avg((y - CASE WHEN kind = 'root' THEN sqrt(greatest(c0 + c1 * d + c2 * d * d, 1e-6)) ELSE c0 + c1 * d + c2 * d * d END) ** 2)) AS rms
  FROM curves c, pts GROUP BY kind, c.x0, c0, c1, c2)"""


@query("fit_std_curve", with_(HX, CLS, CURVE, body=f"""
SELECT kind, {S6('x0')} AS x0, {S6('c0')} AS c0, {S6('c1')} AS c1, {S6('c2')} AS c2, {S6('rms')} AS rms,
  row_number() OVER (ORDER BY round(rms, 9), kind) = 1 AS best FROM fits"""))
def fit_std_curve(spark, sf):
    return _r(S.fit_std_curve(moments(spark, sf)), "x0", "c0", "c1", "c2", "rms")


def _ln(e):
    return f"ln(CASE WHEN {e} > 0 THEN {e} END)"


def _sq(e):
    return f"sqrt(CASE WHEN {e} > 0 THEN {e} END)"


def _lg(e):
    return f"lgamma(CASE WHEN {e} > 0 THEN {e} END)"


def d_pois(x, m):
    return f"coalesce(CASE WHEN {m} <= 0 THEN (CASE WHEN {x} = 0 THEN 1 ELSE 0 END) WHEN {x} < 0 THEN 0 WHEN {x} = 0 THEN exp(-({m})) ELSE exp({x} * {_ln(m)} - {m} - {_lg(f'({x} + 1)')}) END, 0)"


def d_exp(x, m):
    return f"CASE WHEN {m} <= 0 THEN (CASE WHEN {x} = 0 THEN 1 ELSE 0 END) WHEN {x} < 0 THEN 0 ELSE exp(-({x}) / {m}) / {m} END"


def d_gauss(x, m, s):
    return f"exp(-0.5 * (({x} - {m}) / {s}) ** 2) / (sqrt(2 * pi()) * {s})"


def d_gamma(x, k, t):
    def dens(v):
        return f"exp(({k} - 1) * {_ln(v)} - {k} * {_ln(t)} - {_lg(k)} - {v} / {t})"

    return f"CASE WHEN {x} < 0 THEN 0 WHEN {t} <= 0 THEN (CASE WHEN {x} = 0 THEN 1 ELSE 0 END) WHEN {x} = 0 AND {k} <= 1 THEN 1 - {dens('1.0')} WHEN {x} = 0 THEN 0 ELSE {dens(x)} END"


def d_invgamma(x, a, b):
    return f"CASE WHEN {x} <= 0 THEN 0 ELSE exp({a} * {_ln(b)} - {_lg(a)} - ({a} + 1) * {_ln(x)} - {b} / {x}) END"


def d_betaprime(x, a, b):
    return f"CASE WHEN {x} <= 0 THEN 0 ELSE exp(({a} - 1) * {_ln(x)} - ({a} + {b}) * {_ln(f'({x} + 1)')} - ({_lg(a)} + {_lg(b)} - {_lg(f'({a} + {b})')})) END"


def d_lognorm(x, mu, v):
    return f"CASE WHEN {x} <= 0 THEN 0 ELSE exp(-1 * (({_ln(x)} - {mu}) ** 2) / (2 * {v})) / ({x} * {_sq(f'(2 * pi() * {v})')}) END"


# the fitted std curve as a scalar expression of a mean
def curve_sql(a):
    return f"(SELECT CASE WHEN kind = 'root' THEN sqrt(greatest(c0 + c1 * ({a} - x0) + c2 * ({a} - x0) ** 2, 1e-6)) ELSE c0 + c1 * ({a} - x0) + c2 * ({a} - x0) ** 2 END FROM best)"


BEST = "best AS (SELECT * FROM fits ORDER BY round(rms, 9), kind LIMIT 1),\noff AS (SELECT avg(g_x0) AS og, avg(ig_x0) AS oig, avg(ib_x0) AS oib, avg(ln_x0) AS oln FROM fam)"


def fit_sql(src, avg="avg"):
    """fitted_params in SQL for the rows of ``src`` (avg, sf = fitted std)."""
    g, ig, ib, lnm = (f"(CASE WHEN {avg} + {o} > 0 THEN {avg} + {o} END)" for o in ("og", "oig", "oib", "oln"))
    return f"""(SELECT *, f_ig * (f_ialpha - 1) AS f_ibeta, CASE WHEN f_ib * (f_b2 - 1) > 0 THEN f_ib * (f_b2 - 1) END AS f_balpha, CASE WHEN f_b2 > 0 THEN f_b2 END AS f_bbeta,
  ln(f_ln) - f_lvar / 2 AS f_lmu FROM (SELECT *, sf * sf AS f_var, sf * sf - {avg} AS f_px0, sf * sf / f_g AS f_theta, f_g * f_g / (sf * sf) AS f_k,
  3 + {_sq('(9 - 4 * (2 - f_ig / (sf * sf)))')} AS f_ialpha, 2 + f_ib * (f_ib - 1) / (sf * sf) AS f_b2, ln(1 + sf * sf / (f_ln * f_ln)) AS f_lvar
  FROM (SELECT s.*, og, oig, oib, oln, {g} AS f_g, {ig} AS f_ig, {ib} AS f_ib, {lnm} AS f_ln FROM {src} s, off)))"""


def stretched_sql(name, targets, keys, minfactor="0.001"):
    """stretched_density in SQL; targets (keys, value, avg, std)."""
    kt = ", ".join(f"t.{k}" for k in keys)
    ks = ", ".join(keys)
    return f"""{name}0 AS (SELECT {kt}, t.value, s.class AS src, s.std / t.std AS k, s.avg - s.std / t.std * t.avg AS sh, s.n AS sn,
   {minfactor} * CASE WHEN t.value > t.avg THEN t.std / s.std ELSE s.std / t.std END / s.n AS mn FROM {targets} t, moments s),
{name} AS (SELECT {ks}, value, avg(a) AS p FROM (SELECT {ks}, q.value, src, avg(greatest(k * p, mn)) AS a FROM {name}0 q, lim l JOIN hist h ON h.class = src
   AND h.value BETWEEN least(greatest(floor(k * (q.value - 0.5) + sh), lo), hi) AND least(greatest(ceil(k * (q.value + 0.5) + sh), lo), hi)
   GROUP BY {', '.join(keys)}, q.value, src) GROUP BY {ks}, value)"""


def _pdf_sql():
    x = "value"
    parts = {
        "poisson": d_pois("floor(value + p_x0 + 0.5)", "var"), "gauss": d_gauss(x, "avg", "std"), "exp": d_exp(x, "avg"),
        "gamma": d_gamma("(value + og)", "g_k", "g_theta"), "invgamma": d_invgamma("(value + ig_x0)", "ig_alpha", "ig_beta"),
        "betaprime": d_betaprime("(value + ib_x0)", "ib_alpha", "ib_beta"), "lognorm": d_lognorm("(value + ln_x0)", "ln_mu", "ln_var"),
        "poisson_fit": d_pois("floor(value + f_px0 + 0.5)", "f_var"), "gauss_fit": d_gauss(x, "avg", "sf"),
        "gamma_fit": d_gamma("(value + og)", "f_k", "f_theta"), "invgamma_fit": d_invgamma("(value + oig)", "f_ialpha", "f_ibeta"),
        "betaprime_fit": d_betaprime("(value + oib)", "f_balpha", "f_bbeta"), "lognorm_fit": d_lognorm("(value + oln)", "f_lmu", "f_lvar"),
    }
    rows = " UNION ALL ".join(f"SELECT class, value, h, n, '{k}' AS family, {v} AS p FROM d" for k, v in parts.items())
    st = stretched_sql("st", "(SELECT m.class AS c, h.value, m.avg, m.std FROM moments m JOIN hist h ON h.class = m.class)", ["c"])
    return with_(HX, CLS, FAM, CURVE, BEST, f"fs AS (SELECT *, {curve_sql('avg')} AS sf FROM fam)", f"fp AS (SELECT * FROM {fit_sql('fs')})",
                 "d AS (SELECT h.value, h.p AS h, fp.* FROM hist h JOIN fp ON fp.class = h.class)", st,
                 f"long AS ({rows} UNION ALL SELECT c, st.value, hist.p, m.n, 'stretched', st.p FROM st JOIN hist ON hist.class = c AND hist.value = st.value JOIN moments m ON m.class = c)",
                 "per AS (SELECT class, family, any_value(n) AS n, CASE WHEN count(p) = count(*) THEN 1 - 2 * sum(abs(p - h)) / (sum(p) + 1) END AS score FROM long GROUP BY class, family)",
                 body="""SELECT class, family, round(score, 6) + 0.0 AS score FROM per UNION ALL
 SELECT NULL, family, round(CASE WHEN count(score) = count(*) THEN sum(n * score) / sum(n) END, 6) + 0.0 FROM per GROUP BY family""")


def match_scores(spark, sf):
    h = hist(spark, sf)
    m = S.class_moments(h)
    return S.pdf_match(h, S.family_params(m), S.curve_of(S.fit_std_curve(m)))


@query("pdf_match", _pdf_sql())
def pdf_match(spark, sf):
    return _r(match_scores(spark, sf), "score")


@query("order_classes", with_(HX, CLS, body=f"""
SELECT class, {S6('avg')} AS avg, row_number() OVER (ORDER BY round(avg, 9), class) AS place FROM moments"""))
def order_classes(spark, sf):
    return S.order_classes(moments(spark, sf)).select("class", r6("avg").alias("avg"), "place")


@query("ring_contrast", with_(HX, body=f"""
SELECT frame_id, {S6('avg(value) FILTER (m <= 1)')} AS hex_low, {S6('avg(value) FILTER (m > 2 AND m >= 4 * k)')} AS hex_high,
  {S6('avg(value)')} AS hex_avg, {S6('stddev_pop(value) / avg(value)')} AS contrast FROM (
 SELECT *, greatest(abs(x), abs(y), abs(z)) AS m, least(abs(x), abs(y), abs(z)) AS k FROM hx) GROUP BY frame_id"""))
def ring_contrast(spark, sf):
    return _r(S.ring_contrast(X.hx(spark, sf), 4), "hex_low", "hex_high", "hex_avg", "contrast")


@query("pearson", with_(HX, "gm AS (SELECT grp, hp, avg(value) AS g FROM hx GROUP BY grp, hp)", body=f"""
SELECT frame_id, count(*) AS n, {S6('coalesce(CASE WHEN stddev_pop(value) * stddev_pop(g) > 1e-12 THEN corr(value, g) END, 0)')} AS corr
FROM hx JOIN gm USING (grp, hp) WHERE value <> 5 GROUP BY frame_id"""))
def pearson(spark, sf):
    h = X.hx(spark, sf)
    g = h.groupBy("grp", "hp").agg(F.avg("value").alias("g"))
    d = h.withColumn("v", F.when(F.col("value") == 5, float("nan")).otherwise(F.col("value"))).join(g, ["grp", "hp"])
    return _r(S.pearson(d, ["frame_id"], "v", "g"), "corr")


@query("orientation_moments", with_(PT, """
m AS (SELECT id % 50 AS grp, sum(w * (x - 50) ** 2) / sum(w) AS xx, sum(w * (y - 50) ** 2) / sum(w) AS yy, sum(w * (x - 50) * (y - 50)) / sum(w) AS xy,
  sum(w * (x - 50) ** 4) / sum(w) AS x4, sum(w * (y - 50) ** 4) / sum(w) AS y4 FROM pt GROUP BY ALL),
e AS (SELECT *, (xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy * xy) AS large, (xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy * xy) AS small FROM m)""", body=f"""
SELECT grp, round(large, 4) AS large, round(small, 4) AS small, round(CASE WHEN a < 0 THEN a + pi() ELSE a END, 4) AS angle, {S6('sqrt((x4 / xx ** 2) ** 2 + (y4 / yy ** 2) ** 2)')} AS kurtosis,
  {S6('atan2(y4 / yy ** 2, x4 / xx ** 2)')} AS kurtosis_angle, {S6('sqrt(1 - (small / large) ** 2)')} AS excent
FROM (SELECT *, atan2(2 * xy, xx - yy) / 2 AS a FROM e)"""))
def orientation_moments(spark, sf):
    p = X.pt(spark, sf).select((F.col("id") % 50).alias("grp"), (F.col("x") - 50).alias("x"), (F.col("y") - 50).alias("y"), "w")
    d = S.orientation_moments(p, ["grp"])
    return d.select("grp", *[F.round(c, 4).alias(c) for c in ("large", "small", "angle")],
                    *[r6(c).alias(c) for c in ("kurtosis", "kurtosis_angle", "excent")])


_POLAR = """pol AS (SELECT id // 7 AS grp, id % 2000 AS k, atan2(y - 50.05::DOUBLE, x - 50.05::DOUBLE) AS t, 20 + w / 10.0::DOUBLE + 3 * cos(2 * atan2(y - 50.05::DOUBLE, x - 50.05::DOUBLE) - 1) AS r FROM pt)"""


@query("fit_ellipse", with_(PT, _POLAR, """
s AS (SELECT grp, count(*)::DOUBLE AS n, avg(r) AS mr, sum(1 / r ** 2) AS u, sum(cos(2 * t)) AS c, sum(sin(2 * t)) AS s, sum(cos(2 * t) ** 2) AS cc, sum(sin(2 * t) ** 2) AS ss,
  sum(cos(2 * t) * sin(2 * t)) AS cs, sum(cos(2 * t) / r ** 2) AS uc, sum(sin(2 * t) / r ** 2) AS us FROM pol GROUP BY grp),
k AS (SELECT *, n * (cc * ss - cs * cs) - c * (c * ss - cs * s) + s * (c * cs - cc * s) AS d FROM s),
o AS (SELECT *, (u * (cc * ss - cs * cs) - c * (uc * ss - cs * us) + s * (uc * cs - cc * us)) / nullif(d, 0) AS a0, (n * (uc * ss - cs * us) - u * (c * ss - cs * s) + s * (c * us - uc * s)) / nullif(d, 0) AS b0,
  (n * (cc * us - uc * cs) - c * (c * us - uc * s) + u * (c * cs - cc * s)) / nullif(d, 0) AS c0 FROM k),
q AS (SELECT *, sqrt(b0 * b0 + c0 * c0) AS amp, coalesce(n >= 3 AND abs(d) > 1e-9 AND a0 > sqrt(b0 * b0 + c0 * c0), FALSE) AS ok FROM o)""", body="""
SELECT grp, CAST(n AS BIGINT) AS n, round(CASE WHEN ok THEN 1 / sqrt(a0 - amp) ELSE mr END, 4) AS a, round(CASE WHEN ok THEN 1 / sqrt(a0 + amp) ELSE mr END, 4) AS b,
  round(CASE WHEN ok THEN (CASE WHEN atan2(-c0, -b0) < 0 THEN atan2(-c0, -b0) / 2 + pi() ELSE atan2(-c0, -b0) / 2 END) ELSE 0 END, 4) AS phi FROM q"""))
def fit_ellipse(spark, sf):
    p = X.pt(spark, sf)
    t = F.atan2(F.col("y") - 50.05, F.col("x") - 50.05)
    p = p.select(F.floor(F.col("id") / 7).alias("grp"), t.alias("theta"),
                 (20 + F.col("w") / F.lit(10.0) + 3 * F.cos(2 * t - 1)).alias("radius"))
    d = S.fit_ellipse(p, ["grp"])
    return d.select("grp", "n", *[F.round(c, 4).alias(c) for c in ("a", "b", "phi")])


@query("peak_asymmetry", with_(PT, "k AS (SELECT id // 6 AS grp, id % 6 AS peak, w + 1 AS v FROM pt)",
       "p AS (SELECT grp, max(v) FILTER (peak = 0) AS a, max(v) FILTER (peak = 1) AS b, max(v) FILTER (peak = 2) AS c, sum(v) AS t FROM k GROUP BY grp)", body=f"""
SELECT grp, {S6('sqrt((a - b) ** 2 + (a - c) ** 2 + (b - c) ** 2) / (a + b + c)')} AS asymmetry, {S6('1e5 / t')} AS coma FROM p"""))
def peak_asymmetry(spark, sf):
    p = X.pt(spark, sf).select(F.floor(F.col("id") / 6).alias("grp"), (F.col("id") % 6).alias("peak"), (F.col("w") + 1).alias("intensity"))
    return _r(S.peak_asymmetry(p, "grp"), "asymmetry", "coma")


@query("significance_report", with_(HX, """
md AS (SELECT CAST(grp AS BIGINT) AS m, hp, avg(value) AS i FROM hx GROUP BY ALL), si AS (SELECT hp, avg(value) AS mean FROM hx GROUP BY hp),
ca AS (SELECT CAST(grp AS BIGINT) AS m, count(DISTINCT frame_id) AS cases FROM hx GROUP BY ALL),
s AS (SELECT m, sum(i) AS counts, sum(abs(i - mean)) AS difference, sum(greatest(i - mean, 0)) AS plus, sum(greatest(mean - i, 0)) AS minus FROM md JOIN si USING (hp) GROUP BY m)""", body=f"""
SELECT m, {S6('counts')} AS counts, {S6('difference')} AS difference, {S6('plus')} AS plus, {S6('minus')} AS minus, {S6('cases / (SELECT count(DISTINCT frame_id)::DOUBLE FROM hx)')} AS weight, cases,
  {S6('difference / cases')} AS per_case, {S6('counts * cases / sum(counts * cases) OVER ()')} AS share FROM s JOIN ca USING (m)"""))
def significance_report(spark, sf):
    h = X.hx(spark, sf)
    m = F.col("grp").cast("long").alias("m")
    md = h.groupBy(m, "hp").agg(F.avg("value").alias("intensity"))
    cases = h.groupBy(m).agg(F.countDistinct("frame_id").alias("cases"))
    frames = h.agg(F.countDistinct("frame_id").alias("n"))
    w = cases.select("m", (F.col("cases") / scalar(frames, F.col("n"))).alias("weight"))
    d = S.significance_report(md, w, S.sum_image(X.sf_pixels(spark, sf)), cases)
    return _r(d, "counts", "difference", "plus", "minus", "weight", "per_case", "share")


@query("atom_summary", with_(PX, "a AS (SELECT frame_id, value - 4.5::DOUBLE AS w FROM px WHERE value >= 6 OR mask = 16)",
       "p AS (SELECT frame_id, CAST(sum(value) AS BIGINT) AS total, count(*) AS n FROM px GROUP BY frame_id)",
       "s AS (SELECT frame_id, count(*) FILTER (w > 0) AS n_pos, count(*) FILTER (w < 0) AS n_neg, sum(w) FILTER (w > 0) AS w_pos, sum(w) FILTER (w < 0) AS w_neg, avg(w) FILTER (w > 0) AS mean_pos, avg(w) FILTER (w < 0) AS mean_neg FROM a GROUP BY frame_id)", body=f"""
SELECT frame_id, total, coalesce(n_pos, 0) AS n_pos, coalesce(n_neg, 0) AS n_neg, coalesce(w_pos, 0) AS w_pos, coalesce(w_neg, 0) AS w_neg, {S6('mean_pos')} AS mean_pos, {S6('mean_neg')} AS mean_neg,
 {S6('(total - coalesce(w_pos, 0) - coalesce(w_neg, 0)) / n')} AS floor, {S6('100 * (coalesce(w_pos, 0) + coalesce(w_neg, 0)) / total')} AS coverage FROM p LEFT JOIN s USING (frame_id)"""))
def atom_summary(spark, sf):
    p = X.px(spark, sf)
    a = p.filter((F.col("value") >= 6) | (F.col("mask") == 16)).select("frame_id", (F.col("value") - F.lit(4.5)).alias("weight"))
    return _r(S.atom_summary(a, p), "mean_pos", "mean_neg", "floor", "coverage")


# -- scalar functions -----------------------------------------------------------------

@query("lgamma_lbeta", with_(PT, body=f"""
SELECT id, {S6('lgamma(x / 3 + 0.05)')} AS lg, {S6('lgamma(x / 9 + 0.1) + lgamma(y / 7 + 0.2) - lgamma(x / 9 + 0.1 + y / 7 + 0.2)')} AS lb FROM pt"""))
def lgamma_lbeta(spark, sf):
    x, y = F.col("x"), F.col("y")
    return X.pt(spark, sf).select(
        "id", r6(T.lgamma(x / 3 + 0.05)).alias("lg"), r6(T.lbeta(x / 9 + 0.1, y / 7 + 0.2)).alias("lb")
    )


@query("densities", with_(PT, "t AS (SELECT id, CAST(w AS DOUBLE) - 2 AS v, x / 10 - 0.5 AS a, y / 20 + 0.3 AS b FROM pt)", body=f"""
SELECT id, {S6(d_pois('v', 'a'))} AS p_poisson, {S6(d_exp('v', 'a'))} AS p_exp, {S6(d_gauss('v', 'a', 'b'))} AS p_gauss, {S6(d_gamma('v', 'b', '(a + 0.75)'))} AS p_gamma,
 {S6(d_invgamma('v', 'b', '(a + 0.75)'))} AS p_invgamma, {S6(d_betaprime('v', '(a + 0.75)', 'b'))} AS p_betaprime, {S6(d_lognorm('v', 'a', 'b'))} AS p_lognorm FROM t"""))
def densities(spark, sf):
    t = X.pt(spark, sf).select(
        "id", (F.col("w").cast("double") - 2).alias("v"), (F.col("x") / 10 - 0.5).alias("a"), (F.col("y") / 20 + 0.3).alias("b")
    )
    a, b, v = F.col("a"), F.col("b"), F.col("v")
    return t.select(
        "id", r6(T.p_poisson(v, a)).alias("p_poisson"), r6(T.p_exp(v, a)).alias("p_exp"), r6(T.p_gauss(v, a, b)).alias("p_gauss"),
        r6(T.p_gamma(v, b, a + 0.75)).alias("p_gamma"), r6(T.p_invgamma(v, b, a + 0.75)).alias("p_invgamma"),
        r6(T.p_betaprime(v, a + 0.75, b)).alias("p_betaprime"), r6(T.p_lognorm(v, a, b)).alias("p_lognorm"),
    )


@query("soft_floor", with_(PT, body=f"SELECT id, {S6('CASE WHEN lp < -60 THEN -60 * (1 + tanh((lp + 60) / -60)) ELSE lp END')} AS lp FROM (SELECT id, -x * 1.7 AS lp FROM pt)"))
def soft_floor(spark, sf):
    return X.pt(spark, sf).select("id", r6(T.soft_floor(-F.col("x") * 1.7, F.lit(-60.0))).alias("lp"))


@query("curves", with_(PT, body=f"""
SELECT id, {S6('0.5 + 3 * exp(-(((x - 40) / 20) ** 2 + ((y - 60) / 10) ** 2) / 2)')} AS g, {S6('0.2 * (x - 30.05) ** 2 + 1')} AS par, {S6('abs(7 / (x + 0.05) ** 2) + 2')} AS hyp FROM pt"""))
def curves(spark, sf):
    lit = F.lit
    return X.pt(spark, sf).select(
        "id", r6(T.gaussian2d("x", "y", lit(40.0), lit(60.0), lit(20.0), lit(10.0), lit(3.0), lit(0.5))).alias("g"),
        r6(T.parabola("x", lit(0.2), lit(30.05), lit(1.0))).alias("par"), r6(T.hyperbola(F.col("x") + 0.05, lit(7.0), lit(2.0))).alias("hyp"),
    )


@query("vec_geometry", with_(PT, body=f"""
SELECT id, {S6('abs(x * (y * x - x * w) - y * (1.5 * x - x * y) + w * (1.5 * w - y * y))')} AS roughness,
  {S6('(1 - 2 * (x + 10) / (x + y + w + 30)) * (1 - 2 * (y + 10) / (x + y + w + 30)) * (1 - 2 * (w + 10) / (x + y + w + 30))')} AS heron FROM pt"""))
def vec_geometry(spark, sf):
    x, y, w = F.col("x"), F.col("y"), F.col("w").cast("double")
    return X.pt(spark, sf).select(
        "id", r6(T.triple_roughness((x, y, w), (F.lit(1.5), y, x), (y, w, x))).alias("roughness"),
        r6(T.heron_shape(x + 10, y + 10, w + 10)).alias("heron"),
    )
