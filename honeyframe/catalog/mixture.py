"""Queries on the mixture model."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from honeyframe import fixtures as X
from honeyframe.catalog import query
from honeyframe.catalog.probability import LEVELS, PTABLE, WEIGHTS, prob_table, weights
from honeyframe.catalog.symmetry import SYMM, models_xz
from honeyframe.catalog.views import HX, MODELS, r6 as S6, with_, wrap_home
from honeyframe.functions.numbers import r6
from honeyframe.operators import mixture as M
from honeyframe.session import cut_lineage

N = X.RADIUS

LL = """ll AS (SELECT h.frame_id AS sf_id, m, sym, sum(lp) / ln(2) AS ll FROM hx h JOIN symm s ON s.hp_to = h.hp JOIN models o ON o.hp = s.hp
  JOIN ptable t ON t.value = h.value AND t.level = o.level GROUP BY ALL)"""
MARG = """mx AS (SELECT sf_id, m, max(ll) AS mx FROM ll GROUP BY ALL),
marg AS (SELECT sf_id, m, any_value(mx) + log2(sum(2 ** (ll - mx))) AS marg FROM ll JOIN mx USING (sf_id, m) GROUP BY ALL)"""
BASE = (HX, MODELS, SYMM, PTABLE, LL)
RESP = """sh AS (SELECT sf_id, m, marg, 2 ** (marg - max(marg) OVER (PARTITION BY sf_id)) AS e FROM marg),
resp AS (SELECT sf_id, m, marg, share, 2 / (1 + 100 * (1.1 - share) ** 2) AS contribution FROM (SELECT *, e / sum(e) OVER (PARTITION BY sf_id) AS share FROM sh))"""


def _tables(spark, sf):
    """Frames, models and table; the small ones written once."""
    return X.sf_pixels(spark, sf), models_xz(spark, sf), cut_lineage(prob_table(spark, sf))


def loglik(spark, sf):
    s, m, t = _tables(spark, sf)
    return M.baseline_loglik(s, m, t, N, N)


def _marg(spark, sf):
    return M.marginal_loglik(loglik(spark, sf))


def _state(spark, sf):
    """Everything a step needs, with the likelihoods written once."""
    s, m, t = _tables(spark, sf)
    ll = cut_lineage(M.baseline_loglik(s, m, t, N, N))
    return s, m, t, ll, cut_lineage(M.marginal_loglik(ll))


@query("lookup_logp", with_(HX, MODELS, PTABLE, body=f"""
SELECT frame_id AS sf_id, m, hp, value, level, {S6('lp')} AS lp FROM hx JOIN models USING (hp) JOIN ptable USING (level, value)"""))
def lookup_logp(spark, sf):
    d = M.lookup_logp(*_tables(spark, sf))
    return d.select("sf_id", "m", "hp", "value", "level", r6("lp").alias("lp"))


@query("orbit_loglik", with_(*BASE, body=f"SELECT sf_id, m, sym, {S6('ll')} AS ll FROM ll"))
def orbit_loglik(spark, sf):
    s, m, t = _tables(spark, sf)
    return M.orbit_loglik(s, m, t, N, N).select("sf_id", "m", "sym", r6("ll").alias("ll"))


@query("baseline_loglik", with_(*BASE, body=f"SELECT sf_id, m, sym, {S6('ll')} AS ll FROM ll"))
def baseline_loglik(spark, sf):
    return loglik(spark, sf).select("sf_id", "m", "sym", r6("ll").alias("ll"))


@query("marginal_loglik", with_(*BASE, MARG, body=f"SELECT sf_id, m, {S6('marg')} AS marg, {S6('mx')} AS best FROM marg JOIN mx USING (sf_id, m)"))
def marginal_loglik(spark, sf):
    ll = cut_lineage(loglik(spark, sf))
    a, b = M.marginal_loglik(ll), M.marginal_loglik(ll, "max").withColumnRenamed("marg", "best")
    return a.join(b, ["sf_id", "m"]).select("sf_id", "m", r6("marg").alias("marg"), r6("best").alias("best"))


@query("mixture_loglik", with_(*BASE, MARG, WEIGHTS, """
fr AS (SELECT sf_id, max(marg) AS best, log2(sum(weight * 2 ** (marg + 40))) - 40 AS mix FROM marg JOIN weights USING (m) GROUP BY sf_id)""", body="""
SELECT 'weighted' AS kind, round(sum(mix) - count(*) * log2(12), 3) AS total, count(*) AS frames FROM fr
UNION ALL SELECT 'best', round(sum(best) - count(*) * log2(12), 3), count(*) FROM fr"""))
def mixture_loglik(spark, sf):
    marg = cut_lineage(_marg(spark, sf))
    a = M.mixture_loglik(marg, weights(spark, sf), 12).withColumn("kind", F.lit("weighted"))
    b = M.mixture_loglik(marg, None, 12).withColumn("kind", F.lit("best"))
    return a.unionByName(b).select("kind", F.round("total", 3).alias("total"), "frames")


CASES = "cases AS (SELECT sf_id, arg_max(m, (round(marg, 9), -m)) AS m, max(marg) AS marg FROM marg GROUP BY sf_id)"


@query("assign_cases", with_(*BASE, MARG, CASES, body=f"SELECT sf_id, m, {S6('marg')} AS marg FROM cases"))
def assign_cases(spark, sf):
    return M.assign_cases(_marg(spark, sf)).select("sf_id", "m", r6("marg").alias("marg"))


@query("weights_from_cases", with_(*BASE, MARG, CASES, body=f"""
SELECT m, coalesce(c, 0) AS cases, {S6('coalesce(c, 0) / (SELECT count(*) FROM cases)')} AS weight FROM (SELECT DISTINCT m FROM models) LEFT JOIN (SELECT m, count(*) AS c FROM cases GROUP BY m) USING (m)"""))
def weights_from_cases(spark, sf):
    d = M.weights_from_cases(M.assign_cases(_marg(spark, sf)), models_xz(spark, sf))
    return d.select("m", "cases", r6("weight").alias("weight"))


@query("responsibilities", with_(*BASE, MARG, RESP, """
top AS (SELECT sf_id, min(m) AS a, max(m) AS b FROM (SELECT *, max(round(marg, 9)) OVER (PARTITION BY sf_id) AS t FROM marg) WHERE round(marg, 9) = t GROUP BY sf_id)""", body=f"""
SELECT sf_id, m, {S6('share')} AS share, {S6('contribution')} AS contribution, CAST(m = CASE WHEN sf_id % 2 = 1 THEN b ELSE a END AS INT) AS hard FROM resp JOIN top USING (sf_id)"""))
def responsibilities(spark, sf):
    marg = cut_lineage(_marg(spark, sf))
    a = M.responsibilities(marg)
    b = M.responsibilities(marg, hard=True).select("sf_id", "m", F.col("share").cast("int").alias("hard"))
    return a.join(b, ["sf_id", "m"]).select("sf_id", "m", r6("share").alias("share"), r6("contribution").alias("contribution"), "hard")


EM = """em AS (SELECT m, o.hp, sum(contribution * 2 ** (ll - marg) * value) AS s FROM resp JOIN ll USING (sf_id, m) JOIN symm o ON o.sym = ll.sym
   JOIN hx ON hx.frame_id = sf_id AND hx.hp = o.hp_to GROUP BY m, o.hp),
tw AS (SELECT m, sum(contribution) AS w FROM resp GROUP BY m),
emm AS (SELECT m, hp, s / w AS mean FROM em JOIN tw USING (m))"""
_LEV = "CAST(least(15, greatest(0, round(mean / 10.0 * 15))) AS BIGINT)"


@query("em_models", with_(*BASE, MARG, RESP.replace(".marg", ".marg"), EM.replace("ll - marg)", "ll.ll - resp.marg)"), body=f"SELECT m, hp, {S6('mean')} AS mean, {_LEV} AS level FROM emm"))
def em_models(spark, sf):
    s, m, t, ll, marg = _state(spark, sf)
    d = M.em_models(s, ll, M.responsibilities(marg), N, N, 0.0, 10.0, LEVELS)
    return d.select("m", "hp", r6("mean").alias("mean"), "level")


@query("em_pixel", with_(*BASE, MARG, RESP, EM.replace("ll - marg)", "ll.ll - resp.marg)"), body=f"SELECT m, hp, {S6('mean')} AS mean, {_LEV} AS level FROM emm WHERE (hp + m) % 5 = 0"))
def em_pixel(spark, sf):
    s, m, t, ll, marg = _state(spark, sf)
    px = m.filter((F.col("hp") + F.col("m")) % 5 == 0)
    d = M.em_pixel(s, ll, M.responsibilities(marg), px, N, N, 0.0, 10.0, LEVELS)
    return d.select("m", "hp", r6("mean").alias("mean"), "level")


@query("expected_histogram", with_(*BASE, """
po AS (SELECT sf_id, m, sym, e / sum(e) OVER (PARTITION BY sf_id) AS w FROM (SELECT *, 2 ** (ll - max(ll) OVER (PARTITION BY sf_id)) AS e FROM ll)),
eh AS (SELECT k.level, hx.value, sum(w) AS p FROM po JOIN symm o ON o.sym = po.sym JOIN hx ON hx.frame_id = sf_id AND hx.hp = o.hp_to JOIN models k ON k.m = po.m AND k.hp = o.hp GROUP BY ALL),
sz AS (SELECT level, count(*) AS n FROM models GROUP BY level)""", body=f"SELECT level, value, {S6('p / n')} AS p FROM eh JOIN sz USING (level)"))
def expected_histogram(spark, sf):
    s, m, t, ll, marg = _state(spark, sf)
    return M.expected_histogram(ll, s, m, N, N).select("level", "value", r6("p").alias("p"))


# -- edits ------------------------------------------------------------------------------

# ten edits per model: one pixel each, up by two or down by one, and its opposite
EDITS = """edits AS (SELECT m * 100 + k AS edit, m, hp, level AS old, CASE WHEN k % 2 = 0 THEN least(level + 2, 15) ELSE greatest(level - 1, 0) END AS new
  FROM models, range(4) t(k) WHERE hp % 24 = (m + k * 7) % 24)"""


def edits_of(m):
    k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    d = m.select("m", "hp", F.col("level").alias("old"), k).filter(F.col("hp") % 24 == (F.col("m") + F.col("k") * 7) % 24)
    new = F.when(F.col("k") % 2 == 0, F.least(F.col("old") + 2, F.lit(15))).otherwise(F.greatest(F.col("old") - 1, F.lit(0)))
    return d.select((F.col("m") * 100 + F.col("k")).alias("edit"), "m", "hp", "old", new.cast("long").alias("new"))


# the full recomputation: every edited model is evaluated from all its pixels
_SCORE = """em0 AS (SELECT DISTINCT edit, m FROM edits),
emod AS (SELECT e.edit, k.m, k.hp, coalesce(x.new, k.level) AS level FROM em0 e JOIN models k ON k.m = e.m LEFT JOIN edits x ON x.edit = e.edit AND x.hp = k.hp),
ell AS (SELECT h.frame_id AS sf_id, edit, any_value(m) AS m, sym, sum(lp) / ln(2) AS ll FROM hx h JOIN symm s ON s.hp_to = h.hp JOIN emod o ON o.hp = s.hp
  JOIN ptable t ON t.value = h.value AND t.level = o.level GROUP BY h.frame_id, edit, sym),
ema AS (SELECT sf_id, edit, m, max(ll) + log2(sum(2 ** (ll - q))) AS marg FROM (SELECT *, max(ll) OVER (PARTITION BY sf_id, edit) AS q FROM ell) GROUP BY sf_id, edit, m),
tot AS (SELECT e.edit, e.m, e.sf_id, log2(sum(weight * 2 ** (CASE WHEN k.m = e.m THEN e.marg ELSE k.marg END + 40))) - 40 AS a, log2(sum(weight * 2 ** (k.marg + 40))) - 40 AS b
  FROM ema e JOIN marg k ON k.sf_id = e.sf_id JOIN weights w ON w.m = k.m GROUP BY e.edit, e.m, e.sf_id),
score AS (SELECT edit, m, sum(a) AS total, sum(a) - sum(b) AS gain FROM tot GROUP BY edit, m)"""


def _scores(spark, sf):
    s, m, t, ll, marg = _state(spark, sf)
    e = cut_lineage(edits_of(m))
    return M.score_edits(s, ll, marg, e, t, N, N, weights(spark, sf)), e, m


@query("score_edits", with_(*BASE, MARG, WEIGHTS, EDITS, _SCORE, body="SELECT edit, m, round(total, 3) AS total, round(gain, 3) + 0.0 AS gain FROM score"))
def score_edits(spark, sf):
    d, _, _ = _scores(spark, sf)
    return d.select("edit", "m", F.round("total", 3).alias("total"), (F.round("gain", 3) + F.lit(0.0)).alias("gain"))


@query("accept_edits", with_(*BASE, MARG, WEIGHTS, EDITS, _SCORE, body="""
SELECT m, arg_max(edit, (round(gain, 9), -edit)) AS edit, round(max(gain), 3) AS gain FROM score WHERE round(gain, 9) > 0 GROUP BY m"""))
def accept_edits(spark, sf):
    d, _, _ = _scores(spark, sf)
    return M.accept_edits(d).select("m", "edit", F.round("gain", 3).alias("gain"))


_NBM = """nm0 AS (SELECT m, hp, level, x + dx AS nx, z + dz AS nz FROM models JOIN pos USING (hp), (SELECT a AS dx, b AS dz FROM range(-1, 2) t(a), range(-1, 2) u(b) WHERE abs(a) + abs(b) + abs(a + b) <= 2)),
nmw AS (SELECT m, o.hp, o.level, p.hp AS np FROM (""" + wrap_home("nm0", 4, "m, hp, level", "nx", "nz") + """) o JOIN pos p ON p.x = wx AND p.z = wz),
nmean AS (SELECT n.m, n.hp, any_value(n.level) AS level, CAST(round(avg(k.level)) AS BIGINT) AS mean FROM nmw n JOIN models k ON k.m = n.m AND k.hp = n.np GROUP BY n.m, n.hp)"""


@query("propose_steps", with_(HX, MODELS, "pos AS (SELECT DISTINCT hp, x, y, z FROM hx)", _NBM, """
tr AS (SELECT m, hp, level AS old, mean AS new, 0 AS trial FROM nmean UNION ALL SELECT m, hp, level, level + k, 2 * k - 1 FROM nmean, range(1, 6) t(k) UNION ALL SELECT m, hp, level, level - k, 2 * k FROM nmean, range(1, 6) t(k))""", body="""
SELECT m, hp, old, new, CAST(min(trial) AS BIGINT) AS trial FROM tr WHERE new <> old AND new BETWEEN 0 AND 15 GROUP BY ALL"""))
def propose_steps(spark, sf):
    m = models_xz(spark, sf)
    d = M.propose_steps(m, m, N, LEVELS)
    return d.select("m", "hp", "old", F.col("new").cast("long"), F.col("trial").cast("long"))


@query("refine_steps", with_(*BASE, MARG, WEIGHTS, EDITS, _SCORE, """
tr AS MATERIALIZED (SELECT e.m, hp, old, new, gain FROM edits e JOIN score USING (edit)),
rp AS (SELECT m, hp, new AS x, gain AS y FROM tr UNION ALL SELECT DISTINCT m, hp, old, 0.0 FROM tr),
rk AS (SELECT *, row_number() OVER (PARTITION BY m, hp ORDER BY y DESC, x) AS k FROM rp),
r3 AS (SELECT m, hp, max(x) FILTER (k = 1) AS x1, max(x) FILTER (k = 2) AS x2, max(x) FILTER (k = 3) AS x3,
  max(y) FILTER (k = 1) AS y1, max(y) FILTER (k = 2) AS y2, max(y) FILTER (k = 3) AS y3 FROM rk WHERE k <= 3 GROUP BY m, hp),
rd AS (SELECT *, nullif((x1 - x2) * (x2 - x3) * (x1 - x3), 0) AS det FROM r3),
rc AS (SELECT *, ((y1 - y2) * (x2 - x3) - (y2 - y3) * (x1 - x2)) / det AS a, ((y2 - y3) * (x1 + x2) * (x1 - x2) - (y1 - y2) * (x2 + x3) * (x2 - x3)) / det AS b FROM rd),
rv AS (SELECT m, hp, CASE WHEN coalesce(y1 > y2 AND y2 > y3 AND a < 0, FALSE) THEN -b / (2 * a) ELSE (x1 + coalesce(x2, x1)) / 2.0 END AS v FROM rc),
rf AS (SELECT m, hp, any_value(old) AS old, arg_max(new, (round(gain, 9), -new)) AS best, max(gain) AS g, max(abs(new - old)) AS far FROM tr GROUP BY m, hp)""", body="""
SELECT m, hp, old, CAST(least(greatest(CASE WHEN g > 0 AND abs(best - old) = far THEN old + 2 * (best - old) ELSE round(v) END, 0), 15) AS BIGINT) AS new,
  g > 0 AND abs(best - old) = far AS doubling FROM rf JOIN rv USING (m, hp)"""))
def refine_steps(spark, sf):
    d, e, m = _scores(spark, sf)
    trials = d.select("edit", "gain").join(e, "edit").select("m", "hp", "old", "new", "gain")
    return M.refine_steps(trials, LEVELS)


@query("propose_swaps", with_(HX, MODELS, "pos AS (SELECT DISTINCT hp, x, y, z FROM hx)", """
sw0 AS (SELECT a.hp, a.x + dx AS nx, a.z + dz AS nz FROM pos a, (SELECT a AS dx, b AS dz FROM range(-2, 3) t(a), range(-2, 3) u(b) WHERE abs(a) + abs(b) + abs(a + b) <= 4 AND (a <> 0 OR b <> 0))),
sw AS (SELECT DISTINCT o.hp, p.hp AS hp2 FROM (""" + wrap_home("sw0", 4, "hp", "nx", "nz") + """) o JOIN pos p ON p.x = wx AND p.z = wz WHERE o.hp < p.hp)""", body="""
SELECT a.m, a.hp, b.hp AS hp2, a.level, b.level AS level2 FROM sw JOIN models a ON a.hp = sw.hp JOIN models b ON b.m = a.m AND b.hp = hp2 WHERE a.level <> b.level"""))
def propose_swaps(spark, sf):
    return M.propose_swaps(models_xz(spark, sf), N, 2)


def _blob_sql(later):
    to = "k.level + trunc((new - old) / 2.0)" if later else "floor((k.level + new) / 2.0)"
    return f"""bl AS (SELECT edit, m, hp, new - old AS d FROM edits UNION ALL SELECT edit, e.m, k.hp, least(greatest({to}, 0), 15) - k.level FROM edits e
  JOIN (SELECT DISTINCT hp, np FROM nmw WHERE hp <> np) n ON n.hp = e.hp JOIN models k ON k.m = e.m AND k.hp = n.np WHERE trunc((new - old) / 2.0) <> 0),
bs AS (SELECT edit, m, hp, CAST(sum(d) AS BIGINT) AS d FROM bl GROUP BY ALL)"""


@query("propose_blobs", with_(HX, MODELS, "pos AS (SELECT DISTINCT hp, x, y, z FROM hx)", _NBM, EDITS, _blob_sql(False), body="""
SELECT edit, m, hp, level AS old, least(greatest(level + d, 0), 15) AS new FROM bs JOIN models USING (m, hp) WHERE least(greatest(level + d, 0), 15) <> level"""))
def propose_blobs(spark, sf):
    m = models_xz(spark, sf)
    return M.propose_blobs(edits_of(m), m, N, LEVELS)


@query("propose_blobs_later", with_(HX, MODELS, "pos AS (SELECT DISTINCT hp, x, y, z FROM hx)", _NBM, EDITS, _blob_sql(True), body="""
SELECT edit, m, hp, level AS old, least(greatest(level + d, 0), 15) AS new FROM bs JOIN models USING (m, hp) WHERE least(greatest(level + d, 0), 15) <> level"""))
def propose_blobs_later(spark, sf):
    m = models_xz(spark, sf)
    return M.propose_blobs(edits_of(m), m, N, LEVELS, later=True)


@query("model_difference", with_(HX, MODELS, EDITS, "nw AS (SELECT m, hp, max(new) AS new FROM edits GROUP BY m, hp)", body="""
SELECT m, hp, coalesce(new, level) - level AS difference FROM models LEFT JOIN nw USING (m, hp)"""))
def model_difference(spark, sf):
    m = models_xz(spark, sf)
    e = edits_of(m).groupBy("m", "hp").agg(F.max("new").alias("new"))
    return M.model_difference(M.apply_edits(m, e), m)


@query("active_pixels", with_(HX, MODELS, "pos AS (SELECT DISTINCT hp, x, y, z FROM hx)", _NBM, """
ac AS (SELECT m, hp, (hp * 37 + m * 11) % 160 - 20 AS activity, CASE m % 5 WHEN 0 THEN 'Finished' ELSE 'Continue' END AS state FROM models),
a1 AS (SELECT *, CAST(trunc(activity / 2.0) AS BIGINT) AS h FROM ac), a2 AS (SELECT *, state <> 'Finished' AND h >= 0 AS active FROM a1),
a3 AS (SELECT *, CASE WHEN active THEN h - 28 - (hp * 31 + m * 17) % 12 ELSE h END AS v FROM a2), a4 AS (SELECT *, active AND v <= 24 AS plain FROM a3),
ch AS (SELECT n.m, n.np AS hp, 2 * count(*) AS c FROM nmw n JOIN a4 ON a4.m = n.m AND a4.hp = n.hp WHERE plain GROUP BY ALL)""", body="""
SELECT m, hp, active, active AND NOT plain AS move_first, v - coalesce(c, 0) AS activity FROM a4 LEFT JOIN ch USING (m, hp)"""))
def active_pixels(spark, sf):
    m = models_xz(spark, sf)
    a = m.withColumn("activity", (F.col("hp") * 37 + F.col("m") * 11) % 160 - 20)
    st = m.select("m").distinct().withColumn("state", F.when(F.col("m") % 5 == 0, "Finished").otherwise("Continue"))
    return M.active_pixels(a, st, N)


_FACTORS = (0.5, 0.9, 1.0, 1.1, 2.0)
# two models that keep their weights
_HELD = "CASE m WHEN 2 THEN 'Fixed' WHEN 5 THEN 'Lattice' ELSE 'Continue' END"
_WT = f"""wst AS (SELECT m, weight, {_HELD} AS state FROM weights),
fre AS (SELECT m, weight FROM wst WHERE state = 'Continue'), kp AS (SELECT coalesce(sum(weight), 0) AS kept FROM wst WHERE state <> 'Continue')"""


def _held_weights(spark, sf):
    state = F.when(F.col("m") == 2, "Fixed").when(F.col("m") == 5, "Lattice").otherwise("Continue")
    return weights(spark, sf).withColumn("state", state)


_TRIED = """tv AS (SELECT tr.m, factor, t, k.m AS mk, CASE WHEN k.m = tr.m THEN t WHEN k.state <> 'Continue' THEN k.weight
    ELSE k.weight * (1 - t - kept) / (SELECT sum(weight) FROM fre WHERE fre.m <> tr.m) END AS wt FROM tr, wst k, kp),
ts AS (SELECT m, factor, t, sum(l) AS total FROM (SELECT tv.m, factor, t, sf_id, log2(sum(wt * 2 ** (marg + 40))) - 40 AS l FROM tv JOIN marg ON marg.m = mk GROUP BY ALL) GROUP BY ALL)"""


@query("weight_search", with_(*BASE, MARG, WEIGHTS, _WT, f"""
tr AS (SELECT m, f AS factor, least(greatest(weight * f, 0.0001), 0.9999) AS t FROM fre, (VALUES {', '.join(f'({f}::DOUBLE)' for f in _FACTORS)}) x(f))""", _TRIED, body="""
SELECT m, factor, round(t, 6) AS weight, round(total, 3) AS total, row_number() OVER (PARTITION BY m ORDER BY round(total, 6) DESC, factor) = 1 AS best FROM ts"""))
def weight_search(spark, sf):
    d = M.weight_search(_marg(spark, sf), _held_weights(spark, sf), _FACTORS)
    return d.select("m", "factor", r6("weight").alias("weight"), F.round("total", 3).alias("total"), "best")


_GRID = 200


@query("best_weights", with_(*BASE, MARG, WEIGHTS, _WT, f"""
tr AS (SELECT m, g AS factor, 0.0001 + g * {0.9998 / _GRID!r}::DOUBLE AS t FROM fre, range({_GRID + 1}) x(g))""", _TRIED, body="""
SELECT m, CAST(arg_max(factor, (round(total, 6), -factor)) AS BIGINT) AS place, round(max(total), 3) AS total FROM ts WHERE t + (SELECT kept FROM kp) < 1 GROUP BY m"""))
def best_weights(spark, sf):
    """The best weight of each free model by Newton steps, and from it the best place on
    a grid: as the likelihood is concave, one of the two places beside it."""
    marg, w = cut_lineage(_marg(spark, sf)), _held_weights(spark, sf)
    step = 0.9998 / _GRID
    kept = w.filter("state <> 'Continue'").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    at = M.best_weights(marg, w).select("m", ((F.col("weight") - 0.0001) / step).alias("p"))
    near = at.select("m", F.explode(F.array(F.floor("p"), F.floor("p") + 1)).alias("place")).filter((F.col("place") <= _GRID) & (0.0001 + F.col("place") * step + kept < 1))
    near = near.withColumn("weight", 0.0001 + F.col("place") * step)
    t = M.weight_totals(M.weight_terms(marg, w), near).join(near, ["m", "weight"])
    best = t.groupBy("m").agg(F.max(F.struct(F.round("total", 6).alias("r"), (-F.col("place")).alias("p"))).alias("b"))
    return best.select("m", (-F.col("b.p")).alias("place"), F.round("b.r", 3).alias("total"))


@query("accept_ties", with_(HX, MODELS, "pos AS (SELECT DISTINCT hp, x, y, z FROM hx)", _NBM, EDITS, """
sc AS (SELECT e.*, (m * 7 + hp * 13 + new) % 5 - 3.0::DOUBLE AS gain, abs(new - mean) < abs(old - mean) AS smooths FROM edits e JOIN nmean USING (m, hp)),
th AS (SELECT *, gain > 0 OR (gain = 0 AND smooths) AS good, row_number() OVER (PARTITION BY m, hp ORDER BY gain DESC, edit) AS place FROM sc QUALIFY place <= 3)""", body="""
SELECT 'pixel' AS kind, m, hp, edit, gain, place, good FROM th
UNION ALL SELECT 'model', m, NULL, arg_max(edit, (gain, -edit)), max(gain), NULL, NULL FROM sc WHERE gain > 0 OR (gain = 0 AND smooths) GROUP BY m"""))
def accept_ties(spark, sf):
    """The three best trials of each pixel, and the best of each model, with ties that
    only count where they smooth. Gains are made from the places."""
    m = models_xz(spark, sf)
    e = M.smoothing(edits_of(m), m, N)
    e = e.withColumn("gain", (F.col("m") * 7 + F.col("hp") * 13 + F.col("new")) % 5 - F.lit(3.0))
    e = cut_lineage(e)
    px = M.best_three(e, "smooths").select(F.lit("pixel").alias("kind"), "m", "hp", "edit", "gain", F.col("place").cast("long").alias("place"), "good")
    return px.unionByName(M.accept_edits(e, "smooths").select(F.lit("model").alias("kind"), "m", "edit", "gain"), allowMissingColumns=True)


def _clone_sql(n):
    if n == 0:
        new = "SELECT CASE WHEN m > 4 THEN m - 3 ELSE m END AS m, hp, level, weight FROM b WHERE m NOT BETWEEN 2 AND 4"
    elif n == 1:
        new = "SELECT CASE m WHEN 2 THEN 4 WHEN 4 THEN 2 ELSE m END AS m, hp, level, weight FROM b"
    else:
        new = f"""SELECT CASE WHEN m > 4 THEN m + 3 * {n - 1} WHEN m < 2 THEN m ELSE 2 + (m - 2) * {n} + c END AS m, hp, level,
          CASE WHEN m NOT BETWEEN 2 AND 4 THEN weight WHEN c = 0 THEN weight * (1 - weight) ELSE weight * weight / {n - 1} END AS weight
          FROM b, range({n}) t(c) WHERE c = 0 OR m BETWEEN 2 AND 4"""
    return with_(HX, MODELS, WEIGHTS, "b AS (SELECT m, hp, level, weight FROM models JOIN weights USING (m))", f"n AS ({new})",
                 "s AS (SELECT sum(w) AS s FROM (SELECT m, any_value(weight) AS w FROM n GROUP BY m))", body=f"SELECT m, hp, level, {S6('weight / s')} AS weight FROM n, s")


def _clone(spark, sf, n):
    m, w = M.clone_models(X.group_models(spark, sf), weights(spark, sf), 2, 4, n)
    return m.join(w, "m").select("m", "hp", "level", r6("weight").alias("weight"))


@query("clone_models", _clone_sql(3))
def clone_models(spark, sf):
    return _clone(spark, sf, 3)


@query("clone_models_delete", _clone_sql(0))
def clone_models_delete(spark, sf):
    return _clone(spark, sf, 0)


@query("clone_models_swap", _clone_sql(1))
def clone_models_swap(spark, sf):
    return _clone(spark, sf, 1)


BEAM = [(0, 0, 6), (1, 0, 2), (0, 1, 2), (-1, 1, 2), (-1, 0, 2), (0, -1, 2), (1, -1, 2), (2, -1, 1), (-1, -1, 1)]
_BM = f"""bm(dx, dz, w) AS (VALUES {', '.join(str(b) for b in BEAM)}),
bc0 AS (SELECT m, level, w, x + dx AS nx, z + dz AS nz FROM models JOIN pos USING (hp), bm),
bc AS (SELECT m, p.hp, CAST(sum(level * w) AS BIGINT) AS s FROM ({wrap_home('bc0', 4, 'm, level, w', 'nx', 'nz')}) o JOIN pos p ON p.x = wx AND p.z = wz GROUP BY ALL)"""


@query("beam_convolve", with_(HX, MODELS, "pos AS (SELECT DISTINCT hp, x, y, z FROM hx)", _BM, body=f"SELECT m, hp, s AS sum, (s + {sum(b[2] for b in BEAM) // 2}) // {sum(b[2] for b in BEAM)} AS level FROM bc"))
def beam_convolve(spark, sf):
    from honeyframe.functions import hexgrid as H

    d = M.beam_convolve(models_xz(spark, sf), BEAM, N)
    return d.select("m", H.hex_index("x", "z", N).alias("hp"), "sum", "level")


@query("beam_update", with_(HX, MODELS.replace("models AS", "models0 AS"), EDITS.replace("FROM models,", "FROM models0,"), "pos AS (SELECT DISTINCT hp, x, y, z FROM hx)",
       "models AS (SELECT o.m, o.hp, coalesce(e.new, o.level) AS level FROM models0 o LEFT JOIN (SELECT m, hp, max(new) AS new FROM edits GROUP BY m, hp) e ON e.m = o.m AND e.hp = o.hp)", _BM,
       body=f"SELECT m, hp, s AS sum, (s + {sum(b[2] for b in BEAM) // 2}) // {sum(b[2] for b in BEAM)} AS level FROM bc"))
def beam_update(spark, sf):
    from honeyframe.functions import hexgrid as H

    m = models_xz(spark, sf)
    e = edits_of(m).groupBy("m", "hp", "old").agg(F.max("new").alias("new")).join(m.select("m", "hp", "x", "z"), ["m", "hp"])
    d = M.beam_update(M.beam_convolve(m, BEAM, N), e, BEAM, N)
    return d.select("m", H.hex_index("x", "z", N).alias("hp"), "sum", "level")


def _rot_sql(k, steps):
    phi = -k * math.pi / (3 * steps)
    d, t, s = (1 + 2 * math.cos(phi)) / 3, (1 - math.cos(phi)) / 3, math.sin(phi) / math.sqrt(3)
    p, mi = t + s, t - s
    return f"""fr0 AS (SELECT m, level, x * {d!r}::DOUBLE + y * {mi!r}::DOUBLE + z * {p!r}::DOUBLE AS a, x * {mi!r}::DOUBLE + y * {p!r}::DOUBLE + z * {d!r}::DOUBLE AS b FROM models JOIN pos USING (hp)),
fr1 AS (SELECT *, CAST(floor(a + 1e-6) AS BIGINT) AS xl, CAST(floor(b + 1e-6) AS BIGINT) AS zl FROM fr0),
fr2 AS (SELECT m, xl + i AS nx, zl + j AS nz, level * CASE i WHEN 1 THEN greatest(a - xl, 0) ELSE 1 - greatest(a - xl, 0) END * CASE j WHEN 1 THEN greatest(b - zl, 0) ELSE 1 - greatest(b - zl, 0) END AS v FROM fr1, range(2) t(i), range(2) u(j)),
fr3 AS (SELECT m, p.hp, sum(v) AS v FROM ({wrap_home('fr2', 4, 'm, v', 'nx', 'nz')}) o JOIN pos p ON p.x = wx AND p.z = wz GROUP BY ALL)"""


@query("fractional_rotation", with_(HX, MODELS, "pos AS (SELECT DISTINCT hp, x, y, z FROM hx)", _rot_sql(1, 3), body=f"SELECT m, hp, {S6('v')} AS value, CAST(round(v) AS BIGINT) AS level FROM fr3"))
def fractional_rotation(spark, sf):
    from honeyframe.functions import hexgrid as H

    d = M.fractional_rotation(models_xz(spark, sf), 1, 3, N)
    return d.select("m", H.hex_index("x", "z", N).alias("hp"), r6("value").alias("value"), "level")


@query("reconstruct")
def reconstruct(spark, sf):
    """Expectation and edit rounds from the group means: the history, the final models and
    the final weights. Model 0 is the lattice and stays."""
    s, m, t = _tables(spark, sf)
    w = weights(spark, sf).withColumn("state", F.when(F.col("m") == 0, "Lattice").otherwise("Continue"))
    models, shares, history = M.reconstruct(s, m.select("m", "hp", "level"), w, t, N, N, 0.0, 10.0, LEVELS)
    rounds = spark.createDataFrame(
        [("round", h["round"], h["phase"], h["total"], h["accepted"], h["edits"]) for h in history],
        "kind string, round int, phase string, total double, accepted boolean, edits int",
    )
    return (
        rounds.unionByName(models.select(F.lit("model").alias("kind"), "m", "hp", "level"), allowMissingColumns=True)
        .unionByName(shares.select(F.lit("weight").alias("kind"), "m", "weight", "state"), allowMissingColumns=True)
    )
