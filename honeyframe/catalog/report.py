"""Queries on frame reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from honeyframe import fixtures as X
from honeyframe.catalog import query
from honeyframe.catalog.views import RP, r6 as S6, with_
from honeyframe.functions.numbers import r6
from honeyframe.operators import reports as R
from honeyframe.operators.numbering import number_rows

PI = "3.141592653589793"

RPX = RP + """,
rpx AS (SELECT *, 5.0::DOUBLE + (frame_id % 17) / 20.0::DOUBLE AS hel,
  (frame_id % 180 - 90 + 0.3::DOUBLE) * pi() / 180 AS "ellPhi",
  CAST(100 + frame_id % 7 AS DOUBLE) AS "ellA", CAST(100 + frame_id % 5 AS DOUBLE) AS "ellB",
  CAST(frame_id % 11 - 2 AS DOUBLE) AS hex_shape, (frame_id * 31 % 997) / 10.0::DOUBLE AS merit,
  CAST(frame_id % 70 - 3 AS DOUBLE) AS "offX", CAST(frame_id % 66 AS DOUBLE) AS "offY",
  frame_id % 4 AS resets, CASE WHEN frame_id % 23 = 0 THEN -2 ELSE 1 END AS state,
  (frame_id % 9) / 9.0::DOUBLE AS "mirrorQ", (frame_id % 8) / 8.0::DOUBLE AS "positionQ",
  CAST(frame_id % 6 AS DOUBLE) AS moment2, hex_avg * 1.5::DOUBLE AS uc_avg,
  (frame_id % 100) / 100.0::DOUBLE AS graphene, frame_id % 13 AS peaks FROM rp)"""


def report_rows(spark, sf):
    """Report rows with the lattice and quality columns filled in."""
    k = F.col("frame_id")
    return X.rp(spark, sf).withColumns(
        {
            "hel": F.lit(5.0) + (k % 17) / F.lit(20.0),
            "ellPhi": (k % 180 - 90 + F.lit(0.3)) * F.lit(3.141592653589793) / 180,
            "ellA": (100 + k % 7).cast("double"),
            "ellB": (100 + k % 5).cast("double"),
            "hex_shape": (k % 11 - 2).cast("double"),
            "merit": (k * 31 % 997) / F.lit(10.0),
            "offX": (k % 70 - 3).cast("double"),
            "offY": (k % 66).cast("double"),
            "resets": k % 4,
            "state": F.when(k % 23 == 0, -2).otherwise(1),
            "mirrorQ": (k % 9) / F.lit(9.0),
            "positionQ": (k % 8) / F.lit(8.0),
            "moment2": (k % 6).cast("double"),
            "uc_avg": F.col("hex_avg") * F.lit(1.5),
            "graphene": (k % 100) / F.lit(100.0),
            "peaks": k % 13,
        }
    )


@query("normalize_angles", with_(RPX, body=f"""
SELECT frame_id, {S6('t')} AS tilt, {S6('CASE WHEN p > pi() / 2 THEN p - pi() WHEN p <= -pi() / 2 THEN p + pi() ELSE p END')} AS phi,
  a, b FROM (SELECT frame_id, CASE WHEN r > pi() / 6 THEN r - pi() / 3 WHEN r <= -pi() / 6 THEN r + pi() / 3 ELSE r END AS t,
   greatest("ellA", "ellB") AS a, least("ellA", "ellB") AS b, atan2(sin(e), cos(e)) AS p FROM (
   SELECT *, tilt % (pi() / 3) AS r, CASE WHEN "ellB" > "ellA" THEN ("ellPhi" + pi() / 2) % pi() ELSE "ellPhi" END AS e FROM rpx))"""))
def normalize_angles(spark, sf):
    d = R.normalize_angles(report_rows(spark, sf))
    return d.select(
        "frame_id", r6("tilt").alias("tilt"), r6("ellPhi").alias("phi"),
        F.col("ellA").alias("a"), F.col("ellB").alias("b"),
    )


@query("angle_difference", with_(RPX, body=f"""
SELECT frame_id, {S6('CASE WHEN d > pi() THEN 2 * pi() - d ELSE d END')} AS diff
FROM (SELECT frame_id, abs(tilt - "ellPhi") AS d FROM rpx)"""))
def angle_difference(spark, sf):
    return report_rows(spark, sf).select(
        "frame_id", r6(R.angle_difference("tilt", "ellPhi")).alias("diff")
    )


@query("derive_report_columns", with_(RPX, body="""
SELECT frame_id, round(hex_avg * contrast, 9) AS hex_std, round(uc_avg * contrast, 9) AS uc_std,
 round("ellA" / "ellB", 9) AS excent, round("mirrorQ" * "positionQ", 9) AS "shapeQ",
 round(hex_shape / nullif(moment2, 0), 9) + 0.0 AS sym FROM rpx"""))
def derive_report_columns(spark, sf):
    d = R.derive_report_columns(report_rows(spark, sf))
    return d.select(
        "frame_id",
        *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("hex_std", "uc_std", "excent", "shapeQ", "sym")],
    )


_LABELS = """lab AS (SELECT frame_id, CASE frame_id % 5 WHEN 0 THEN label WHEN 1 THEN concat('img-', frame_id, '.dm3')
  WHEN 2 THEN concat(frame_id, '_1.5_-2.25') WHEN 3 THEN 'null' ELSE concat(frame_id, '_x_', frame_id, '.tiff') END AS label FROM rp)"""


def _labels(spark, sf):
    k, s = F.col("frame_id") % 5, F.col("frame_id").cast("string")
    return X.rp(spark, sf).select(
        "frame_id",
        F.when(k == 0, F.col("label"))
        .when(k == 1, F.concat(F.lit("img-"), s, F.lit(".dm3")))
        .when(k == 2, F.concat(s, F.lit("_1.5_-2.25")))
        .when(k == 3, F.lit("null"))
        .otherwise(F.concat(s, F.lit("_x_"), s, F.lit(".tiff"))).alias("label"),
    )


@query("parse_slice_label", with_(RP, _LABELS, body="""
SELECT frame_id, label, CASE WHEN ok THEN img ELSE frame_id END AS "imgID", CASE WHEN ok THEN sx ELSE 0 END AS "stageX",
 CASE WHEN ok THEN sy ELSE 0 END AS "stageY", CASE WHEN ok THEN coalesce(sn, 0) ELSE -1 END AS "stageN" FROM (
 SELECT *, coalesce(img IS NOT NULL AND sx IS NOT NULL AND sy IS NOT NULL, FALSE) AS ok FROM (
 SELECT frame_id, label, TRY_CAST(split_part(label, '_', 1) AS BIGINT) AS img, TRY_CAST(split_part(label, '_', 2) AS DOUBLE) AS sx,
  TRY_CAST(split_part(label, '_', 3) AS DOUBLE) AS sy, TRY_CAST(split_part(label, '_', 4) AS INT) AS sn FROM (
  SELECT frame_id, CASE WHEN label = 'null' THEN NULL ELSE regexp_replace(label, '\\.(tif|tiff|dm3)$', '') END AS label FROM lab)))"""))
def parse_slice_label(spark, sf):
    return R.parse_slice_label(_labels(spark, sf))


_RULES = [
    R.Rule("hex_avg", 100.0, 250.0), R.Rule("hex_avg", 150.0, 400.0, invert=True),
    R.Rule("contrast", 0.1, None), R.Rule("hex_merit", None, 45.0),
]
RULE_SQL = """((hex_avg > 100 AND hex_avg <= 250) OR NOT (hex_avg > 150 AND hex_avg <= 400))
  AND contrast > 0.1 AND hex_merit <= 45"""
_BINS = [
    R.Bin("low", None, 20.0, None, None), R.Bin("mid", 15.0, 60.0, 50.0, 300.0),
    R.Bin("high", 60.0, None, 200.0, None),
]
BIN_SQL = """bins(bin, k, ls, us, la, ua) AS (VALUES ('low', 1, NULL, 20.0, NULL, NULL),
  ('mid', 2, 15.0, 60.0, 50.0, 300.0), ('high', 3, 60.0, NULL, 200.0, NULL)),
hits AS (SELECT frame_id, bin, k FROM rp JOIN bins ON (ls IS NULL OR ls <= hex_std) AND (us IS NULL OR us > hex_std)
  AND (la IS NULL OR la <= hex_avg) AND (ua IS NULL OR ua > hex_avg) AND contrast >= 0.05)"""


@query("frame_bounds_filter", with_(RP, body=f"SELECT frame_id, {S6('hex_avg')} AS hex_avg FROM rp WHERE {RULE_SQL}"))
def frame_bounds_filter(spark, sf):
    return R.frame_bounds_filter(X.rp(spark, sf), _RULES).select("frame_id", r6("hex_avg").alias("hex_avg"))


@query("bin_frames", with_(RP, BIN_SQL, body="SELECT frame_id, bin FROM hits"))
def bin_frames(spark, sf):
    return R.bin_frames(X.rp(spark, sf), _BINS, 0.05).select("frame_id", "bin")


@query("route_frames", with_(RP, BIN_SQL, body=f"""
SELECT frame_id, CASE WHEN NOT ({RULE_SQL}) THEN 'filtered' ELSE coalesce(bin, 'uncategorized') END AS bin,
  ({RULE_SQL}) AND coalesce(n, 0) > 1 AS ambiguous
FROM rp LEFT JOIN (SELECT frame_id, min_by(bin, k) AS bin, count(*) AS n FROM hits GROUP BY frame_id) h USING (frame_id)"""))
def route_frames(spark, sf):
    return R.route_frames(X.rp(spark, sf), _RULES, _BINS, 0.05).select("frame_id", "bin", "ambiguous")


@query("quality_gate", with_(RPX, body="""
SELECT frame_id FROM rpx WHERE graphene >= 0.5 AND peaks >= 3 AND peaks <= 10 AND contrast >= 0.1"""))
def quality_gate(spark, sf):
    return R.quality_gate(report_rows(spark, sf), 0.5, 3, 10, 0.1).select("frame_id")


_MATCH = "CASE WHEN frame_id % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE contrast * 2 END"


@query("extract_by_match", with_(RP, body=f"""
SELECT frame_id, {S6('match')} AS match FROM (SELECT frame_id, {_MATCH} AS match FROM rp)
WHERE NOT isnan(match) AND NOT (match > 0.2 AND match <= 0.7)"""))
def extract_by_match(spark, sf):
    d = X.rp(spark, sf).withColumn(
        "match",
        F.when(F.col("frame_id") % 7 == 0, float("nan")).otherwise(F.col("contrast") * 2),
    )
    return R.extract_by_match(d, 0.2, 0.7, invert=True).select("frame_id", r6("match").alias("match"))


# One report per customer; its frames carry the label '<customer>_7'.
_REPS = """reps AS (SELECT o_custkey AS rep_id, concat('_', o_custkey, '_7') AS label, 2 + o_custkey % 9 AS n_sf
  FROM orders GROUP BY o_custkey)"""


def _reports(spark, sf):
    o = X.table(spark, sf, "orders").select("o_custkey").distinct()
    c = F.col("o_custkey")
    return o.select(
        c.alias("rep_id"), F.concat(F.lit("_"), c.cast("string"), F.lit("_7")).alias("label"),
        (2 + c % 9).alias("n_sf"),
    )


@query("join_by_label", with_(RP, _REPS, """
reps2 AS (SELECT rep_id, label FROM reps UNION ALL SELECT -1 - rep_id, concat('none', rep_id) FROM reps WHERE rep_id % 3 = 0)""",
       body="""
SELECT r.rep_id, r.label, min(p.frame_id) AS slice, min(p.frame_id) FILTER (p.frame_id % 2 = 0) AS mask_slice,
  min(p.frame_id) IS NULL AS missing
FROM reps2 r LEFT JOIN rp p ON contains(p.label, r.label) GROUP BY r.rep_id, r.label"""))
def join_by_label(spark, sf):
    reps = _reports(spark, sf).select("rep_id", "label")
    none = reps.filter(F.col("rep_id") % 3 == 0).select(
        (-1 - F.col("rep_id")).alias("rep_id"), F.concat(F.lit("none"), F.col("rep_id")).alias("label")
    )
    frames = X.rp(spark, sf).select(F.col("frame_id").alias("slice"), "label")
    d = R.join_by_label(reps.unionByName(none), frames, frames.filter(F.col("slice") % 2 == 0))
    return d.select("rep_id", "label", "slice", "mask_slice", "missing")


@query("assign_reports", with_(RP, _REPS, """
hit AS (SELECT p.frame_id AS slice, r.rep_id, r.n_sf, min(p.frame_id) OVER (PARTITION BY r.rep_id) AS f
  FROM rp p JOIN reps r ON contains(p.label, r.label))""", body="""
SELECT p.frame_id AS slice, max(h.rep_id) AS rep_id FROM rp p LEFT JOIN hit h
  ON h.slice = p.frame_id AND h.slice < f + h.n_sf * 50 GROUP BY p.frame_id"""))
def assign_reports(spark, sf):
    reps = _reports(spark, sf).withColumn("n_sf", F.col("n_sf") * 50)
    frames = X.rp(spark, sf).select(F.col("frame_id").alias("slice"), "label")
    return R.assign_reports(frames, reps).select("slice", "rep_id")


@query("upsert_by_label", with_(RP, body=f"""
SELECT label, arg_max(frame_id, side * 1000000000 + frame_id) AS frame_id,
  {S6('arg_max(hex_merit, side * 1000000000 + frame_id)')} AS hex_merit FROM (
 SELECT o_label AS label, frame_id, hex_merit, side FROM (
  SELECT concat('c', frame_id % 997) AS o_label, frame_id, hex_merit, 0 AS side FROM rp WHERE frame_id % 2 = 0
  UNION ALL SELECT concat('c', frame_id % 499), frame_id, hex_merit, 1 FROM rp WHERE frame_id % 2 = 1)) GROUP BY label"""))
def upsert_by_label(spark, sf):
    r = X.rp(spark, sf).select("frame_id", "hex_merit")
    k = F.col("frame_id")

    def side(parity, mod):
        return r.filter(k % 2 == parity).select(
            F.concat(F.lit("c"), (k % mod).cast("string")).alias("label"), "frame_id", "hex_merit"
        )

    d = R.upsert_by_label(side(0, 997), side(1, 499), ["frame_id"])
    return d.select("label", "frame_id", r6("hex_merit").alias("hex_merit"))


@query("circular_mean", with_(RPX, body=f"""
SELECT grp, {S6('atan2(sum(hex_merit * sin(6 * tilt)), sum(hex_merit * cos(6 * tilt))) / 6')} AS tilt60,
 {S6('atan2(sum(hex_merit * sin(2 * "ellPhi")), sum(hex_merit * cos(2 * "ellPhi"))) / 2')} AS phi180
FROM rpx GROUP BY grp"""))
def circular_mean(spark, sf):
    from honeyframe.functions.numbers import circular_mean as cm

    d = report_rows(spark, sf)
    return d.groupBy("grp").agg(
        r6(cm("tilt", "hex_merit", 6)).alias("tilt60"), r6(cm("ellPhi", "hex_merit", 2)).alias("phi180")
    )


_LOO = """w AS (SELECT *, CASE WHEN state <> -2 AND hex_shape > 0 AND hex_merit > 0 AND contrast > 0.1
   THEN hex_merit * hex_merit ELSE 0 END AS ww, CASE WHEN "ellPhi" < 0 THEN "ellPhi" + pi() ELSE "ellPhi" END AS ph FROM rpx),
tot AS (SELECT grp, sum(ww) AS sw, sum(CASE WHEN ww > 0 THEN 1 ELSE 0 END) AS n, sum(ww * hel) AS sh, sum(ww * "ellA") AS sa,
  sum(ww * "ellB") AS sb, sum(ww * cos(6 * (tilt % (pi() / 3)))) AS tc, sum(ww * sin(6 * (tilt % (pi() / 3)))) AS ts,
  sum(ww * cos(2 * ph)) AS pc, sum(ww * sin(2 * ph)) AS ps FROM w GROUP BY grp),
loo AS (SELECT w.*, (sh - ww * hel) / (sw - ww) AS mean_hel, (sa - ww * "ellA") / (sw - ww) AS mean_a, (sb - ww * "ellB") / (sw - ww) AS mean_b,
  atan2(ts - ww * sin(6 * (tilt % (pi() / 3))), tc - ww * cos(6 * (tilt % (pi() / 3)))) / 6 AS mean_tilt,
  atan2(ps - ww * sin(2 * ph), pc - ww * cos(2 * ph)) / 2 AS mean_phi FROM w JOIN tot USING (grp))"""


@query("leave_one_out_mean", with_(RPX, _LOO, body=f"""
SELECT frame_id, {S6('mean_hel')} AS mean_hel, {S6('mean_a')} AS "mean_ellA", {S6('mean_b')} AS "mean_ellB",
 round(mean_tilt, 4) + 0.0 AS mean_tilt, round(mean_phi, 4) + 0.0 AS mean_phi FROM loo"""))
def leave_one_out_mean(spark, sf):
    d = R.leave_one_out_mean(report_rows(spark, sf), "grp", 0.1)
    return d.select(
        "frame_id", *[r6(c).alias(c) for c in ("mean_hel", "mean_ellA", "mean_ellB")],
        *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("mean_tilt", "mean_phi")],
    )


@query("bad_frames", with_(RPX, _LOO, body=f"""
SELECT frame_id, bad, {S6('CASE WHEN bad THEN mean_hel ELSE hel END')} AS hel, CASE WHEN bad THEN 0 ELSE state END AS state,
  resets + CASE WHEN bad THEN 1 ELSE 0 END AS resets FROM (
 SELECT *, merit < 30 AND resets < 2 AND (hex_merit < 0 OR hel < 0.96 * mean_hel OR hel > 1.04 * mean_hel OR "offX" < 0 OR "offY" < 0
  OR "offX" > 64 OR "offY" > 64 OR abs((tilt - mean_tilt) % (pi() / 3)) > 0.05 OR hex_shape < 1) AS bad FROM loo)"""))
def bad_frames(spark, sf):
    d = R.bad_frames(report_rows(spark, sf), "grp", 64, 64, 0.1)
    return d.select("frame_id", "bad", r6("hel").alias("hel"), "state", "resets")


@query("unpivot_stats", with_(RPX, body=f"""
SELECT frame_id, metric, round(value, 9) + 0.0 AS value FROM (
 SELECT frame_id, unnest(['merit', 'n_sf', 'uc_avg', 'hex_avg', 'contrast', 'hex_std', 'tilt', 'hel', 'ellPhi', 'positionQ', 'mirrorQ',
   'hex_merit', 'hex_shape', 'moment2']) AS metric, unnest([merit, n_sf, uc_avg, hex_avg, contrast, hex_std, tilt, hel, "ellPhi", "positionQ",
   "mirrorQ", hex_merit, hex_shape, moment2]) AS value FROM rpx)"""))
def unpivot_stats(spark, sf):
    d = R.unpivot_stats(report_rows(spark, sf))
    return d.select("frame_id", "metric", (F.round("value", 9) + F.lit(0.0)).alias("value"))


_RUNS = """runs AS (SELECT frame_id, 1 AS run, hex_merit FROM rp UNION ALL
  SELECT frame_id, 2, hex_merit + (frame_id % 5) * 0.07::DOUBLE FROM rp UNION ALL
  SELECT frame_id, 3, hex_merit * (1 + (frame_id % 3) * 0.012::DOUBLE) FROM rp)"""


@query("rerun_state", with_(RP, _RUNS, body=f"""
SELECT frame_id, run, {S6('gain')} AS gain, CASE WHEN gain > 0.1 AND gain / hex_merit > 0.01 THEN 3 ELSE -1 END AS state,
 greatest(0, 6 - 2 * run) AS width_level, least(7, 1 + run) AS repeats FROM (
 SELECT *, hex_merit - lag(hex_merit) OVER (PARTITION BY frame_id ORDER BY run) AS gain FROM runs)"""))
def rerun_state(spark, sf):
    r = X.rp(spark, sf).select("frame_id", "hex_merit")
    k, m = F.col("frame_id"), F.col("hex_merit")
    runs = r.select("frame_id", F.explode(F.array(
        F.struct(F.lit(1).alias("run"), m.alias("hex_merit")),
        F.struct(F.lit(2).alias("run"), (m + (k % 5) * F.lit(0.07)).alias("hex_merit")),
        F.struct(F.lit(3).alias("run"), (m * (1 + (k % 3) * F.lit(0.012))).alias("hex_merit")),
    )).alias("s")).select("frame_id", "s.*")
    d = R.rerun_state(runs)
    return d.select("frame_id", "run", r6("gain").alias("gain"), "state", "width_level", "repeats")


@query("largest_bin", with_(RP, BIN_SQL, body="""
SELECT bin, count(*) AS n FROM hits GROUP BY bin ORDER BY n DESC, bin LIMIT 1"""))
def largest_bin(spark, sf):
    return R.largest_bin(R.bin_frames(X.rp(spark, sf), _BINS, 0.05))


@query("natural_sort", with_(RP, body="""
SELECT name, row_number() OVER (ORDER BY CAST(regexp_extract(name, '^f(\\d+)', 1) AS BIGINT),
  CAST(regexp_extract(name, '_(\\d+)_', 1) AS BIGINT)) - 1 AS place
FROM (SELECT concat('f', frame_id * 37 % 501, '_', frame_id, '_7.tif') AS name FROM rp)"""))
def natural_sort(spark, sf):
    k = F.col("frame_id")
    names = X.rp(spark, sf).select(
        F.concat(F.lit("f"), (k * 37 % 501).cast("string"), F.lit("_"), k.cast("string"), F.lit("_7.tif")).alias("name")
    )
    keyed = names.withColumn("_k", R.natural_key("name"))
    return number_rows(keyed, ["_k", "name"], "place").select("name", "place")


_W = """w AS (SELECT frame_id AS m, hex_merit AS weight, CASE WHEN frame_id % 10 = 0 THEN 'Fixed' WHEN frame_id % 10 = 1 THEN 'Lattice'
  WHEN frame_id % 10 = 2 THEN 'Finished' ELSE 'Continue' END AS state FROM rp)"""


def weight_rows(spark, sf):
    k = F.col("frame_id")
    return X.rp(spark, sf).select(
        k.alias("m"), F.col("hex_merit").alias("weight"),
        F.when(k % 10 == 0, "Fixed").when(k % 10 == 1, "Lattice").when(k % 10 == 2, "Finished")
        .otherwise("Continue").alias("state"),
    )


@query("normalize_weights", with_(RP, _W, body="""
SELECT m, state, round(CASE WHEN state IN ('Fixed', 'Lattice') THEN weight ELSE weight * (1 - held) / free END, 6) AS weight
FROM (SELECT m, state, CASE WHEN state IN ('Fixed', 'Lattice') THEN weight * 1e-5 ELSE weight END AS weight FROM w),
 (SELECT sum(weight * 1e-5) FILTER (state IN ('Fixed', 'Lattice')) AS held,
   sum(weight) FILTER (state NOT IN ('Fixed', 'Lattice')) AS free FROM w) t"""))
def normalize_weights(spark, sf):
    w = weight_rows(spark, sf)
    w = w.withColumn(
        "weight",
        F.when(F.col("state").isin("Fixed", "Lattice"), F.col("weight") * 1e-5).otherwise(F.col("weight")),
    )
    return R.normalize_weights(w).select("m", "state", r6("weight").alias("weight"))
