"""Queries on readers and writers: the input is written from the
given tables first, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from honeyframe import fixtures as X
from honeyframe.catalog import query
from honeyframe.catalog.frames import square
from honeyframe.catalog.report import BIN_SQL, RULE_SQL, report_rows, weight_rows
from honeyframe.catalog.topology import MESH, SIGNATURES, signature_lines
from honeyframe.catalog.views import HX, PT, PX, RP, r6 as S6, with_
from honeyframe.functions.numbers import r6
from honeyframe.operators import reports as R, topology as T
from honeyframe.session import Buckets, apart, checkpoint_dir, cut_lineage, parts_for
from honeyframe.sources import images as I, tables as S


def scratch(spark) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


def _text(lines, path):
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)
    return path


@query("scan_images", with_(PX, body="""
SELECT concat(lpad(CAST(frame_id AS VARCHAR), 8, '0'), '.tif') AS name, q AS x, r AS y, CAST(value AS DOUBLE) AS value FROM px"""))
def scan_images(spark, sf):
    path = scratch(spark)
    plain = path.removeprefix("file:")
    I.write_images(square(spark, sf), plain, 8, 8).count()
    d = I.scan_images(spark, path, r"^\d+\.tif$", (8, 8)).filter("ok")
    return d.select("name", F.col("x").cast("long"), F.col("y").cast("long"), "value")


@query("write_frame_products", with_(PX, "q AS (SELECT frame_id, avg(CASE WHEN mask = 1 THEN 1.0 ELSE 0 END) AS g FROM px GROUP BY frame_id)", body=f"""
SELECT frame_id, {S6('g')} AS graphene, CAST(sum(value) AS BIGINT) AS total, CAST(sum(mask) AS BIGINT) AS masks FROM px JOIN q USING (frame_id) WHERE g >= 0.8 GROUP BY frame_id, g"""))
def write_frame_products(spark, sf):
    p, path = square(spark, sf), scratch(spark)
    q = p.groupBy("frame_id").agg(F.avg((F.col("mask") == 1).cast("double")).alias("graphene"))
    S.write_frame_products(p.drop("mask"), p.drop("value"), q.withColumn("success", F.col("graphene") >= 0.8), path)
    prep, mask, rep = (spark.read.parquet(f"{path}/{n}") for n in ("prep", "mask", "report"))
    d = rep.join(prep.groupBy("frame_id").agg(F.sum("value").alias("total")), "frame_id")
    d = d.join(mask.groupBy("frame_id").agg(F.sum("mask").alias("masks")), "frame_id")
    return d.select("frame_id", r6("graphene").alias("graphene"), "total", "masks")


@query("read_frame_report", with_(RP, body=f"""
SELECT label, copy, hex_merit, hex_avg, contrast, CAST(n_sf AS INT) AS nsf FROM (
 SELECT label, 0 AS copy, * EXCLUDE label FROM rp UNION ALL SELECT label, 1, * EXCLUDE label FROM rp)"""))
def read_frame_report(spark, sf):
    """Two data lines follow each of the header lines, whose order changes."""
    r = X.rp(spark, sf)
    s = {c: F.col(c).cast("string") for c in ("label", "hex_merit", "hex_avg", "contrast", "n_sf")}
    a = F.concat(F.lit("#label\thex_merit\thex_avg\tcontrast(std/mean)\tNsf\tstate"))
    b = F.concat(F.lit("#label,Nsf,contrast,hex_merit,hex_avg,state"))

    def row(k):
        k = F.lit(str(k))
        return F.when(F.col("frame_id") % 2 == 0, F.concat_ws("\t", s["label"], s["hex_merit"], s["hex_avg"], s["contrast"], s["n_sf"], k)).otherwise(
            F.concat_ws(",", s["label"], s["n_sf"], s["contrast"], s["hex_merit"], s["hex_avg"], k))

    line = F.concat_ws("\n", F.when(F.col("frame_id") % 2 == 0, a).otherwise(b), row(0), F.lit(""), F.lit("# note"), row(1))
    d = S.read_frame_report(spark, _text(r.select(line.alias("line")), scratch(spark)))
    return d.select("label", F.col("state").alias("copy"), "hex_merit", "hex_avg", "contrast", F.col("Nsf").alias("nsf"))


@query("write_frame_report", with_(RP, body="SELECT label, hex_merit, hex_avg, CAST(n_sf AS INT) AS nsf FROM rp WHERE frame_id % 23 <> 0"))
def write_frame_report(spark, sf):
    path = scratch(spark)
    d = report_rows(spark, sf).withColumnRenamed("n_sf", "Nsf").withColumn("grp", F.col("frame_id") % 3)
    S.write_frame_report(d, path)
    return S.read_frame_report(spark, path).select("label", "hex_merit", "hex_avg", F.col("Nsf").alias("nsf"))


@query("read_bin_rules", with_(RP, body="""
SELECT label AS name, CASE WHEN frame_id % 3 = 0 THEN NULL ELSE hex_merit END AS lower_hex_std, hex_avg AS upper_hex_std, CASE WHEN frame_id % 2 = 0 THEN contrast END AS lower_hex_avg,
  CAST(NULL AS DOUBLE) AS upper_hex_avg FROM rp"""))
def read_bin_rules(spark, sf):
    r, k = X.rp(spark, sf), F.col("frame_id")

    def bound(key, value):
        return F.concat(F.lit(f"#{key} "), value.cast("string"))

    line = F.concat_ws("\n", F.concat(F.lit("#sub_stack "), F.col("label")), bound("lower_hex_std", F.when(k % 3 == 0, F.lit(-1.0)).otherwise(F.col("hex_merit"))),
                       F.lit("ignored line"), bound("upper_hex_std", F.col("hex_avg")), F.when(k % 2 == 0, bound("lower_hex_avg", F.col("contrast"))))
    d = S.read_bin_rules(spark, _text(r.select(line.alias("line")), scratch(spark)))
    return d.select("name", "lower_hex_std", "upper_hex_std", "lower_hex_avg", "upper_hex_avg")


@query("read_filter_rules", with_(RP, body="""
SELECT CASE frame_id % 3 WHEN 0 THEN 'contrast' WHEN 1 THEN 'hex_avg' ELSE concat('key', frame_id) END AS key, frame_id % 2 = 0 AS invert, hex_merit AS low,
  CASE WHEN frame_id % 5 = 0 THEN NULL ELSE hex_avg END AS high, frame_id % 3 <> 2 AS known FROM rp"""))
def read_filter_rules(spark, sf):
    k = F.col("frame_id")
    key = F.when(k % 3 == 0, "contrast(std/mean)").when(k % 3 == 1, "hex_avg").otherwise(F.concat(F.lit("key"), k))
    line = F.concat(F.when(k % 2 == 0, "!").otherwise(""), key, F.lit("  "), F.col("hex_merit").cast("string"),
                    F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("\t"), F.col("hex_avg").cast("string"))), F.lit("\n# comment"))
    return S.read_filter_rules(spark, _text(X.rp(spark, sf).select(line.alias("line")), scratch(spark)))


@query("route_by_files", with_(RP, BIN_SQL, body=f"""
SELECT frame_id, CASE WHEN NOT ({RULE_SQL}) THEN 'filtered' ELSE coalesce(bin, 'uncategorized') END AS bin,
  ({RULE_SQL}) AND coalesce(n, 0) > 1 AS ambiguous
FROM rp LEFT JOIN (SELECT frame_id, min_by(bin, k) AS bin, count(*) AS n FROM hits GROUP BY frame_id) h USING (frame_id)"""))
def route_by_files(spark, sf):
    """Rules and bins as text files, read and applied to the report."""
    rules = ["# frame rules", "hex_avg 100 250", "!hex_avg 150 400", "contrast 0.1", "hex_merit -1e300 45"]
    bins = {"low": {"upper_hex_std": 20}, "mid": {"lower_hex_std": 15, "upper_hex_std": 60, "lower_hex_avg": 50, "upper_hex_avg": 300},
            "high": {"lower_hex_std": 60, "lower_hex_avg": 200}}
    lines = [x for name, bounds in bins.items() for x in (f"#sub_stack {name}", *(f"#{k} {v}" for k, v in bounds.items()))]
    paths = []
    for text in ("\n".join(rules), "\n".join(lines)):
        paths.append(_text(spark.createDataFrame([(text,)], "line string").coalesce(1), scratch(spark)))
    rule_list, bin_list = R.rules_from(S.read_filter_rules(spark, paths[0])), R.bins_from(S.read_bin_rules(spark, paths[1]))
    return R.route_frames(X.rp(spark, sf), rule_list, bin_list, 0.05).select("frame_id", "bin", "ambiguous")


@query("write_signatures", "WITH " + SIGNATURES + """
SELECT concat_ws(chr(9), view, seed, level, line) AS line FROM sg""")
def write_signatures(spark, sf):
    path = scratch(spark)
    S.write_signatures(signature_lines(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("model_weights_io", with_(RP, """
w AS (SELECT frame_id AS m, hex_merit AS weight, CASE WHEN frame_id % 10 = 0 THEN 'Fixed' WHEN frame_id % 10 = 1 THEN 'Lattice' WHEN frame_id % 10 = 2 THEN 'Finished' ELSE 'Continue' END AS state FROM rp)""", body="""
SELECT m, CASE WHEN m % 4 = 3 THEN 0.25 ELSE weight END AS weight, CASE WHEN m % 4 = 3 THEN 'Reset' ELSE state END AS state FROM w"""))
def model_weights_io(spark, sf):
    w, path = weight_rows(spark, sf), scratch(spark)
    kept = w.filter(F.col("m") % 4 != 3)
    S.write_weights(kept.withColumn("state", F.when(F.col("state") != "Continue", F.col("state")).otherwise("")), path)
    return S.read_weights(spark, path, w.count(), 0.25)


@query("job_stats_io", with_(HX, "i AS (SELECT hp, CAST(sum(value) AS BIGINT) AS s FROM hx GROUP BY hp)", body="""
SELECT hp, s AS sum, (SELECT CAST(sum(s) AS BIGINT) FROM i) AS data_sum, (SELECT count(DISTINCT frame_id) FROM hx) AS frames, 0.0::DOUBLE AS model_min, 10.0::DOUBLE AS model_max FROM i"""))
def job_stats_io(spark, sf):
    path = scratch(spark)
    S.write_job_stats(X.sf_pixels(spark, sf), path, 0.0, 10.0)
    stats, image = S.read_job_stats(spark, path)
    one = stats.first()
    return image.select("hp", "sum").withColumns({c: F.lit(one[c]) for c in ("data_sum", "frames", "model_min", "model_max")})


@query("read_atoms_xyz", with_(PT, body="SELECT x, y, CAST(w AS DOUBLE) AS z FROM pt WHERE id % 7 <> 0"))
def read_atoms_xyz(spark, sf):
    k = F.col("id")
    tag = F.when(k % 7 == 0, "H").when(k % 2 == 0, "C").otherwise("ATOM")
    line = F.concat_ws(" ", tag, F.col("x").cast("string"), F.col("y").cast("string"), F.col("w").cast("string"))
    n = 8
    body = X.pt(spark, sf).select((k % n).alias("part"), k.alias("ord"), line.alias("line"))
    # each part file begins with the two head lines
    head = body.select("part").distinct().select("part", F.explode(F.array(F.lit(-2).cast("long"), F.lit(-1).cast("long"))).alias("ord"), F.lit("C 9 9 9").alias("line"))
    path = scratch(spark)
    body.unionByName(head).repartition(n, "part").sortWithinPartitions("part", "ord").select(F.col("line").alias("value"), "part").write.partitionBy("part").text(path)
    return S.read_atoms_xyz(spark, path).select("x", "y", "z")


@query("write_topology", with_(MESH, "ok AS (SELECT s.a, s.b FROM sides s JOIN rin x ON x.ring_id = r1 JOIN rin y ON y.ring_id = r2 WHERE n = 2 AND x.interior AND y.interior)", body="""
SELECT concat('MASTER\t', count(*)) AS line FROM atoms UNION ALL SELECT printf('ATOM\t%d\t1\t%.4f\t%.4f\t%.4f', atom_id, x, y, z) FROM atoms
UNION ALL SELECT concat('BOND\t', a, '\t', b) FROM ok UNION ALL SELECT concat('RING\t', string_agg(CAST(atom_id AS VARCHAR), '\t' ORDER BY seq)) FROM rings GROUP BY ring_id
UNION ALL SELECT 'VIEW\t0' UNION ALL SELECT printf('ATOM\t%d\t%.4f\t%.4f\t%.4f', CASE WHEN atom_id % 5 = 0 THEN -1 ELSE atom_id END, x, y, z) FROM atoms"""))
def write_topology(spark, sf):
    tables = Buckets(spark)  # rings stay where they are for all that is asked of them
    r = tables.write(X.mesh_rings(spark, sf), parts_for(X.table(spark, sf, "orders").count(), spark), "ring_id")
    a, b, sides = cut_lineage(X.mesh_atoms(spark, sf, r)), cut_lineage(X.mesh_bonds(spark, sf, r)), cut_lineage(T.bond_sides(r))
    inner = T.interior_rings(r, sides).filter("interior").select("ring_id")
    d = T.dual_edges(r, sides)
    for k in ("1", "2"):
        d = d.join(apart(inner.withColumnRenamed("ring_id", "ring" + k)), "ring" + k, "left_semi")
    nodes = a.select(F.col("atom_id").alias("master"), F.lit(1).alias("observers"), "x", "y", "z")
    views = a.select("view", "atom_id", F.when(F.col("atom_id") % 5 != 0, F.col("atom_id")).alias("master"), "x", "y", "z")
    path = scratch(spark)
    S.write_topology(S.topology_lines(nodes, b, r, views, d), path)
    tables.drop()
    return spark.read.text(path).select(F.col("value").alias("line"))
