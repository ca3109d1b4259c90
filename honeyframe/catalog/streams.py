"""Queries on streams: the table arrives file by file."""

from __future__ import annotations

from pyspark.sql import functions as F

from honeyframe import fixtures as X
from honeyframe.catalog import query
from honeyframe.catalog.files import scratch
from honeyframe.catalog.views import HX, RP, r6 as S6, with_
from honeyframe.functions.numbers import r6
from honeyframe.streaming import reports as V


def _arrive(spark, df, files: int = 3):
    """Write a table as a few files and open it as a stream."""
    path = scratch(spark)
    df.repartition(files).write.parquet(path)
    return V.file_stream(spark, path, df.schema), path


_RUNS = """rr AS (SELECT frame_id, 1 AS run, hex_merit FROM rp UNION ALL SELECT frame_id, 2, hex_merit + 1 FROM rp WHERE frame_id % 3 <> 0)"""


@query("stream_reports", with_(RP, _RUNS, body=f"""
SELECT frame_id, max(run) AS run, {S6('arg_max(hex_merit, run)')} AS hex_merit, count(*) AS results, CASE count(*) WHEN 1 THEN 'open' ELSE 'done' END AS status FROM rr GROUP BY frame_id"""))
def stream_reports(spark, sf):
    r = X.rp(spark, sf).select("frame_id", "hex_merit")
    runs = r.select("frame_id", F.lit(1).alias("run"), "hex_merit").unionByName(
        r.filter(F.col("frame_id") % 3 != 0).select("frame_id", F.lit(2).alias("run"), (F.col("hex_merit") + 1).alias("hex_merit")))
    s, path = _arrive(spark, runs)
    V.stream_reports(s, path + "-out", path + "-ckpt")
    d = V.current_reports(spark, path + "-out", "frame_id")
    return d.select("frame_id", "run", r6("hex_merit").alias("hex_merit"), "results", "status")


@query("stream_group_means", with_(RP, "g AS (SELECT *, hex_merit * hex_merit AS w, tilt % (pi() / 3) AS t FROM rp)", body=f"""
SELECT grp, {S6('atan2(sum(w * sin(6 * t)), sum(w * cos(6 * t))) / 6')} AS mean_tilt, {S6('sum(w * hex_avg) / sum(w)')} AS mean_avg, count(*) AS frames FROM g GROUP BY grp"""))
def stream_group_means(spark, sf):
    s, path = _arrive(spark, X.rp(spark, sf).select("grp", "hex_merit", "hex_avg", "tilt"))
    V.stream_group_means(s, "grp", path + "-out", path + "-ckpt")
    d = V.current_means(spark, path + "-out")
    return d.select("grp", r6("mean_tilt").alias("mean_tilt"), r6("mean_avg").alias("mean_avg"), "frames")


@query("stream_histogram", with_(HX, body="""
SELECT 'value' AS kind, value AS key, count(*) AS n, CAST(sum(value) AS BIGINT) AS sum FROM hx GROUP BY value
UNION ALL SELECT 'hp', hp, count(*), CAST(sum(value) AS BIGINT) FROM hx GROUP BY hp"""))
def stream_histogram(spark, sf):
    out = None
    for kind in ("value", "hp"):
        s, path = _arrive(spark, X.sf_pixels(spark, sf).select("hp", "value"))
        V.stream_histogram(s.withColumn("key", F.col(kind)), ["key"], path + "-out", path + "-ckpt")
        d = V.current_histogram(spark, path + "-out", ["key"]).select(F.lit(kind).alias("kind"), "key", "n", "sum")
        out = d if out is None else out.unionByName(d)
    return out
