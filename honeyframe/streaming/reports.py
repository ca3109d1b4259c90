"""Reports and sub-frames that arrive while frames are still worked on."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from honeyframe.functions.numbers import circular_mean
from honeyframe.operators.numbering import scalar


def _run(query):
    q = query.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def file_stream(spark: SparkSession, path: str, schema: StructType, per_batch: int | None = None) -> DataFrame:
    """All files that are there make one batch, unless the caller sets a number."""
    stream = spark.readStream.schema(schema)
    return (stream if per_batch is None else stream.option("maxFilesPerTrigger", per_batch)).parquet(path)


def stream_reports(reports: DataFrame, out: str, checkpoint: str) -> None:
    """Append every batch under its number. A replayed batch overwrites itself,
    so the log is exactly once; current_reports gives the open rows."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    _run(reports.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint))


def current_reports(spark: SparkSession, out: str, key: str = "label", order: tuple[str, ...] = ("run",)) -> DataFrame:
    """Newest row of each frame. A result of state 1 opens the frame, the next
    one (2) is final, anything else is done."""
    log = spark.read.parquet(out)
    cols = [c for c in log.columns if c != "batch"]
    newest = F.max_by(F.struct(*cols), F.struct(*order, "batch")).alias("r")
    d = log.groupBy(key).agg(newest, F.count(F.lit(1)).alias("results")).select("r.*", "results")
    return d.withColumn("status", F.when(F.col("results") == 1, "open").otherwise("done"))


def stream_group_means(reports: DataFrame, group: str, out: str, checkpoint: str) -> None:
    """Weighted means of each group, written whole under the number of the batch;
    ``current_means`` reads the newest, so a failed write loses nothing."""
    w = F.col("hex_merit") * F.col("hex_merit")
    d = reports.withColumns({"_w": w, "_t": F.col("tilt") % F.lit(math.pi / 3)})
    means = d.groupBy(group).agg(
        circular_mean("_t", "_w", 6).alias("mean_tilt"), (F.sum(F.col("_w") * F.col("hex_avg")) / F.sum("_w")).alias("mean_avg"),
        F.count(F.lit(1)).alias("frames"),
    )
    _run(means.writeStream.outputMode("complete").foreachBatch(
        lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint))


def current_means(spark: SparkSession, out: str) -> DataFrame:
    log = spark.read.parquet(out)
    return log.filter(F.col("batch") == scalar(log, F.max("batch"))).drop("batch")


def stream_histogram(sf_pixels: DataFrame, keys: list[str], out: str, checkpoint: str) -> None:
    """Counts (and with ``hp`` among the keys the sum image) after each batch:
    only changed rows are written, under the number of the batch."""
    agg = sf_pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"))
    _run(agg.writeStream.outputMode("update").foreachBatch(
        lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint))


def current_histogram(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    log = spark.read.parquet(out)
    return log.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"), F.max_by("sum", "batch").alias("sum"))
