"""Text files whose lines depend on earlier lines.

Files are read in splits. Inside a split rows keep their order; what a split
needs from the ones before it is one small row per split, so a long file is
never read by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, ord, line); ord grows along a block."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("ord"), F.trim(F.col("value")).alias("line"),
    )


def carry_last(lines: DataFrame, mark: Column, value: Column, out: str, count: str) -> DataFrame:
    """Add the value of the last marked line up to here, and how many marked
    lines there were in the file, -1 based. A block is cut into chunks of up to 65,536
    lines, so no task sorts a whole one."""
    d = lines.withColumns({"_v": F.when(mark, value), "_k": F.when(mark, 1).otherwise(0), "_c": F.shiftright("ord", 16)})
    here = W.partitionBy("file", "block", "_c").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("file").orderBy("block", "_c").rowsBetween(W.unboundedPreceding, -1)
    s = d.groupBy("file", "block", "_c").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("ord"))).alias("_lv"), F.sum("_k").alias("_n")
    ).select(
        "file", "block", "_c", F.last("_lv", ignorenulls=True).over(before).alias("_pv"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_pn"),
    )
    d = d.withColumns({out: F.last("_v", ignorenulls=True).over(here), count: F.sum("_k").over(here)})
    d = d.join(s, ["file", "block", "_c"])
    return d.withColumns(
        {out: F.coalesce(out, "_pv"), count: (F.col(count) + F.col("_pn") - 1)}
    ).drop("_v", "_k", "_c", "_pv", "_pn")
