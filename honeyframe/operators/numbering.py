"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from honeyframe.session import cut_lineage


def number_rows(df: DataFrame, order: list, out: str, start: int = 0) -> DataFrame:
    """Number all rows by ``order``, which should end in a unique column.

    Range partitions are sorted in parallel and written once, so that their
    layout is fixed; only the row count of each partition goes to the driver.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(
        placed.withColumns({"_pid": F.spark_partition_id(), "_in": F.monotonically_increasing_id()})
    )
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()
    offset, total = {}, start
    for r in sorted(sizes, key=lambda r: r["_pid"]):
        offset[r["_pid"]] = total
        total += r["n"]
    if not offset:
        return placed.withColumn(out, F.lit(0).cast("long")).drop("_pid", "_in")
    starts = F.array(*[F.lit(offset.get(p, 0)).cast("long") for p in range(max(offset) + 1)])
    inside = F.col("_in").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(out, F.get(starts, F.col("_pid")) + inside).drop("_pid", "_in")


def scalar(df: DataFrame, value: Column) -> Column:
    """A one-row aggregate as a scalar subquery."""
    return df.select(value).scalar()
