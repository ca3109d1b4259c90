"""Minimax contiguous partition of ordered atomic groups into shards.

Groups (equal texts) are ordered by the hash of their text. The smallest shard
capacity for which a greedy walk needs no more than the given shards is found by
search over the running sums of the group sizes; there the order is cut. Only
DataFrame operations are used. The driver holds sums and cut keys, never groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from honeyframe.llm.common import Written

#: Buckets of the hash range; sums over them are the only single-task window.
_BUCKET_BITS = 14
_SALTS = 1024


class RunningSums:
    """Ordered groups with their running sums, written once in range files, so
    that a look-up reads only the row groups around it."""

    def __init__(self, groups: DataFrame, store: Written):
        """``groups``: ``key`` (long, unique) and ``size``."""
        g = groups.withColumn("bucket", F.shiftright("key", 64 - _BUCKET_BITS))
        before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = (
            g.groupBy("bucket").agg(F.sum("size").alias("s"))
            .select("bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
        )
        inside = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = g.join(starts, "bucket").repartitionByRange("bucket").withColumn("upto", F.col("before") + F.sum("size").over(inside))
        self.table = store.write(placed.select("key", "size", "upto"))
        r = self.table.agg(F.max("upto"), F.max("size")).first()
        self.total, self.largest = r[0] or 0, r[1] or 0

    def at_most(self, limits: Sequence[int]) -> list[int]:
        """Largest running sum up to each limit; 0 where there is none."""
        near = None
        for t in limits:
            c = (F.col("upto") > t - self.largest) & (F.col("upto") <= t)
            near = c if near is None else near | c
        row = self.table.where(near).agg(*[
            F.max(F.when(F.col("upto") <= t, F.col("upto"))).alias(f"c{i}") for i, t in enumerate(limits)
        ]).first()
        return [r or 0 for r in row]

    def at_least(self, limit: int) -> int:
        """Smallest running sum from a limit on; 0 if the limit is not above 0."""
        if limit <= 0:
            return 0
        near = (F.col("upto") >= limit) & (F.col("upto") < limit + self.largest)
        return self.table.where(near).agg(F.min("upto")).first()[0]

    def keys(self, sums: Sequence[int]) -> dict[int, int]:
        """Key of the group that ends at each running sum."""
        wanted = sorted({s for s in sums if s > 0})
        return {r["upto"]: r["key"] for r in self.table.where(F.col("upto").isin(wanted)).collect()} if wanted else {}


def smallest_capacity(sums: RunningSums, shards: int, ways: int = 16) -> int:
    """Smallest capacity for which the greedy walk reaches the end.

    Between a bound that holds for any partition and one that any greedy walk
    meets, ``ways - 1`` capacities are walked side by side in each round, so a
    round divides the interval by ``ways``.
    """
    low = max(-(-sums.total // shards), sums.largest)
    high = max(low, sums.total // shards + sums.largest)
    while low < high:
        tries = sorted({low + (high - low) * i // ways for i in range(ways)})
        reached = [0] * len(tries)
        for _ in range(shards):  # no sum lies beyond the end, so a walk looks up to it at most
            reached = sums.at_most([min(r + c, sums.total) for r, c in zip(reached, tries)])
        good = [c for c, r in zip(tries, reached) if r == sums.total]
        bad = [c for c, r in zip(tries, reached) if r < sums.total]
        high = min(good, default=high)
        low = max([b for b in bad if b < high], default=low - 1) + 1
    return high


def cut_sums(sums: RunningSums, shards: int, capacity: int) -> list[int]:
    """Running sums at the ``shards - 1`` cuts: each as near to an even share as
    the capacity allows, no shard above the capacity."""
    earliest = [sums.total]
    for _ in range(shards - 1):
        earliest.append(sums.at_least(earliest[-1] - capacity))
    earliest = earliest[::-1]  # earliest[i]: smallest end of shard i
    cuts, last = [], 0
    for i in range(shards - 1):
        aim = min(max(sums.total * (i + 1) // shards, earliest[i]), last + capacity)
        below = sums.at_most([aim])[0]
        above = sums.at_least(min(aim, sums.total))
        nearer = above if above <= last + capacity and above - aim < aim - below else below
        last = max(nearer, earliest[i], last)
        cuts.append(last)
    return cuts


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, a row per row.

    The law is ``bytes``: sizes (UTF-8 bytes and one) are as even as whole groups
    of equal texts allow, since the largest shard is the smallest possible one
    for the order of the groups. A null text has size 1 and is in the group of
    the empty text. Slots number the rows of a shard without gaps; null ids and
    repeated rows have slots of their own. ``grown_shard`` is null under this
    law. A text of any length is one size and one digest. Other columns are not read; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    store = Written(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = store.write(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"),
    ))
    sums = RunningSums(slim.groupBy("key").agg(F.sum("size").alias("size")), store)
    shard = F.lit(0)
    if sums.total:
        cuts = cut_sums(sums, shards, smallest_capacity(sums, shards))
        at = sums.keys(cuts)
        for c in cuts:
            shard = shard + (F.lit(1) if c == 0 else (F.col("key") > at[c]).cast("int"))
    placed = slim.withColumns({"shard": shard.cast("int"), "salt": F.pmod(F.xxhash64("doc_id", "key"), F.lit(_SALTS))})
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "salt").orderBy("doc_id", "key")
    return placed.withColumn("nr", F.row_number().over(inside)).join(starts, ["shard", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("nr") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
