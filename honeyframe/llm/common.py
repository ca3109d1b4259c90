"""Shared pieces: written tables, row ids, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from honeyframe.session import checkpoint_dir

#: Rows of one task are numbered below its partition number.
ROW_BITS = 33


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(docs: DataFrame, keys: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id (null included) is among ``keys`` (one column),
    with all columns whatever their names."""
    name = f"id_{uuid.uuid4().hex}"
    return docs.join(keys.toDF(name), F.col(id_col).eqNullSafe(F.col(name)), "left_semi")


#: Rows of a few numbers that a task writes.
NARROW = 100_000


def few(df: DataFrame, rows: int, each: int = NARROW) -> DataFrame:
    """A small table of about ``rows`` rows in as few tasks as it needs, at least one for
    each core: every task writes a file, and rounds would write one for each partition."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def widths(spark: SparkSession) -> int:
    """Shuffle width of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Written:
    """Tables written below the shared checkpoint folder.

    ``write`` cuts the lineage; ``drop`` removes a table that no later plan
    reads, so that rounds do not fill the disk.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[str, DataFrame]] = {}

    def path(self) -> str:
        return f"{checkpoint_dir(self.spark)}/llm-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = self.path()
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, df: DataFrame | None) -> None:
        path, _ = self.paths.pop(id(df), (None, None))
        if path is not None:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def components(nodes: DataFrame, edges: DataFrame, store: Written) -> DataFrame:
    """Smallest reachable node of every node: ``(node, component)``.

    ``edges`` has ``a, b`` (any order, repeats allowed). Each round hooks every
    component to its smallest neighbour, jumps along the hooks to their roots
    and contracts; components at least halve where they have neighbours, so the
    rounds grow with the logarithm of the longest path. All state is written
    between rounds; hot nodes only meet aggregates and joins that Spark splits.
    Written edges are counted from their files.
    """
    most = edges.count()
    e = store.write(few(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), most
    ))
    labels = None
    while left := e.count():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = store.write(few(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), 2 * left))
        while True:
            up = hook.select(F.col("a").alias("to"), F.col("to").alias("top"))
            jumped = store.write(few(
                hook.select("a", "to").join(up, "to", "left").select("a", F.coalesce("top", "to").alias("to"), (F.col("top") < F.col("to")).alias("moved")), 2 * left
            ))
            moved = not jumped.where("moved").isEmpty()
            store.drop(hook)
            hook = jumped
            if not moved:
                break
        h = hook.select(F.col("a").alias("component"), F.col("to"))
        if labels is None:
            fresh = hook.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            fresh = labels.join(h, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        written = store.write(few(fresh, 2 * most))
        store.drop(labels)
        labels = written
        up_a = hook.select("a", F.col("to").alias("ta"))
        up_b = hook.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        nxt = store.write(few(
            e.join(up_a, "a").join(up_b, "b").where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), left
        ))
        store.drop(e)
        store.drop(hook)
        e = nxt
    store.drop(e)
    if labels is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
