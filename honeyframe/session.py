"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "honeyframe") -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: the cluster's ``spark.checkpoint.dir`` where it
    is set, a temporary folder only for a local master."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = os.path.join(tempfile.gettempdir(), f"honeyframe-ckpt-{uuid.uuid4().hex[:8]}")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table beside the checkpoints and read it back.

    Survives the loss of an executor and keeps the plan of an iterative job
    from growing with its rounds. Unlike a checkpoint of rows it is computed
    once, and its size is known to the planner of the next step.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Store:
    """Tables of rounds: written beside the checkpoints like those of
    ``cut_lineage``, and deleted once no later plan reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{checkpoint_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path, _ = self.paths.pop(id(t), (None, None))
            if path is not None:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition with the session's shuffle width.

    An explicit number keeps adaptive execution from merging the partitions of
    a small table that is about to be expanded many times.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def apart(df: DataFrame) -> DataFrame:
    """A side that grows with the input, for a join that is never a broadcast. The planner
    goes by the bytes of the files, which are packed and do not show rows that are made on
    the way (lists, copies, corners), and would send such a side through the driver."""
    return df.hint("merge")


def parts_for(count: int, spark: SparkSession, rows: int = 250_000) -> int:
    """The session's shuffle width, or more for at most about ``rows`` rows in a partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // rows))


class Buckets:
    """Tables that many rounds join by the same keys: written beside the checkpoints in
    ``n`` hash buckets, so that a join shuffles only the rows of its round. They are known
    to the session under made-up names until ``drop``; their files stay."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    def write(self, df: DataFrame, n: int, *keys: str) -> DataFrame:
        """``df`` has ``n`` hash partitions by the keys, so that a task writes a bucket."""
        name = f"buckets_{uuid.uuid4().hex}"
        self.names.append(name)
        df.write.format("parquet").bucketBy(n, *keys).option("path", f"{checkpoint_dir(self.spark)}/table-{name}").saveAsTable(name)
        return apart(self.spark.table(name))

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def spread_rows(df: DataFrame, *keys: str, rows: int = 250_000) -> DataFrame:
    """``spread``, but with at most about ``rows`` rows in a partition however large the
    table is; for tables whose rows are about to become many."""
    return df.repartition(parts_for(df.count(), df.sparkSession, rows), *keys)


def bounded(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast a side that is written and measured first (rows times the width
    of its columns); a larger one is returned as it is, for a shuffled join."""
    d = cut_lineage(df)
    return F.broadcast(d) if d.count() * d._jdf.schema().defaultSize() <= max_bytes else d


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once for each application. Spark
    copies the file; a job that was submitted with the package loses nothing."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="honeyframe-"), "honeyframe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("honeyframe", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
