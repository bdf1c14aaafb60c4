"""Scratch tables and connected components shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Whether Spark removes the shuffle files of a query when it ends, and not when the driver collects its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (tests) a temporary folder is made and
    kept for the session; on a cluster the setting is asked for.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if root:
        return root
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
    root = getattr(spark.sparkContext, "_notelake_scratch", None)
    if root is None:
        root = "file://" + tempfile.mkdtemp(prefix="spark-notelake-", dir="/tmp")
        spark.sparkContext._notelake_scratch = root
    return root


class Scratch:
    """Tables of one operator run, written to the shared folder to cut lineage.

    Written tables survive the loss of an executor, which block storage does not. Shuffle files of a
    table go when it is written, as nothing reads them again. ``drop`` removes a table that no later
    plan reads, so that loops hold two rounds at most.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.made}"
        self.made += 1
        before = self.spark.conf.get(CLEANUP_CONF, "false")
        self.spark.conf.set(CLEANUP_CONF, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP_CONF, before)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved.scratch_path = path
        return saved

    def drop(self, df: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession, scale: int = 1) -> int:
    """Partitions for a repartition by key: those of the session's shuffles, times ``scale``."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * scale)


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``; component is the smallest node.

    Alternates large-star and small-star steps. Each step joins edges with the minimum of their
    neighbourhood, so no neighbourhood is gathered in one place and a hub costs no more than its own
    edges. The loop ends when every component is a star around its smallest node. Null ends and self loops carry no information and are left out.
    """
    edges = (
        edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    current = scratch.save(edges)
    for _ in range(max_rounds):
        if _all_stars(current):
            break
        following = scratch.save(_small_star(_large_star(current)))
        scratch.drop(current)
        current = following
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _all_stars(e: DataFrame) -> bool:
    """True when each larger end has one edge and no smaller end is a larger one elsewhere."""
    roles = e.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")).union(e.select("v", F.lit(0), F.lit(1)))
    counted = roles.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub"))
    return counted.filter((F.col("leaf") > 1) | ((F.col("leaf") > 0) & (F.col("hub") > 0))).isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.join(least, "u")
    return (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(linked.select("u", F.col("m").alias("v")))
        .filter("u != v")
        .distinct()
    )


#: Rows of a saved table of a few short columns that are broadcast at most; beyond it Spark's joins decide.
BROADCAST_ROWS = 400_000


def small(saved: DataFrame) -> DataFrame:
    """A saved table, marked for broadcast if it is within the bound."""
    return F.broadcast(saved) if saved.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else saved
