"""The folder that driver and executors share, and tables saved in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a session in one process without it gets a temporary folder."""
    root = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF, None)
    if root:
        return root
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError(f"set {_CONF} to a folder that driver and executors share")
    root = getattr(spark.sparkContext, "_notelake_shared", None)
    if root is None:
        root = spark.sparkContext._notelake_shared = "file://" + tempfile.mkdtemp(prefix="spark-notelake-", dir="/tmp")
    return root


def saved(df, name: str):
    """The table written under the shared folder and read back: computed once, and safe when an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
