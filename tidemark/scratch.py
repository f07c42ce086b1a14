"""Tables written to the folder that the driver and all executors share, where a step's result is used more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local master gets one of its own; on a cluster, where
    no folder is known to be shared, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL_ROOTS[app] = _LOCAL_ROOTS.get(app) or tempfile.mkdtemp(prefix="tidemark-")
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write the frame to the shared folder (in folders by the columns) and read it again: lineage ends in files that
    outlive any executor."""
    path = scratch(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*frames: DataFrame, folder: str = "") -> None:
    """Delete what staged() wrote (or one folder of it), once everything that is read from it has been written elsewhere."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{df.staged_at}/{folder}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
