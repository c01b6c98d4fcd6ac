"""A folder for what a query writes and reads again: under spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path, removed at exit. Without the setting a local session gets a temporary folder; a cluster must set it."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":  # local-cluster[...] has executors of its own
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/sparkward-scratch"
    root = f"{shared.rstrip('/')}/core-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_forget, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """rows, written once: what reads them twice does not make them twice, and Spark knows their size."""
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _forget(spark: SparkSession, root: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(root)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is named after the application
        pass
