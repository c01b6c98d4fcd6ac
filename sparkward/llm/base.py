"""What the corpus operators share: session settings, the shared scratch folder, star-contraction components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.shipping import ensure_workers

#: Rows and bytes of an Arrow batch; a batch of very long texts stays small.
ARROW_ROWS = 512
ARROW_BYTES = "16m"
#: Bits of a sieve for each hash, and at most (4 MB); the second bit of a hash is that of its digits from SECOND on.
SIEVE, MOST_SIEVE, SECOND = 16, 1 << 25, 32

_roots: set[str] = set()
_passing: list[list[str]] = []


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, and see to it that workers have this package."""
    ensure_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark's reader (the path may be in any store that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which all executors share.

    Where the setting is missing, a temporary folder serves local runs; a cluster must set it.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/sparkward-scratch"
    root = f"{shared.rstrip('/')}/sparkward-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_forget, spark, root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder by Hadoop's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, root: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            drop_path(spark, root)
    except Exception:  # the session may be gone at exit; the folder is named after the application
        pass


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """The tables that are written inside are dropped at the end, but for those that are said to stay."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            drop_path(spark, path)


def written(spark: SparkSession, df: DataFrame, name: str, stays: bool = False) -> tuple[DataFrame, str]:
    """Cut lineage: write df as Parquet to the shared scratch folder and read it again.

    stays: the table outlives the innermost passing(), and is left to the one around it.
    """
    path = scratch_path(spark, name)
    if (inner := len(_passing) - stays) > 0:
        _passing[inner - 1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which a side may be broadcast: Spark's own threshold."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def sieve(spark: SparkSession, hashes: DataFrame) -> Callable[[Column], Column]:
    """A test of 64-bit hashes that holds for all of hashes (its one column, without nulls) and for few others.

    It is a bitmap with two bits of each hash, of bounded size: rows that it turns away need not be shuffled to a join. What
    it lets through, the join decides. The bits come to the driver in words of 64.
    """
    h = F.col(hashes.columns[0])
    bits, n = 1 << 16, hashes.count()
    while bits < SIEVE * n and bits < MOST_SIEVE:
        bits *= 2
    places = hashes.select(F.explode(F.array(h, F.shiftrightunsigned(h, SECOND))).alias("h")).select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("p"))
    some = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[some.column("w").to_numpy()] = some.column("b").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(words.view(np.uint8))

    def held(hashes):
        out = np.ones(len(hashes), bool)
        for digits in (0, SECOND):
            place = (hashes.to_numpy().view(np.uint64) >> np.uint64(digits)) & np.uint64(bits - 1)
            out &= (shared.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 != 0
        return pd.Series(out)

    return F.pandas_udf(held, "boolean")


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): returns (node, component), the component being its least node.

    Alternating large-star and small-star contraction. Each round costs two grouped minima, which are
    combined before the shuffle, and two equi-joins that AQE may split; a round's edges are a written table.
    Nodes without an edge are not returned. Nulls and loops are ignored.
    """
    now = edges.select(F.col("u"), F.col("v")).where("u is not null and v is not null and u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = written(spark, now, "edges")
    mark = None
    for _ in range(rounds):
        # minima are written tables, so that either side of a join is an exchange of its own, which AQE can split
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = written(spark, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_path = written(spark, large.where("u <> v").distinct(), "large")
        down, down_path = written(spark, large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        new, new_path = written(spark, small.where("u <> v").distinct(), "edges")
        for old in (path, least_path, large_path, down_path):
            drop_path(spark, old)
        now, path = new, new_path
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(got):
            break
        mark = tuple(got)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = now.groupBy("v").agg(F.lit(1).alias("x")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row."""
    n = len(v)
    rows = np.concatenate((v, np.full(-n % w, v.max(), v.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def executor_file_system(uri: str):
    """On an executor: pyarrow's file system of a shared folder and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")
