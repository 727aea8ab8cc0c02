"""Session settings, and the shared folder in which jobs may cut their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "postlake", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library assumes everywhere.

    On a cluster use your own session; only the UTC time zone is needed for
    right results, the rest are the adaptive defaults spelled out.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; every executor must see it.

    A temporary folder is made only where the setting is missing, which is the
    case in local tests; it goes when the program ends. What lies in a folder of
    the cluster is kept there, as other jobs may still read it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="postlake-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    A lost executor then costs a re-read, not a re-run of what came before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def set_within(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles_freed(spark: SparkSession):
    """What a query within has shuffled goes when the query ends.

    Otherwise it stays until the driver happens to collect its garbage, and the shuffles of many writes lie on the disks
    together.
    """
    return set_within(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def frees_shuffles(method: Callable) -> Callable:
    """For a method of a table with a ``spark``: :func:`shuffles_freed` holds within."""

    @wraps(method)
    def freeing(self, *args, **named):
        with shuffles_freed(self.spark):
            return method(self, *args, **named)

    return freeing


def at_least_parallel(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores.

    A table of many files keeps its own splits, with no shuffle; the case this
    is for is one small file in front of per-row work that is heavy on CPU.
    Hash partitioning keeps re-runs of a lost task identical.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys)
