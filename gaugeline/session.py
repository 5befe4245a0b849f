"""Session set-up and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "gaugeline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture costs about a millisecond for each column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a scratch folder only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gaugeline-"))
        folder = context.getCheckpointDir()
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and go on from the written copy.

    A lost executor then costs a re-read of a few files and not the steps before them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/gaugeline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    settled = spark.read.parquet(path)
    settled._settled_at = path
    return settled


def discard(settled: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    spark = settled.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(settled._settled_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(rdd: RDD) -> None:
    """Delete the shuffled rows that `rdd` was made of, up to what is persisted; it is not used again."""
    rdd._jrdd.rdd().cleanShuffleDependencies(False)
