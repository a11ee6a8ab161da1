"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch inside ``small_batches``. Spark's own limits (10,000 rows, 64 MB) let a batch of texts or sets take tens of MB,
#: of which the executor holds a copy that grows and the worker two or three.
BATCH_BYTES = 4 << 20


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can see.

    The cluster names it in ``spark.checkpoint.dir``. Only a ``local`` master, where driver
    and executors are one process, gets a fresh temporary folder where that is unset.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not named:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors of {context.master} share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str = "table"):
    """Cut lineage by writing the table to the shared folder and reading it back.

    Unlike a cached block the written table survives the loss of an executor,
    so several jobs can safely share one (possibly sampled) layout of the rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python ``BATCH_BYTES`` at a time (or one longer row) in what runs inside; the session's own limit holds again after it.

    Only for work whose result does not depend on the batches. What is merely planned inside and runs later is not bound.
    """
    before = spark.conf.get(BATCH_KEY, None)
    spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_KEY)
        else:
            spark.conf.set(BATCH_KEY, before)
