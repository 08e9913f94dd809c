"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_BYTES = 128 * 1024 * 1024
"""Size that a shuffle partition should have before adaptive execution merges the small ones."""


def shuffle_partitions(input_bytes: int) -> str:
    """Number of shuffle partitions for an input of this size: 100 TB give about 800,000."""
    return str(max(200, input_bytes // SHUFFLE_BYTES))


def build_session(app: str = "fleetlens", master: str | None = None, input_bytes: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
    }
    if input_bytes:
        settings["spark.sql.shuffle.partitions"] = shuffle_partitions(input_bytes)
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


BATCH_BYTES = 4 * 1024 * 1024
"""Most bytes of a batch of rows on the way to Python and back."""


def small_batches(spark: SparkSession) -> None:
    """Hold batches of wide rows to ``BATCH_BYTES`` from now on, unless the session has less.

    By number of rows alone a batch of whole texts has tens of megabytes, several times over in the executor and in each worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is made and checkpointed inside removes its shuffles as soon as it is written.

    Otherwise they stay until the driver happens to collect its garbage. A DataFrame made inside should be executed once.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, as the cluster names it.

    Only a local master may fall back to a temporary folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fleetlens-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that every later use sees the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``pinned`` by columns: for wide rows that are read more than once, of which each reader needs some columns."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
