"""Session helpers: shared scratch folder, written stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "belfry", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs were tuned under; every one can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; without the setting a private one, in local mode only (tests)."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="belfry-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody else writes to, inside the shared folder."""
    return f"{shared_dir(spark)}/belfry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unwritten(*frames: DataFrame) -> None:
    """Delete what :func:`written` made, once nothing reads it any more."""
    for df in frames:
        file = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
        file.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(file.getParent(), True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as their query has ended, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)
