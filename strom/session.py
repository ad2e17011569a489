"""Session settings the plans rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that results depend on."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("STROM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # building a plan walks the Python stack on every column operation unless this is off
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; only a session without one gets a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    # the setting is fixed once a session runs, so the folder is remembered here
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="strom-checkpoint-")
    return _LOCAL_ROOTS[application]


_LOCAL_ROOTS: dict[str, str] = {}


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Writes an intermediate to the shared folder, with the writer's ``options``, and reads it back.

    Everything behind it drops out of later plans, and losing executors costs no recomputation.
    """
    path = f"{checkpoint_root(df.sparkSession)}/strom-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def drop_intermediates(spark: SparkSession) -> int:
    """Deletes what ``cut_lineage`` wrote so far, and says how many folders. Only call it once all results are stored: they read from there."""
    found = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        found += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found


_REUSED: list[DataFrame] = []


def reuse(df: DataFrame) -> DataFrame:
    """Keeps an intermediate that several branches of one plan read; spills to disk, rebuilt if an executor is lost."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _REUSED.append(df)
    return df


def release() -> None:
    """Drops every intermediate kept by ``reuse``."""
    while _REUSED:
        try:
            _REUSED.pop().unpersist()
        except Exception:  # the session that held it is gone
            continue
