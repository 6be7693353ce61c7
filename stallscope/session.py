"""Session helpers: building a local session, tables that cut the lineage of a job."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "stallscope", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("STALLSCOPE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch folder only for a local session that names none (tests)."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
    return _local_scratch()


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="stallscope-")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def complete_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables in a folder whose write was committed; none if there is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    under = [f.getPath() for f in store.listStatus(where) if f.isDirectory()]
    return sorted(p.getName() for p in under if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


class Staging:
    """Tables of one job in the shared folder: written once, read by several branches, removed after use.

    A branch then reads only its own columns, and a lost executor costs a re-read instead of the
    whole lineage. ``drop`` removes a table as soon as nothing reads it any more; what a lazily
    returned result still reads is removed when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove_path(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before the process
            remove_path(self.spark, self.root)


def stage(df: DataFrame, label: str) -> DataFrame:
    """One frame that feeds several branches, staged (see :class:`Staging`)."""
    return Staging(df.sparkSession, label).write("table", df)


def stage_all(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stage independent frames side by side, so that their jobs share the cluster."""
    if not frames:
        return {}
    with ThreadPoolExecutor(max_workers=len(frames)) as pool:
        done = {label: pool.submit(stage, df, label) for label, df in frames.items()}
        return {label: f.result() for label, f in done.items()}
