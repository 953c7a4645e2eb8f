"""Session settings shared by tests, benchmark and jobs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = 8, app_name: str = "rungwork") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests, benchmark) gets one temporary folder for the whole
    session, removed at exit; on a cluster that is an error, since executors share no local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="rungwork-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_SCOPES: list[list[str]] = []


@contextmanager
def helper_tables() -> Iterator[list[str]]:
    """Collects the paths of the tables that ``cut_lineage`` writes inside the block."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES[:] = [s for s in _SCOPES if s is not paths]


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back; ``compression`` as Parquet names it.

    A written table survives lost executors, is read column by column, and gives the
    planner its true size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/rungwork-{uuid.uuid4().hex}"
    for paths in _SCOPES:
        paths.append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
