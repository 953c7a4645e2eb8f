"""Writers: append logs, JSON lines, training parquet and one-row summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

METRIC_FILES = 10_000  # of one metric tree
LOG_FILE_ROWS = 1_000_000  # of one file of a log


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to a JSON-lines log."""
    df.write.mode("append").json(path)


def write_log(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Replace a JSON-lines table; a compressed file is read by one task, so its rows are bounded."""
    df.write.mode("overwrite").option("maxRecordsPerFile", LOG_FILE_ROWS).json(path, compression=compression)


def write_training_set(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """Training parquet; with ``order`` the files follow one global order (range sort)."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").parquet(path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Write only a non-empty table."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_summary(summary: DataFrame, path: str) -> None:
    """One summary object per run: a one-row table as one JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_manifest_text(manifest: DataFrame, path: str) -> None:
    """Root ids of each shard in position order, one per line, a folder per shard."""
    ordered = manifest.repartitionByRange("shard_index", "position").sortWithinPartitions(
        "shard_index", "position"
    )
    ordered.select("shard_index", "root_id").write.mode("overwrite").partitionBy("shard_index").text(path)


def write_metric_tree(files: DataFrame, root: str) -> None:
    """One file a row of (path, value) below ``root``: the metric files of an evaluation, one a dataset and method.

    Rows pass the driver one at a time; more than ``METRIC_FILES`` are an error.
    """
    spark = files.sparkSession
    if files.limit(METRIC_FILES + 1).count() > METRIC_FILES:
        raise ValueError(f"more than {METRIC_FILES} metric files")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in files.select("path", "value").toLocalIterator():
        out = store.create(path(f"{root}/{row.path}"), True)
        try:
            out.write(bytearray(row.value, "utf-8"))
        finally:
            out.close()
