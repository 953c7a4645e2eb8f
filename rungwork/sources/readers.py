"""Typed readers for the engine's files: JSON lines, parquet, text and metric trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork import schemas
from rungwork.functions import text as tx

Paths = str | Sequence[str]


def _paths(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_log(spark: SparkSession, paths: Paths, schema: str, require_rows: bool = False) -> DataFrame:
    """JSON lines under a declared schema; blank lines carry no row."""
    df = spark.read.schema(schema).json(_paths(paths))
    if require_rows and df.isEmpty():
        raise ValueError(f"no records in {paths}")
    return df


def read_log_strict(spark: SparkSession, paths: Paths, schema: str) -> DataFrame:
    """As :func:`read_log`, but a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(_paths(paths))


def quarantine(spark: SparkSession, paths: Paths, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and malformed lines with the file they came from."""
    options = {"columnNameOfCorruptRecord": "_corrupt_record"}
    lines = spark.read.text(_paths(paths)).filter(tx.has_text("value"))
    parsed = lines.select(
        F.from_json("value", f"{schema}, _corrupt_record string", options).alias("r"),
        F.col("_metadata.file_path").alias("source_file"),
    )
    bad = parsed.filter(F.col("r._corrupt_record").isNotNull()).select("source_file", "r._corrupt_record")
    good = parsed.filter(F.col("r._corrupt_record").isNull()).select("r.*").drop("_corrupt_record")
    return good, bad


def read_first(spark: SparkSession, paths: Paths, schema: str, limit: int | None) -> DataFrame:
    """First ``limit`` records by id (all for ``None``)."""
    df = read_log(spark, paths, schema)
    return df if limit is None else df.orderBy("id").limit(limit)


def read_rollouts(spark: SparkSession, paths: Paths) -> DataFrame:
    """Rollout logs of several runs with the router's item key; no rows is an error."""
    log = read_log(spark, paths, schemas.ROLLOUTS, require_rows=True)
    return log.withColumn("item_key", tx.item_id("id", "question"))


def read_problems(spark: SparkSession, path: str, max_source_accuracy: float | None = None) -> DataFrame:
    """Problem parquet. The accuracy bound applies only if the file has that column."""
    df = spark.read.parquet(path)
    if max_source_accuracy is not None and "accuracy" in df.columns:
        df = df.filter(F.col("accuracy") <= max_source_accuracy)
    return df


def metric_tree(spark: SparkSession, root: str, first_key_only: bool = False) -> DataFrame:
    """``dataset, method, score`` from ``<dataset>/metric.json`` files below ``root``.

    The method is the ``eval_<method>`` folder when there is one. ``first_key_only`` reads
    the first entry of each file, whatever it holds; otherwise the first entry with a
    ``pass@1`` counts, and a file without one is an error.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "metric.json")
        .text(root, wholetext=True)
        .select("value", F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"))
    )  # paths come as URIs
    entries = F.map_values(F.from_json("value", "map<string,string>"))
    scores = F.transform(entries, lambda e: F.get_json_object(e, "$['pass@1']").cast("double"))
    usable = scores if first_key_only else F.filter(scores, lambda s: s.isNotNull())
    missing = F.raise_error(F.concat(F.lit("no pass@1 metric in "), F.col("path"))).cast("double")
    return files.select(
        F.regexp_extract("path", r"([^/]+)/metric\.json$", 1).alias("dataset"),
        F.nullif(F.regexp_extract("path", r"/eval_([^/]+)/[^/]+/metric\.json$", 1), F.lit("")).alias("method"),
        F.coalesce(F.get(usable, F.lit(0)), missing).alias("score"),
    )


def read_manifest_text(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, stripped, blank lines dropped."""
    lines = spark.read.text(path).select(tx.strip("value").alias("root_id"))
    return lines.filter(F.col("root_id") != "")


def load_manifest(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Curriculum manifest; a repeated question key or an empty file is an error."""
    if path is None or not path.strip():
        return None
    df = read_log(spark, path, schemas.CURRICULUM, require_rows=True)
    check_unique(df, "question_key")
    return df


def check_unique(df: DataFrame, key: str) -> None:
    """Raise when ``key`` repeats; only one offending key reaches the driver."""
    clash = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).head(1)
    if clash:
        raise ValueError(f"duplicate {key}: {clash[0][0]}")


def file_report(df: DataFrame) -> DataFrame:
    """Rows and bytes of each file behind a file-based table."""
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes")
    )
