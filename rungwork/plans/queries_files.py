"""Readers and writers: each query writes a table to the shared folder, reads it back and reports on it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.functions import scoring as sc
from rungwork.operators import admission as ad
from rungwork.operators import curriculum as cu
from rungwork.operators import reports as rep
from rungwork.plans import oracle_views as ov
from rungwork.plans import queries_text  # noqa: F401  (its summary is written and read here)
from rungwork.plans.queries_frontier import curriculum_manifest, rounded
from rungwork.plans.registry import REGISTRY, query
from rungwork.session import checkpoint_folder
from rungwork.sources import bridge, readers, sinks

RECORD = "id string, arm_name string, sample_index long, correct boolean, output_tokens long"


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.rollouts(spark, sf_dir).select("id", "arm_name", "sample_index", "correct", "output_tokens")


def _by_arm(log: DataFrame) -> DataFrame:
    return log.groupBy("arm_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("correct").alias("hits"), F.sum("output_tokens").alias("tokens")
    )


BY_ARM = "WITH " + ov.ROLLOUTS + """
SELECT arm_name, count(*) AS rows, count(*) FILTER (correct) AS hits, CAST(sum(output_tokens) AS BIGINT) AS tokens FROM rollouts GROUP BY arm_name"""


@query("A3, A9", BY_ARM)
def log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_log(_records(spark, sf_dir), path)
    return _by_arm(readers.read_log(spark, path, RECORD, require_rows=True))


@query("A4, A8", BY_ARM)
def append_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends make one log; every line must parse."""
    path, rows = _folder(spark), _records(spark, sf_dir)
    for odd in (0, 1):
        sinks.append_log(rows.filter(F.col("sample_index") % 2 == odd), path)
    return _by_arm(readers.read_log_strict(spark, path, RECORD))


@query("A4", """
SELECT event_id % 10 = 3 AS malformed, count(*) AS rows, CAST(sum(CASE WHEN event_id % 10 = 3 THEN 0 ELSE event_id END) AS BIGINT) AS ids
FROM events GROUP BY 1""")
def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    good = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit('{"event_id": '), F.col("event_type"))).otherwise(good)
    bridge.table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    parsed, bad = readers.quarantine(spark, path, "event_id long, event_type string")
    both = parsed.select(F.lit(False).alias("malformed"), "event_id").unionByName(
        bad.select(F.lit(True).alias("malformed"), F.lit(0).cast("long").alias("event_id"))
    )
    return both.groupBy("malformed").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))


@query("A5", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment FROM customer ORDER BY id LIMIT 25")
def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    rows = bridge.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("segment"))
    sinks.write_log(rows, path)
    return readers.read_first(spark, path, "id string, segment string", limit=25)


@query("A9, H8", "SELECT o_orderkey, o_custkey FROM orders")
def training_set_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_training_set(bridge.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, order=("o_orderkey",))
    return spark.read.parquet(path)


@query("A14", f"""
SELECT CAST(c_custkey AS VARCHAR) AS root_id FROM customer""")
def manifest_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    roots = bridge.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("root_id"), (F.col("c_custkey") % 3).alias("shard_index"), F.col("c_custkey").alias("position")
    )
    sinks.write_manifest_text(roots, path)
    return readers.read_manifest_text(spark, path)


@query("A9", "SELECT count(*) AS rows, true AS has_bytes FROM orders")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_if_any(bridge.table(spark, sf_dir, "orders").select("o_orderkey"), path)
    return readers.file_report(spark.read.parquet(path)).agg(F.sum("rows").alias("rows"), F.every(F.col("bytes") > 0).alias("has_bytes"))


NATIONS = tuple(f"NATION_{k}" for k in range(7))


@query("A13", "WITH " + ov.EVAL_SCORES + f"""
, scored AS (SELECT * FROM eval_scores WHERE NOT (dataset = 'NATION_3' AND method = '1-URGENT')),
complete AS (SELECT method FROM scored WHERE dataset IN {NATIONS} GROUP BY method HAVING count(DISTINCT dataset) = 7)
SELECT dataset, method, round(score, 9) AS score FROM scored WHERE method IN (SELECT method FROM complete)""")
def complete_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods scored on all seven datasets; one score is missing, so one method falls out."""
    scores = bridge.eval_scores(spark, sf_dir).filter("not (dataset = 'NATION_3' and method = '1-URGENT')")
    return rounded(rep.complete_methods(scores, NATIONS).select("dataset", "method", "score"))


@query("C1", """
SELECT l_orderkey AS id, round(count(*) FILTER (l_returnflag = 'R') / count(*), 9) AS success FROM lineitem GROUP BY l_orderkey""")
def reward_list_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward lists of an order's lines (seven at most)."""
    reward = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    lists = bridge.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(reward).alias("rewards"))
    return rounded(lists.select("id", sc.empirical_success("rewards").alias("success")))


@query("H13", "WITH " + ov.PROBLEMS + f"""
SELECT log_pos, id FROM problems WHERE coalesce(accuracy, 0.0) <= 0.5 AND regexp_matches(question, '[^\\s\\x0b\\x1c-\\x1f\\x85\\pZ]')
  AND regexp_matches(ground_truth, '[^\\s\\x0b\\x1c-\\x1f\\x85\\pZ]')""")
def probe_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows a probe may take, without a limit."""
    return ad.eligible_problems(bridge.problems(spark, sf_dir), max_source_accuracy=0.5).select("log_pos", "id")


@query("A1, H13", "WITH " + ov.PROBLEMS + f"""
SELECT log_pos, id, draw, eligible FROM (
  SELECT log_pos, id, row_number() OVER (ORDER BY {ov.seeded(42, 'CAST(log_pos AS VARCHAR)')}) AS draw, count(*) OVER () AS eligible
  FROM problems WHERE accuracy <= 0.5) p
WHERE draw <= (SELECT greatest(1, count(*) // 5) FROM documents)""")
def probe_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the table in seeded order out of the problems that are hard enough, and how many those are."""
    path, rows = _folder(spark), bridge.problems(spark, sf_dir)
    sinks.write_if_any(rows, path)
    problems = readers.read_problems(spark, path)
    fifth = max(1, problems.count() // 5)
    sample, eligible = ad.probe_rows(problems, limit=fifth, seed=42, max_source_accuracy=0.5)
    return sample.select("log_pos", "id", "draw", F.lit(eligible).cast("long").alias("eligible"))


@query("A6", "WITH " + ov.ROLLOUTS + """
SELECT concat(id, '::', substr(sha1(question), 1, 12)) AS item_key, count(*) AS rows, count(*) FILTER (correct) AS hits FROM rollouts GROUP BY 1""")
def rollout_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of three runs read as one, with the router's item key."""
    folder, rows = _folder(spark), bridge.rollouts(spark, sf_dir)
    paths = [f"{folder}/run{k}" for k in range(3)]
    for k, path in enumerate(paths):
        sinks.write_log(rows.filter(F.col("sample_index") % 3 == k), path)
    return readers.read_rollouts(spark, paths).groupBy("item_key").agg(F.count(F.lit(1)).alias("rows"), F.count_if("correct").alias("hits"))


@query("A10, F44", REGISTRY["generation_summary"].sql)
def summary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, summary = _folder(spark), REGISTRY["generation_summary"].run(spark, sf_dir)
    sinks.write_summary(summary, path)
    return spark.read.schema(summary.schema).json(path)


def _tree(spark: SparkSession, sf_dir: str, layout: Column, entries: Column) -> str:
    """Metric files of the evaluation scores, and the folder they are in."""
    root = _folder(spark)
    sinks.write_metric_tree(bridge.eval_scores(spark, sf_dir).select(layout.alias("path"), F.format_string("{%s}\n", entries).alias("value")), root)
    return root


@query("A12", "WITH " + ov.EVAL_SCORES + "SELECT dataset, method, round(score, 9) AS score FROM eval_scores")
def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files ``eval_<method>/<dataset>/metric.json``; the first entry has no pass@1, so the second counts."""
    layout = F.concat(F.lit("eval_"), F.col("method"), F.lit("/"), F.col("dataset"), F.lit("/metric.json"))
    entries = F.format_string('"n": {"rows": 3}, "main": {"pass@1": %s, "rows": 3}, "other": {"pass@1": 0.5}', F.col("score").cast("string"))
    return rounded(readers.metric_tree(spark, _tree(spark, sf_dir, layout, entries)))


@query("A11", "WITH " + ov.EVAL_SCORES + "SELECT dataset, round(score, 9) AS score FROM eval_scores WHERE method = '5-LOW'")
def first_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run's files ``<dataset>/metric.json``, of which the first entry counts, beside those of other runs."""
    layout = F.concat(F.translate("method", " ", "_"), F.lit("/"), F.col("dataset"), F.lit("/metric.json"))
    entries = F.format_string('"%s": {"pass@1": %s}, "later": {"pass@1": 0.25}', F.col("method"), F.col("score").cast("string"))
    root = _tree(spark, sf_dir, layout, entries)
    return rounded(readers.metric_tree(spark, f"{root}/5-LOW", first_key_only=True).select("dataset", "score"))


@query("A16", REGISTRY["phase_histogram"].sql)
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curriculum decisions as a manifest file, read with its check for repeated questions."""
    path = _folder(spark)
    sinks.write_log(curriculum_manifest(spark, sf_dir), path)
    return cu.phase_histogram(readers.load_manifest(spark, path))
