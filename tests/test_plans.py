"""Shape of the physical plans: no pair products, pruned scans, limits before shuffles."""

import pytest

from rungwork.operators import controls as co
from rungwork.operators import calibration as ca
from rungwork.operators import frontier as fr
from rungwork.operators import mixing as mx
from rungwork.operators import replay as rp
from rungwork.plans.catalog import REGISTRY
from rungwork.sources import bridge

SF = "/root/testdata/sf0.001"
RUNS_JOBS = {"stream_running_q", "stream_ingest", "stream_sequential_stop", "router_ml", "router_optimality", "ring_control"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - RUNS_JOBS))
def test_no_cross_or_nested_loop_join(spark, name):
    text = plan_of(REGISTRY[name].run(spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_only_needed_columns_are_read(spark):
    text = plan_of(fr.rescue_summary(fr.item_frontiers(bridge.rollouts(spark, SF))))
    schemas = [line for line in text.splitlines() if "ReadSchema" in line and "lineitem" in line]
    assert schemas and all("l_shipdate" not in s and "l_partkey" not in s for s in schemas)


def test_group_limit_runs_before_the_shuffle(spark):
    text = plan_of(co.nearest_size_controls(bridge.candidates(spark, SF)))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_decisions_need_no_shuffle_of_their_own(spark):
    from rungwork.operators import curriculum as cu

    states = cu.root_states(bridge.rollouts(spark, SF), "skip")
    before = plan_of(states).count("Exchange hashpartitioning")
    assert plan_of(cu.decide_curriculum(states)).count("Exchange hashpartitioning") == before


@pytest.mark.parametrize("name", ["progressive_replay_full", "progressive_replay_public", "min_cost_hindsight", "min_cost_hindsight_public",
                                  "strongest_solution", "token_saving", "level_replay", "routing_decisions"])
def test_replays_group_by_hash(spark, name):
    text = plan_of(REGISTRY[name].run(spark, SF))
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_a_trajectory_is_shuffled_once(spark):
    log = bridge.rollouts(spark, SF)
    before = plan_of(log).count("Exchange hashpartitioning")
    assert plan_of(rp.policy_replays(log)).count("Exchange hashpartitioning") == before + 1


def test_pending_jobs_scan_the_log_once(spark):
    candidates, log = bridge.root_candidates(spark, SF), bridge.help_results(spark, SF)
    text = plan_of(ca.pending_jobs(candidates, log, 1, 4, 2))
    assert text.count("lineitem.parquet") <= 2 and text.count("ReadSchema: struct<l_") == 1


def exchanges(plan, found=None):
    """(partitioning, output columns) of every shuffle of a physical plan."""
    found = [] if found is None else found
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return exchanges(plan.initialPlan(), found)
    if name == "ShuffleExchangeExec":
        found.append((plan.outputPartitioning().toString(), plan.output().mkString(",")))
    children = plan.children()
    for i in range(children.size()):
        exchanges(children.apply(i), found)
    return found


def test_no_text_goes_through_the_join_on_questions(spark):
    """With broadcasts off, shuffles by question key hold keys, positions and short values; texts only go by position."""
    texts = {"question", "subproblem", "subproblem_answer", "source_step", "reference", "prompt", "solution", "root", "cand"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen = []
    whole = mx.cut_lineage

    def noted(frame):
        seen.extend(exchanges(frame._jdf.queryExecution().executedPlan()))
        return whole(frame)

    mx.cut_lineage = noted
    try:
        from rungwork.plans import queries_training as qt

        mix = mx.training_mix(qt._source(spark, SF), qt._measured(spark, SF))
        seen += exchanges(mix._jdf.queryExecution().executedPlan())
    finally:
        mx.cut_lineage = whole
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_key = [columns for dealt, columns in seen if "question_key" in dealt]
    assert by_key and all(not {c.split("#")[0] for c in columns.split(",")} & texts for columns in by_key)
    assert any("root_at" in dealt or "log_pos" in dealt for dealt, _ in seen)


def test_a_hot_question_is_split(spark):
    """Nine tenths of the candidates ask one question: no task gets more than a sixth of them."""
    rows = 200_000
    many = spark.range(rows).selectExpr("if(id % 10 = 0, concat('k', id), 'hot') AS key", "id AS at")
    unique = spark.range(rows).selectExpr("if(id = 1, 'hot', concat('k', id)) AS key", "id * 2 AS value")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = mx.salted_join(many, unique, "key", "at").selectExpr("*", "spark_partition_id() AS task").cache()
        sizes = [r["count"] for r in joined.groupBy("task").count().collect()]
        assert sum(sizes) == rows == joined.select("at").distinct().count() and max(sizes) < rows / 6
        assert joined.where("key = 'hot' AND value <> 2").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
        spark.conf.set("spark.sql.adaptive.enabled", "true")
