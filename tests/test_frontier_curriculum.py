"""Frontier, replay and curriculum jobs on literal tables."""

import pytest
from pyspark.sql import functions as F

from rungwork import schemas
from rungwork.functions.scoring import CurriculumRules
from rungwork.functions import text as tx
from rungwork.operators import curriculum as cu
from rungwork.operators import frontier as fr
from rungwork.operators import jobs as jb
from rungwork.operators import replay as rp

LOG = (
    "id string, question string, reference string, arm_name string, arm_kind string, arm_strength double, "
    "arm_order int, sample_index bigint, correct boolean, input_tokens bigint, hint_tokens bigint, "
    "output_tokens bigint, hit_max_new_tokens boolean, log_pos bigint"
)
ARMS = [("none", "none", 0.0, 0, False, 0), ("knowledge@25", "knowledge", 0.25, 1, True, 10), ("solution@100", "solution", 1.0, 2, True, 40)]


def log(spark, arms=ARMS, samples=2, id="x", question="q"):
    rows = []
    for s in range(samples):
        for name, kind, strength, order, correct, hint in arms:
            rows.append((id, question, "1", name, kind, strength, order, s, correct, 20 + hint, hint, 10, None, len(rows)))
    return spark.createDataFrame(rows, LOG)


def test_lattice_has_ten_arms(spark):
    parts = [["k1", "k2", "k3", "k4"], ["p1", "p2", "p3", "p4"], ["s1", "s2", "s3", "s4"]]
    df = spark.createDataFrame([(1, *parts)], "id int, knowledge_components_parts array<string>, planning_skeleton_parts array<string>, solution_breakdown_parts array<string>")
    arms = jb.arm_lattice(df, [0.25, 0.5, 1.0]).orderBy("arm_order").collect()
    assert [a["arm_name"] for a in arms[:3]] == ["none", "knowledge@25", "knowledge@50"]
    assert [a["selected_parts"] for a in arms[1:4]] == [1, 2, 4] and len(arms) == 10
    assert arms[2]["hint"] == "1. k1\n2. k2"
    with pytest.raises(ValueError):
        jb.arm_lattice(df, [0.0])


def test_lattice_skips_empty_kinds(spark):
    df = spark.createDataFrame([(1, [" "], None, ["s"])], "id int, knowledge_components_parts array<string>, planning_skeleton_parts array<string>, solution_breakdown_parts array<string>")
    arms = jb.arm_lattice(df, [0.25, 1.0]).orderBy("arm_order").collect()
    assert [(a["arm_name"], a["arm_order"]) for a in arms] == [("none", 0), ("solution@25", 1), ("solution@100", 2)]


def test_frontier_finds_rescue_and_cost_gap(spark):
    df = log(spark)
    items = fr.item_frontiers(df)
    row = items.first()
    assert row["threshold_choice"] == "knowledge@25"
    assert fr.rescue_summary(items).first()["rescued_items"] == 1
    replays = rp.policy_replays(df)
    paid = rp.progressive_replay(replays).first()
    best = rp.min_cost_hindsight(replays).first()
    assert paid["average_total_tokens"] > best["average_total_tokens_on_success"]
    public = rp.progressive_replay(replays, public=True).first()
    assert public["accuracy"] == rp.min_cost_hindsight(replays, public=True).first()["accuracy"] == 1.0
    assert rp.strongest_solution(df).first()["arm_name"] == "solution@100"


def test_first_arm_wins_full_ties(spark):
    arms = [("a", "none", 0.0, 0, True, 5), ("b", "knowledge", 0.5, 1, True, 5)]
    row = fr.item_frontiers(log(spark, arms)).first()
    assert (row["threshold_choice"], row["band_choice"], row["utility_choice"]) == ("a", "a", "a")
    none_reaches = [("a", "none", 0.0, 0, False, 0), ("b", "knowledge", 0.5, 1, False, 5)]
    assert fr.item_frontiers(log(spark, none_reaches)).first()["threshold_choice"] == "a"


def test_row_order_never_matters(spark):
    df = log(spark, samples=3).union(log(spark, samples=2, id="y", question="r"))
    mixed = df.orderBy(F.desc("log_pos"), "arm_name").repartition(3)
    a = sorted(fr.item_frontiers(df).collect())
    assert a == sorted(fr.item_frontiers(mixed).collect())


def test_last_duplicate_counts_in_replay(spark):
    again = log(spark, [("none", "none", 0.0, 0, True, 0)], samples=1).withColumn("log_pos", F.lit(99).cast("bigint"))
    paid = rp.progressive_replay(rp.policy_replays(log(spark, samples=1).unionByName(again))).first()
    assert (paid["accuracy"], paid["average_calls"], paid["average_total_tokens"]) == (1.0, 1.0, 30.0)


def test_histogram_sums_equal_items(spark):
    items = fr.item_frontiers(log(spark).union(log(spark, id="y")))
    sums = fr.choice_histograms(items).groupBy("choice").agg(F.sum("items").alias("n")).collect()
    assert {r["n"] for r in sums} == {2}


def test_planning_only_trajectory_has_no_public_cost(spark):
    df = log(spark, [("planning@25", "planning", 0.25, 3, True, 1)], samples=1)
    row = rp.policy_replays(df).first()
    assert row["public_hindsight"]["cost"] is None and row["public_progressive"]["calls"] == 0


def test_truncation_default(spark):
    got = fr.with_truncation_default(log(spark).withColumn("output_tokens", F.lit(1024).cast("bigint")), 1024)
    assert got.filter("hit_max_new_tokens").count() == got.count()


def test_frontier_shift(spark):
    def side(choice, p):
        return spark.createDataFrame(
            [("i", p, choice, [("none", 0.0), ("knowledge@25", 10.0)])],
            "id string, no_hint_p double, threshold_choice string, arms array<struct<arm_name:string,hint_tokens:double>>",
        )

    pairs = fr.frontier_pairs(side("knowledge@25", 0.0), side("none", 1.0))
    row = fr.frontier_shift(pairs).first()
    assert (row["choice_changed_fraction"], row["fewer_hint_fraction"], row["common_examples"]) == (1.0, 1.0, 1)
    assert fr.frontier_transitions(pairs).first()["transition"] == "knowledge@25 -> none"
    with pytest.raises(Exception, match="no common items"):
        fr.frontier_shift(pairs.filter("id = 'z'")).collect()


def test_level_replay(spark):
    rows = [("a", 0, False, 5, 0.1), ("a", 1, True, 6, 0.1), ("a", 3, True, 7, 0.1), ("b", 0, False, 1, 0.1), ("b", 3, False, 2, 0.1)]
    df = spark.createDataFrame(rows, "id string, level int, correct boolean, output_tokens bigint, latency_seconds double")
    items = rp.level_replay(df)
    got = {r["id"]: r for r in items.collect()}
    assert got["a"]["selected_level_name"] == "knowledge" and got["a"]["progressive_output_tokens"] == 11
    assert got["b"]["selected_level_name"] == "failed" and got["b"]["full_hint_output_tokens"] == 2
    summary = rp.level_summary(items).first()
    assert (summary["scaffold_recovery_count"], summary["average_selected_level_on_success"]) == (1, 1.0)
    histogram = {r["level"]: r["items"] for r in rp.level_histogram(items).collect()}
    assert histogram == {"none": 0, "knowledge": 1, "planning": 0, "solution": 0, "failed": 1}


RULES = CurriculumRules(0.25, 0.60, 0.75, 0.5, 0.75, 2, 4, 64)


def decide(spark, root_rewards, subproblems=(), scaffolds=(), streak=0):
    row = ("r", "hard", "1", root_rewards, list(subproblems), list(scaffolds), streak)
    return cu.decide_curriculum(cu.states_from_rewards(spark.createDataFrame([row], schemas.ROOT_STATES)), RULES).first()


def sub(name, *rewards):
    return (name, name, "1", [float(r) for r in rewards], 1, None)


def arm(name, rewards, hint, strength, kind="plan"):
    return (name, [float(r) for r in rewards], hint, strength, kind, "")


ZERO = [0.0] * 4


def test_cheapest_in_band_scaffold(spark):
    arms = [arm("weak", (0, 1, 0, 0), 20, 0.25), arm("strong", (1, 1, 0, 0), 50, 1.0), arm("too-long", (0, 1, 1, 0), 100, 1.0)]
    assert decide(spark, ZERO, scaffolds=arms)["selected_scaffold"] == "weak"
    above = [arm("x", (1, 1, 1, 1), 30, 0.5), arm("y", (1, 1, 1, 1), 30, 0.25)]
    assert decide(spark, ZERO, scaffolds=above)["selected_scaffold"] == "y"
    failed = [arm("x", ZERO, 30, 0.5), arm("y", ZERO, 20, 0.5)]
    assert decide(spark, ZERO, scaffolds=failed)["selected_scaffold"] == "y"


def test_subproblems_come_before_an_unready_root(spark):
    got = decide(spark, ZERO, [sub("s1", 0, 1, 0, 0), sub("s2", 0, 0, 0, 0)], [arm("plan", (0, 1, 0, 0), 30, 0.5)])
    assert got["phase"] == "subproblem_curriculum"
    assert (got["active_subproblem_ids"], got["unresolved_subproblem_ids"]) == (["s1"], ["s2"])


def test_mastered_prerequisites_open_the_guided_root(spark):
    got = decide(spark, ZERO, [sub("s1", 1, 1, 1, 0), sub("s2", 1, 1, 1, 1)], [arm("weak-plan", (0, 1, 0, 0), 24, 0.25)])
    assert (got["phase"], got["selected_scaffold"], got["prerequisite_mastery"]) == ("guided_root", "weak-plan", 1.0)


@pytest.mark.parametrize(
    ("rewards", "streak", "phase"),
    [([1.0] * 4, 2, "graduated"), ([1.0] * 4, 1, "unguided_probe"), ([1.0, 0, 0, 0], 5, "unguided_root"), (ZERO, 0, "decompose_or_defer")],
)
def test_phases_without_help(spark, rewards, streak, phase):
    got = decide(spark, [float(r) for r in rewards], streak=streak)
    assert got["phase"] == phase and got["reason"] == cu.REASONS[phase]


def test_root_states_from_rollouts(spark):
    arms = [("none", "none", 0.0, 0, False, 0), ("planning@50", "planning", 0.5, 1, True, 3)]
    extra = log(spark, [("planning@50", "planning", 0.5, 1, False, 4)], samples=2)
    state = cu.root_states(log(spark, arms).unionByName(extra)).first()
    assert state["root_success"] == 0.0
    pick = state["scaffolds"][0]
    assert (pick["success"], pick["hint_tokens"], pick["samples"]) == (0.5, 4, 4)  # 3.5 rounds half-even
    with pytest.raises(Exception, match="without unhinted"):
        cu.root_states(extra).collect()
    assert cu.root_states(extra, "skip").count() == 0


def test_regeneration_fades_the_chosen_hint(spark):
    problems = spark.createDataFrame(
        [("What  is it?", None, ["p1", "p2", "p3", "p4"], None), ("other", None, None, None)],
        "question string, knowledge_components_parts array<string>, planning_skeleton_parts array<string>, solution_breakdown_parts array<string>",
    )
    manifest = problems.limit(1).select(
        tx.question_key("question").alias("question_key"), F.lit("guided_root").alias("phase"), F.lit("planning@100").alias("selected_scaffold")
    )
    requests = cu.regeneration_requests(problems, manifest, step=5, fade_start=0, fade_end=10)
    got = {r["question"]: r for r in requests.collect()}
    assert (got["What  is it?"]["hint_parts"], got["What  is it?"]["visible_fraction"]) == (["p1", "p2"], 0.5)
    assert (got["other"]["phase"], got["other"]["hint_parts"]) == ("unguided_root", [])
    rows = cu.curriculum_rollouts(requests, 4).orderBy("question", "rollout_index").collect()
    guided = [r for r in rows if r["question"] == "What  is it?"]
    assert [r["hint_level"] for r in guided] == [5, 5, 0, 0]
    assert [r["curriculum_phase"] for r in guided] == ["guided_root"] * 2 + ["unguided_dropout"] * 2
    assert {r["curriculum_phase"] for r in rows if r["question"] == "other"} == {"unguided_dropout"}
