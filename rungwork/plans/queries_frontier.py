"""Frontier, replay and curriculum queries over the rollout log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.functions.scoring import CurriculumRules
from rungwork.operators import curriculum as cu
from rungwork.operators import frontier as fr
from rungwork.operators import replay as rp
from rungwork.plans import oracle_views as ov
from rungwork.plans.registry import query
from rungwork.sources import bridge

RULES = CurriculumRules(group_size=4, max_hint_tokens=512)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


STATS = (
    ov.ROLLOUTS
    + """,
totals AS (
  SELECT id, arm_name, max(arm_kind) AS kind, max(arm_strength) AS strength, max(arm_order) AS arm_order,
         count(*) AS n, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS hits,
         CAST(sum(hint_tokens) AS BIGINT) AS hint_sum, CAST(sum(input_tokens) AS BIGINT) AS input_sum,
         CAST(sum(output_tokens) AS BIGINT) AS output_sum,
         CAST(sum(CASE WHEN hit_max THEN 1 ELSE 0 END) AS BIGINT) AS limit_sum
  FROM {source} GROUP BY id, arm_name
),
based AS (
  SELECT *, coalesce(max(CASE WHEN arm_name = 'none' THEN hits / n END) OVER (PARTITION BY id), 0.0) AS no_hint_p,
         hits / n AS p, hint_sum / n AS hint, (input_sum + output_sum) / n AS total
  FROM totals
),
stats AS (
  SELECT *, p * (1.0::DOUBLE - p) - 0.02::DOUBLE * (hint / 100.0::DOUBLE)
            - 0.05::DOUBLE * greatest(0.0::DOUBLE, p - no_hint_p) AS utility
  FROM based
),
choices AS (
  SELECT id, max(no_hint_p) AS no_hint_p,
         arg_min(arm_name, ROW(-utility, hint, arm_order)) AS utility_choice,
         coalesce(arg_min(arm_name, ROW(hint, arm_order)) FILTER (p >= 0.5),
                  arg_min(arm_name, ROW(-p, arm_order))) AS threshold_choice,
         coalesce(arg_min(arm_name, ROW(hint, arm_order)) FILTER (p BETWEEN 0.25 AND 0.75),
                  arg_min(arm_name, ROW(abs(p - 0.5), hint, arm_order))) AS band_choice,
         max(CASE WHEN kind <> 'none' AND p > 0 THEN 1 ELSE 0 END) AS helped
  FROM stats GROUP BY id
)"""
)
ALL_STATS = "WITH " + STATS.replace("{source}", "rollouts")


@query("F1", ALL_STATS + """
SELECT id, arm_name, kind, strength, CAST(arm_order AS INTEGER) AS arm_order, round(no_hint_p, 9) AS no_hint_p,
       round(p, 9) AS p_correct, hits > 0 AS pass_at_k, round(hint, 9) AS hint_tokens,
       round(total, 9) AS total_tokens, round(utility, 9) AS utility
FROM stats""")
def item_arm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fr.item_arm_stats(fr.item_frontiers(bridge.rollouts(spark, sf_dir))))


def _choice(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frontiers = fr.item_frontiers(bridge.rollouts(spark, sf_dir))
    return rounded(frontiers.select("id", "no_hint_p", F.col(name).alias("arm_name")))


@query("F3", ALL_STATS + "SELECT id, round(no_hint_p, 9) AS no_hint_p, threshold_choice AS arm_name FROM choices")
def threshold_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choice(spark, sf_dir, "threshold_choice")


@query("F4", ALL_STATS + "SELECT id, round(no_hint_p, 9) AS no_hint_p, band_choice AS arm_name FROM choices")
def band_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choice(spark, sf_dir, "band_choice")


@query("F2", ALL_STATS + "SELECT id, round(no_hint_p, 9) AS no_hint_p, utility_choice AS arm_name FROM choices")
def utility_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choice(spark, sf_dir, "utility_choice")


@query("F6", ALL_STATS + """
SELECT 'utility_choice' AS choice, utility_choice AS arm_name, count(*) AS items FROM choices GROUP BY 1, 2
UNION ALL SELECT 'threshold_choice', threshold_choice, count(*) FROM choices GROUP BY 1, 2
UNION ALL SELECT 'band_choice', band_choice, count(*) FROM choices GROUP BY 1, 2""")
def choice_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.choice_histograms(fr.item_frontiers(bridge.rollouts(spark, sf_dir)))


@query("F5", ALL_STATS + """
SELECT count(*) AS items, CAST(sum(CASE WHEN no_hint_p = 0 THEN helped ELSE 0 END) AS BIGINT) AS rescued_items,
       round(sum(CASE WHEN no_hint_p = 0 THEN helped ELSE 0 END) / count(*), 9) AS rescue_rate
FROM choices""")
def rescue_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fr.rescue_summary(fr.item_frontiers(bridge.rollouts(spark, sf_dir))))


@query("F7", ALL_STATS + """
SELECT arm_name, max(kind) AS arm_kind, max(strength) AS arm_strength, CAST(max(arm_order) AS INTEGER) AS arm_order,
       round(sum(hits) / sum(n), 9) AS rollout_accuracy,
       round(sum(CASE WHEN hits > 0 THEN 1 ELSE 0 END) / count(*), 9) AS pass_at_k,
       round(sum(hint_sum) / sum(n), 9) AS average_hint_tokens,
       round(sum(input_sum) / sum(n), 9) AS average_input_tokens,
       round(sum(output_sum) / sum(n), 9) AS average_output_tokens,
       round(sum(limit_sum) / sum(n), 9) AS generation_limit_rate
FROM stats GROUP BY arm_name""")
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fr.arm_summary(fr.with_truncation_default(bridge.rollouts(spark, sf_dir), 1024)))


SHIFT = (
    "WITH "
    + STATS.replace("{source}", "(SELECT * FROM rollouts WHERE priority > '2-HIGH') w").replace(
        "totals", "w_totals"
    ).replace("based", "w_based").replace("stats AS", "w_stats AS").replace("FROM stats", "FROM w_stats").replace(
        "choices AS", "w_choices AS"
    )
    + ","
    + STATS[len(ov.ROLLOUTS) + 1 :]
    .replace("{source}", "(SELECT * FROM rollouts WHERE priority <= '2-HIGH') s")
    .replace("totals", "s_totals")
    .replace("based", "s_based")
    .replace("stats AS", "s_stats AS")
    .replace("FROM stats", "FROM s_stats")
    .replace("choices AS", "s_choices AS")
    + """,
pairs AS (
  SELECT w.id, w.threshold_choice AS weak_arm, s.threshold_choice AS strong_arm, wa.hint AS weak_hint,
         sa.hint AS strong_hint, w.no_hint_p AS weak_no_hint, s.no_hint_p AS strong_no_hint
  FROM w_choices w JOIN s_choices s ON w.id = s.id
       JOIN w_stats wa ON wa.id = w.id AND wa.arm_name = w.threshold_choice
       JOIN s_stats sa ON sa.id = s.id AND sa.arm_name = s.threshold_choice
)
"""
)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = bridge.rollouts(spark, sf_dir)
    weak = fr.item_frontiers(log.filter(F.col("priority") > "2-HIGH"))
    strong = fr.item_frontiers(log.filter(F.col("priority") <= "2-HIGH"))
    return fr.frontier_pairs(weak, strong)


@query("F17, E6, E7, H10", SHIFT + """
SELECT count(*) AS common_examples,
       round(sum(CASE WHEN weak_arm <> strong_arm THEN 1 ELSE 0 END) / count(*), 9) AS choice_changed_fraction,
       round(sum(CASE WHEN strong_hint < weak_hint THEN 1 ELSE 0 END) / count(*), 9) AS fewer_hint_fraction,
       round(sum(CASE WHEN strong_hint > weak_hint THEN 1 ELSE 0 END) / count(*), 9) AS more_hint_fraction,
       round(sum(CASE WHEN strong_hint = weak_hint THEN 1 ELSE 0 END) / count(*), 9) AS equal_hint_fraction,
       round(avg(weak_hint), 9) AS weak_hint_tokens, round(avg(strong_hint), 9) AS strong_hint_tokens,
       round(avg(weak_no_hint), 9) AS weak_no_hint_accuracy, round(avg(strong_no_hint), 9) AS strong_no_hint_accuracy
FROM pairs""")
def frontier_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fr.frontier_shift(_pairs(spark, sf_dir)))


@query("F17, H9", SHIFT + "SELECT concat(weak_arm, ' -> ', strong_arm) AS transition, count(*) AS items FROM pairs GROUP BY 1")
def frontier_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.frontier_transitions(_pairs(spark, sf_dir))


TRAJECTORIES = (
    "WITH "
    + ov.ROLLOUTS
    + """,
logged AS (
  SELECT *, input_tokens + output_tokens AS cost,
         row_number() OVER (PARTITION BY id, sample_index, arm_name ORDER BY log_pos DESC) AS back
  FROM rollouts
),
arms AS (
  SELECT id, sample_index, arm_name, arm_kind, arm_strength, arm_order, correct, cost, hint_tokens
  FROM logged WHERE back = 1
)"""
)


def _progressive(condition: str) -> str:
    return TRAJECTORIES + f""",
chosen AS (SELECT * FROM arms WHERE {condition}),
walked AS (
  SELECT *, coalesce(max(CASE WHEN correct THEN 1 ELSE 0 END) OVER (
           PARTITION BY id, sample_index ORDER BY arm_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM chosen
),
runs AS (
  SELECT id, sample_index, sum(cost) FILTER (done = 0) AS cost, count(*) FILTER (done = 0) AS calls,
         max(CASE WHEN correct THEN 1 ELSE 0 END) AS success
  FROM walked GROUP BY id, sample_index
),
keyed AS (SELECT DISTINCT id, sample_index FROM arms)
SELECT count(*) AS trajectories, round(sum(coalesce(success, 0)) / count(*), 9) AS accuracy,
       round(sum(coalesce(cost, 0)) / count(*), 9) AS average_total_tokens,
       round(sum(coalesce(calls, 0)) / count(*), 9) AS average_calls
FROM keyed LEFT JOIN runs USING (id, sample_index)"""


def _hindsight(condition: str) -> str:
    return TRAJECTORIES + f""",
runs AS (
  SELECT id, sample_index, min(cost) FILTER (correct AND {condition}) AS success_cost,
         coalesce(min(cost) FILTER (correct AND {condition}), min(cost) FILTER ({condition})) AS cost
  FROM arms GROUP BY id, sample_index
)
SELECT count(*) AS trajectories, round(count(success_cost) / count(*), 9) AS accuracy,
       round(sum(cost) / count(cost), 9) AS average_total_tokens,
       round(sum(success_cost) / count(success_cost), 9) AS average_total_tokens_on_success
FROM runs"""


ANY, PUBLIC = "arm_kind <> ''", "arm_kind IN ('none', 'knowledge', 'solution')"


@query("F8, H1", _progressive(ANY))
def progressive_replay_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.progressive_replay(rp.policy_replays(bridge.rollouts(spark, sf_dir))))


@query("F8, H1", _progressive(PUBLIC))
def progressive_replay_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.progressive_replay(rp.policy_replays(bridge.rollouts(spark, sf_dir)), public=True))


@query("F9", _hindsight(ANY))
def min_cost_hindsight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.min_cost_hindsight(rp.policy_replays(bridge.rollouts(spark, sf_dir))))


@query("F9", _hindsight(PUBLIC))
def min_cost_hindsight_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.min_cost_hindsight(rp.policy_replays(bridge.rollouts(spark, sf_dir)), public=True))


@query("F10", TRAJECTORIES + """,
best AS (
  SELECT arg_max(arm_name, ROW(arm_kind = 'solution', CASE WHEN arm_kind = 'solution' THEN arm_strength ELSE 0 END,
                               CASE WHEN arm_kind = 'solution' THEN -arm_order ELSE arm_order END)) AS arm_name
  FROM arms
)
SELECT arm_name, count(*) AS trajectories, round(sum(CASE WHEN correct THEN 1 ELSE 0 END) / count(*), 9) AS accuracy,
       round(sum(cost) / count(*), 9) AS average_total_tokens
FROM arms WHERE arm_name = (SELECT arm_name FROM best) GROUP BY arm_name""")
def strongest_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.strongest_solution(bridge.rollouts(spark, sf_dir)))


@query("F11", TRAJECTORIES + """,
walked AS (
  SELECT *, coalesce(max(CASE WHEN correct THEN 1 ELSE 0 END) OVER (
           PARTITION BY id, sample_index ORDER BY arm_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM arms WHERE arm_kind IN ('none', 'knowledge', 'solution')
),
paid AS (SELECT sum(cost) FILTER (done = 0) AS cost FROM walked),
runs AS (
  SELECT id, sample_index,
         max(CASE WHEN correct THEN 1 ELSE 0 END) AS full_hit,
         max(CASE WHEN correct AND arm_kind <> 'planning' THEN 1 ELSE 0 END) AS public_hit,
         coalesce(min(cost) FILTER (correct AND arm_kind <> 'planning'), min(cost) FILTER (arm_kind <> 'planning')) AS cost
  FROM arms GROUP BY id, sample_index
)
SELECT round(1.0::DOUBLE - (sum(runs.cost) / count(runs.cost)) / (any_value(paid.cost) / count(*)), 9) AS token_saving_fraction,
       round(sum(full_hit) / count(*) - sum(public_hit) / count(*), 9) AS planning_accuracy_gain
FROM runs CROSS JOIN paid""")
def token_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.token_saving(rp.policy_replays(bridge.rollouts(spark, sf_dir))))


LEVEL_ITEMS = (
    "WITH "
    + ov.ROLLOUTS
    + """,
attempts AS (
  SELECT id, CASE arm_kind WHEN 'none' THEN 0 WHEN 'knowledge' THEN 1 WHEN 'planning' THEN 2 ELSE 3 END AS level,
         correct, output_tokens
  FROM rollouts
),
levels AS (
  SELECT id, level, max(CASE WHEN correct THEN 1 ELSE 0 END) AS hit, count(*) AS calls,
         CAST(sum(output_tokens) AS BIGINT) AS tokens
  FROM attempts GROUP BY id, level
),
solved AS (SELECT id, min(level) FILTER (hit = 1) AS selected_level FROM levels GROUP BY id),
items AS (
  SELECT l.id, coalesce(max(CASE WHEN level = 0 THEN hit END), 0) = 1 AS no_hint_correct,
         coalesce(max(CASE WHEN level = 3 THEN hit END), 0) = 1 AS full_hint_correct,
         any_value(selected_level) IS NOT NULL AS progressive_correct, any_value(selected_level) AS selected_level,
         CAST(sum(calls) FILTER (selected_level IS NULL OR level <= selected_level) AS BIGINT) AS progressive_calls,
         CAST(sum(tokens) FILTER (selected_level IS NULL OR level <= selected_level) AS BIGINT) AS progressive_output_tokens,
         CAST(coalesce(sum(tokens) FILTER (level = 3), 0) AS BIGINT) AS full_hint_output_tokens
  FROM levels l JOIN solved s ON l.id = s.id GROUP BY l.id
)
"""
)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(k) for k in rp.LEVELS]), F.col("arm_kind"))
    log = bridge.rollouts(spark, sf_dir)
    return rp.level_replay(
        log.select("id", (order - 1).cast("int").alias("level"), "correct", "output_tokens", "latency_seconds")
    )


@query("F37", LEVEL_ITEMS + """
SELECT id, no_hint_correct, full_hint_correct, progressive_correct, CAST(selected_level AS INTEGER) AS selected_level,
       coalesce(CASE selected_level WHEN 0 THEN 'none' WHEN 1 THEN 'knowledge' WHEN 2 THEN 'planning'
                WHEN 3 THEN 'solution' END, 'failed') AS selected_level_name,
       NOT no_hint_correct AND selected_level IS NOT NULL AS scaffold_recovered,
       progressive_calls, progressive_output_tokens, full_hint_output_tokens
FROM items""")
def level_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).drop("progressive_latency_seconds", "full_hint_latency_seconds")


@query("F38", LEVEL_ITEMS + """
SELECT count(*) AS num_examples, round(sum(CASE WHEN no_hint_correct THEN 1 ELSE 0 END) / count(*), 9) AS no_hint_accuracy,
       round(sum(CASE WHEN full_hint_correct THEN 1 ELSE 0 END) / count(*), 9) AS full_hint_accuracy,
       round(sum(CASE WHEN progressive_correct THEN 1 ELSE 0 END) / count(*), 9) AS progressive_accuracy,
       CAST(sum(CASE WHEN NOT no_hint_correct AND progressive_correct THEN 1 ELSE 0 END) AS BIGINT) AS scaffold_recovery_count,
       round(sum(selected_level) / count(selected_level), 9) AS average_selected_level_on_success,
       CAST(sum(progressive_calls) AS BIGINT) AS progressive_calls,
       CAST(sum(progressive_output_tokens) AS BIGINT) AS progressive_output_tokens,
       CAST(sum(full_hint_output_tokens) AS BIGINT) AS full_hint_output_tokens
FROM items""")
def level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = rp.level_summary(_levels(spark, sf_dir))
    return rounded(report.drop("progressive_latency_seconds", "full_hint_latency_seconds"))


@query("F38", LEVEL_ITEMS + """
SELECT level, CAST(coalesce(items, 0) AS BIGINT) AS items
FROM (VALUES ('none', 0), ('knowledge', 1), ('planning', 2), ('solution', 3), ('failed', 9)) v(level, code)
     LEFT JOIN (SELECT coalesce(selected_level, 9) AS code, count(*) AS items FROM items GROUP BY 1) h USING (code)""")
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.level_histogram(_levels(spark, sf_dir))


STATES = (
    "WITH "
    + ov.ROLLOUTS
    + """,
per_arm AS (
  SELECT id, question, arm_name, max(arm_kind) AS kind, max(arm_strength) AS strength, count(*) AS n,
         sum(CASE WHEN correct THEN 1 ELSE 0 END) / count(*) AS success,
         CAST(round_even(sum(hint_tokens) / count(*), 0) AS BIGINT) AS hint_tokens, max(reference) AS reference
  FROM rollouts GROUP BY id, question, arm_name
),
roots AS (
  SELECT id, question, reference AS answer, n AS root_samples, success AS root_success
  FROM per_arm WHERE arm_name = 'none'
),
hints AS (
  SELECT p.*, 1.0::DOUBLE - pow(success, 4) - pow(1.0::DOUBLE - success, 4) AS info
  FROM per_arm p JOIN roots USING (id) WHERE arm_name <> 'none' AND p.hint_tokens <= 512
),
picks AS (
  SELECT id, coalesce(
           arg_min(arm_name, ROW(hint_tokens, strength, -info, arm_name)) FILTER (success BETWEEN 0.25 AND 0.60),
           arg_min(arm_name, ROW(hint_tokens, strength, success, arm_name)) FILTER (success >= 0.25),
           arg_max(arm_name, ROW(success, -hint_tokens, -strength, arm_name))) AS pick
  FROM hints GROUP BY id
),
decided AS (
  SELECT r.*, p.pick, h.success AS pick_success, h.info AS pick_info,
         CASE WHEN root_success BETWEEN 0.25 AND 0.60 THEN 'unguided_root'
              WHEN root_success > 0.60 THEN 'unguided_probe'
              WHEN coalesce(h.success >= 0.25, false) THEN 'guided_root'
              ELSE 'decompose_or_defer' END AS phase
  FROM roots r LEFT JOIN picks p ON r.id = p.id LEFT JOIN hints h ON h.id = p.id AND h.arm_name = p.pick
)
"""
)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.root_states(bridge.rollouts(spark, sf_dir), on_missing="skip")


@query("F12", STATES + """
SELECT r.id, r.question, r.answer, r.root_samples, round(r.root_success, 9) AS root_success, p.arm_name AS name,
       p.hint_tokens, p.strength, p.kind, p.n AS samples, round(p.success, 9) AS success
FROM roots r JOIN per_arm p ON r.id = p.id WHERE p.arm_name <> 'none'""")
def root_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir)
    return rounded(
        states.select("id", "question", "answer", "root_samples", "root_success", F.inline("scaffolds"))
    )


@query("F13", STATES + "SELECT r.id, p.pick AS selected_scaffold FROM roots r LEFT JOIN picks p ON r.id = p.id")
def scaffold_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir)
    return states.select("id", cu.select_scaffold("scaffolds", RULES)["name"].alias("selected_scaffold"))


@query("F14, C2, C3", STATES + f"""
SELECT id AS root_id, {ov.question_key('question')} AS question_key, phase, round(root_success, 9) AS root_success,
       round(1.0::DOUBLE - pow(root_success, 4) - pow(1.0::DOUBLE - root_success, 4), 9) AS informative_probability,
       CASE WHEN phase IN ('guided_root', 'decompose_or_defer') THEN pick END AS selected_scaffold,
       CASE WHEN phase IN ('guided_root', 'decompose_or_defer') THEN round(pick_success, 9) END AS selected_scaffold_success,
       CASE WHEN phase IN ('guided_root', 'decompose_or_defer') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS prerequisite_mastery,
       CASE WHEN phase = 'guided_root' THEN round(pick_info, 9) END AS scaffold_informative_probability
FROM decided""")
def curriculum_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = cu.decide_curriculum(_states(spark, sf_dir), RULES)
    return rounded(decisions.drop("reason", "active_subproblem_ids", "unresolved_subproblem_ids"))


@query("F15", STATES + "SELECT phase, count(*) AS roots FROM decided GROUP BY phase")
def phase_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.phase_histogram(curriculum_manifest(spark, sf_dir))


def curriculum_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.decide_curriculum(_states(spark, sf_dir), RULES)


@query("F15", STATES + "SELECT count(*) AS num_roots, round(avg(root_success), 9) AS mean_root_success FROM decided")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cu.manifest_summary(cu.decide_curriculum(_states(spark, sf_dir), RULES)))


# An order is a root: its lines are its subproblems, three flags of a line one's rewards, and the lines' flags the
# hints' and the root's own rewards. Streaks and hint sizes come from the keys, so every phase occurs.
SUB_STATES = """
WITH lines AS (
  SELECT o_orderkey AS k, l_linenumber AS n, l_returnflag = 'R' AS a, l_discount > 0.05 AS b, l_tax > 0.04 AS c,
         CAST(floor(l_quantity) AS BIGINT) AS hint
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
subs AS (
  SELECT k, n, concat(CAST(k AS VARCHAR), '-', CAST(n AS VARCHAR)) AS id, (a::INT + b::INT + c::INT) / 3.0::DOUBLE AS success
  FROM lines
),
roots AS (
  SELECT k, count(*) FILTER (b) / count(*) AS p, k % 4 AS streak FROM lines GROUP BY k
),
hints AS (
  SELECT k, 'knowledge@25' AS name, 0.25::DOUBLE AS strength, min(hint) AS hint, count(*) FILTER (a) / count(*) AS success FROM lines GROUP BY k
  UNION ALL SELECT k, 'solution@100', 1.0::DOUBLE, sum(hint), count(*) FILTER (a OR c) / count(*) FROM lines GROUP BY k
),
usable AS (SELECT *, 1.0::DOUBLE - pow(success, 4) - pow(1.0::DOUBLE - success, 4) AS info FROM hints WHERE hint <= 96),
picks AS (
  SELECT k, coalesce(
           arg_min(name, ROW(hint, strength, -info, name)) FILTER (success BETWEEN 0.25 AND 0.60),
           arg_min(name, ROW(hint, strength, success, name)) FILTER (success >= 0.25),
           arg_max(name, ROW(success, -hint, -strength, name))) AS pick
  FROM usable GROUP BY k
),
taught AS (
  SELECT k, count(*) AS subs, count(*) FILTER (success >= 0.75) / count(*) AS mastery,
         coalesce(string_agg(id, ',' ORDER BY n) FILTER (success BETWEEN 0.25 AND 0.60), '') AS active,
         coalesce(string_agg(id, ',' ORDER BY n) FILTER (success < 0.25), '') AS stuck
  FROM subs WHERE k % 5 <> 0 GROUP BY k
),
decided AS (
  SELECT r.k, r.p, pick, u.success AS pick_success, u.info AS pick_info, coalesce(mastery, 0.0) AS mastery, coalesce(active, '') AS active,
         coalesce(stuck, '') AS stuck,
         CASE WHEN p >= 0.75 AND streak >= 2 THEN 'graduated' WHEN p BETWEEN 0.25 AND 0.60 THEN 'unguided_root'
              WHEN p > 0.60 THEN 'unguided_probe'
              WHEN coalesce(u.success >= 0.25, false) AND (t.k IS NULL OR mastery >= 0.5) THEN 'guided_root'
              WHEN coalesce(active, '') <> '' THEN 'subproblem_curriculum' ELSE 'decompose_or_defer' END AS phase
  FROM roots r LEFT JOIN picks USING (k) LEFT JOIN usable u ON u.k = r.k AND u.name = pick LEFT JOIN taught t ON t.k = r.k
)
"""
SUB_RULES = CurriculumRules(group_size=4, prerequisite_coverage=0.5)


def _subproblem_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward lists of an order: seven lines at most."""
    a, b, c = F.col("l_returnflag") == "R", F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    hint = F.floor("l_quantity").cast("long")
    number = F.col("l_linenumber")

    def reward(flag):
        return flag.cast("double")

    sub = F.struct(number.alias("n"), F.concat_ws("-", F.col("o_orderkey").cast("string"), number.cast("string")).alias("id"), F.array(reward(a), reward(b), reward(c)).alias("rewards"))
    lists = bridge.order_lines(spark, sf_dir).groupBy("o_orderkey").agg(
        F.collect_list(reward(b)).alias("root_rewards"),
        F.array_sort(F.collect_list(sub)).alias("subs"),
        F.collect_list(reward(a)).alias("weak"),
        F.collect_list(reward(a | c)).alias("strong"),
        F.min(hint).alias("least"),
        F.sum(hint).alias("all"),
    )

    def arm(name: str, size: str, strength: float, rewards: str):
        return F.struct(
            F.lit(name).alias("name"), F.col(size).alias("hint_tokens"), F.lit(strength).alias("strength"),
            F.lit(name.split("@")[0]).alias("kind"), F.col(rewards).alias("rewards"),
        )

    taught = F.transform("subs", lambda s: F.struct(s["id"].alias("id"), s["rewards"].alias("rewards")))
    return lists.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("Problem "), F.col("o_orderkey").cast("string")).alias("question"),
        F.lit("0").alias("answer"),
        "root_rewards",
        F.when(F.col("o_orderkey") % 5 != 0, taught).alias("subproblems"),
        F.array(arm("knowledge@25", "least", 0.25, "weak"), arm("solution@100", "all", 1.0, "strong")).alias("scaffolds"),
        (F.col("o_orderkey") % 4).cast("int").alias("consecutive_unguided_mastery"),
    )


@query("F14, F12, C1", SUB_STATES + """
SELECT CAST(k AS VARCHAR) AS root_id, phase, round(p, 9) AS root_success,
       CASE WHEN phase IN ('guided_root', 'subproblem_curriculum', 'decompose_or_defer') THEN pick END AS selected_scaffold,
       CASE WHEN phase IN ('guided_root', 'subproblem_curriculum', 'decompose_or_defer') THEN round(pick_success, 9) END AS selected_scaffold_success,
       CASE WHEN phase IN ('guided_root', 'subproblem_curriculum') THEN active ELSE '' END AS active_ids,
       CASE WHEN phase IN ('guided_root', 'subproblem_curriculum', 'decompose_or_defer') THEN stuck ELSE '' END AS unresolved_ids,
       CASE WHEN phase IN ('guided_root', 'subproblem_curriculum', 'decompose_or_defer') THEN round(mastery, 9) ELSE 1.0 END AS prerequisite_mastery,
       CASE WHEN phase = 'guided_root' THEN round(pick_info, 9) END AS scaffold_informative_probability
FROM decided""")
def subproblem_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions from reward lists, with sub-problem states and streaks; all six phases occur."""
    decisions = cu.decide_curriculum(cu.states_from_rewards(_subproblem_states(spark, sf_dir)), SUB_RULES)
    return rounded(
        decisions.select(
            "root_id", "phase", "root_success", "selected_scaffold", "selected_scaffold_success",
            F.array_join("active_subproblem_ids", ",").alias("active_ids"),
            F.array_join("unresolved_subproblem_ids", ",").alias("unresolved_ids"),
            "prerequisite_mastery", "scaffold_informative_probability",
        )
    )


@query("C13", "WITH " + ov.ROLLOUTS + """
SELECT arm_name, count(*) AS rows, count(*) FILTER (CASE WHEN sample_index % 3 = 0 THEN output_tokens >= 400 ELSE hit_max END) AS limited
FROM rollouts GROUP BY arm_name""")
def truncation_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the records do not say whether they were cut off; their length does."""
    log = bridge.rollouts(spark, sf_dir)
    flag = F.when(F.col("sample_index") % 3 != 0, F.col("hit_max_new_tokens"))
    filled = fr.with_truncation_default(log.withColumn("hit_max_new_tokens", flag), max_new_tokens=400)
    return filled.groupBy("arm_name").agg(F.count(F.lit(1)).alias("rows"), F.count_if("hit_max_new_tokens").alias("limited"))
