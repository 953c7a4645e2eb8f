"""Training mixes, importance weights, routing evaluation and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.functions import scoring as sc
from rungwork.functions import text as tx
from rungwork.operators import curriculum as cu
from rungwork.operators import mixing as mx
from rungwork.operators import reports as rep
from rungwork.operators import routing as ro
from rungwork.operators import weights as we
from rungwork.plans import oracle_views as ov
from rungwork.plans.queries_calibration import plan_sql
from rungwork.plans.queries_frontier import RULES, STATES, rounded
from rungwork.plans.queries_text import strip
from rungwork.plans.registry import query
from rungwork.sources import bridge


# --- training mixes ------------------------------------------------------------------
# success numbers per candidate come from the document itself, so they grow with it
def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("support_tokens")
    return bridge.candidates(spark, sf_dir).withColumns(
        {
            "success_probability": (size % 11) / 10.0,
            "no_help_probability": (size % 7) / 10.0,
            "random_plan_probability": (size % 5) / 10.0,
            "trainable": size % 13 != 0,
        }
    )


SCORED = "WITH " + ov.CANDIDATES + "," + ov.PROBLEMS + f""",
scored AS (
  SELECT *, (support_tokens % 11) / 10.0::DOUBLE AS q_help, (support_tokens % 7) / 10.0::DOUBLE AS q_no,
         (support_tokens % 5) / 10.0::DOUBLE AS q_random, support_tokens % 13 <> 0 AS trainable,
         {ov.question_key('question')} AS question_key
  FROM candidates
),
last_problem AS (
  SELECT * FROM (SELECT *, {ov.question_key('question')} AS question_key,
                        row_number() OVER (PARTITION BY {ov.question_key('question')} ORDER BY log_pos DESC) AS back
                 FROM problems) p WHERE back = 1
)
"""


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.problems(spark, sf_dir)


BARE = (
    "CASE WHEN regexp_matches({s}, '^\\\\boxed\\{{.*\\}}$', 's') "
    "THEN regexp_extract({s}, '^\\\\boxed\\{{(.*)\\}}$', 1, 's') ELSE {s} END"
).format(s=strip("s.subproblem_answer"))


@query("E1, G1, G2", SCORED + f"""
SELECT s.id AS candidate_id, {ov.seeded(42, 's.id')} AS pair, CAST(slot AS INTEGER) AS slot, p.id AS id, p.log_pos AS log_pos,
       sha1(CASE slot WHEN 0 THEN p.question ELSE s.subproblem END) AS question_digest,
       CASE slot WHEN 0 THEN p.ground_truth ELSE {BARE} END AS ground_truth,
       p.data_source, CASE slot WHEN 0 THEN p.accuracy ELSE 0.0 END AS accuracy,
       CASE slot WHEN 0 THEN NULL ELSE round(s.q_help, 9) END AS subproblem_q,
       CASE slot WHEN 0 THEN NULL ELSE {ov.question_key('s.subproblem')} END AS subproblem_key,
       CAST(CASE slot WHEN 0 THEN len(p.planning_parts) ELSE 0 END AS INTEGER) AS planning_parts
FROM scored s JOIN last_problem p ON s.question_key = p.question_key CROSS JOIN (VALUES (0), (1)) v(slot)
WHERE s.trainable""")
def training_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mx.training_mix(_source(spark, sf_dir), _measured(spark, sf_dir), seed=42)
    return rounded(
        mix.select(
            "candidate_id",
            "pair",
            "slot",
            "id",
            "log_pos",
            F.sha1("question").alias("question_digest"),
            F.col("reward_model.ground_truth").alias("ground_truth"),
            "data_source",
            "accuracy",
            F.col("extra_info.subproblem_q").alias("subproblem_q"),
            F.col("extra_info.subproblem_key").alias("subproblem_key"),
            F.size("planning_skeleton_parts").alias("planning_parts"),
        )
    )


@query("G3", SCORED + """
SELECT s.id AS candidate_id, p.id, p.log_pos FROM scored s JOIN last_problem p ON s.question_key = p.question_key
WHERE s.trainable""")
def matched_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mx.training_mix(_source(spark, sf_dir), _measured(spark, sf_dir), seed=42)
    return mx.matched_roots(mix).select("candidate_id", "id", "log_pos")


@query("G2, H9", SCORED + """
, taken AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY log_pos) AS nth, count(*) OVER () AS n FROM scored WHERE trainable) t WHERE nth <= greatest(1, n // 3)
)
SELECT count(p.id) AS root_rows, count(p.id) AS subproblem_rows, 2 * count(p.id) AS total_rows,
       count(*) FILTER (p.id IS NULL) AS candidate_rows_not_matched
FROM taken s LEFT JOIN last_problem p ON s.question_key = p.question_key""")
def mix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _source(spark, sf_dir)
    rows = _measured(spark, sf_dir).filter("trainable")
    third = max(1, rows.count() // 3)
    mix = mx.training_mix(source, rows, seed=42, max_pairs=third)
    return mx.mix_summary(mix, mx.unmatched_candidates(source, mx.first_in_log(rows, third)))


@query("F46", SCORED + """
, n AS (SELECT count(*) AS roots FROM scored s JOIN last_problem p ON s.question_key = p.question_key WHERE s.trainable)
SELECT 'mixed_is_twice_root' AS "check", CAST(2 * roots AS DOUBLE) AS value, CAST(2 * roots AS DOUBLE) AS bound, roots > 0 AS ok FROM n
UNION ALL SELECT 'subproblems_equal_roots', CAST(roots AS DOUBLE), CAST(roots AS DOUBLE), true FROM n
UNION ALL SELECT 'minimum_training_roots', CAST(roots AS DOUBLE), 64.0, roots >= 64 FROM n""")
def mix_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mx.training_mix(_source(spark, sf_dir), _measured(spark, sf_dir), seed=42)
    return rep.mix_checks(mix, minimum_roots=64)


@query("G4, E14", SCORED + f"""
, planned AS (SELECT *, {plan_sql()} AS plan FROM scored),
last_candidate AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_key ORDER BY log_pos DESC) AS back FROM planned) c WHERE back = 1
)
SELECT s.id AS candidate_id, c.root_id, s.question_key, round(c.q_no, 9) AS root_success,
       round(c.q_help, 9) AS selected_scaffold_success, c.id AS active_id, round(c.q_help - c.q_no, 9) AS gain_over_no_help,
       round(c.q_help - c.q_random, 9) AS gain_over_random, c.plan AS minimal_plan, c.plan AS planning_part
FROM planned s JOIN last_problem p ON s.question_key = p.question_key JOIN last_candidate c ON c.question_key = s.question_key
WHERE s.trainable""")
def plan_decorated_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.coalesce(
        F.nullif(tx.collapse("source_step"), F.lit("")), F.nullif(tx.collapse("subproblem"), F.lit("")), F.lit("")
    )
    plan = F.btrim(F.array_join(F.slice(tx.words(step), 1, 12), " "), F.lit(" ."))
    rows = _measured(spark, sf_dir).withColumn("minimal_plan", plan)
    decorated = mx.plan_decorated_roots(_source(spark, sf_dir), rows)
    return rounded(
        decorated.select(
            "candidate_id",
            "decision.root_id",
            "question_key",
            "decision.root_success",
            "decision.selected_scaffold_success",
            F.get("decision.active_subproblem_ids", F.lit(0)).alias("active_id"),
            "decision.gain_over_no_help",
            "decision.gain_over_random",
            "decision.minimal_plan",
            F.get("row.planning_skeleton_parts", F.lit(0)).alias("planning_part"),
        )
    )


STAGES = SCORED + f"""
, raw_plans AS (
  SELECT *, {plan_sql()} AS plan, {ov.alnum_key('subproblem_answer')} AS answer_key, {ov.alnum_key('reference')} AS secret FROM scored
),
usable AS (
  SELECT * FROM raw_plans
  WHERE plan <> '' AND NOT (answer_key <> '' AND contains({ov.alnum_key('plan')}, answer_key))
    AND NOT (secret <> '' AND contains({ov.alnum_key('plan')}, secret))
),
learn AS (
  SELECT id, CASE WHEN support_tokens % 3 <> 0 THEN (support_tokens % 9) / 8.0::DOUBLE END AS p_sub FROM candidates
),
scores AS (
  SELECT u.*, l.p_sub, 1.0::DOUBLE - pow(l.p_sub, 8) - pow(1.0::DOUBLE - l.p_sub, 8) AS contrast,
         u.q_help - greatest(u.q_no, u.q_random) AS relevance
  FROM usable u JOIN last_problem p ON u.question_key = p.question_key JOIN learn l ON l.id = u.id
),
staged AS (
  SELECT *, greatest(relevance, 0.0) * coalesce(contrast, 1.0) AS final,
         CASE WHEN q_help >= 0.6 THEN 'root_scaffold' WHEN p_sub IS NOT NULL AND NOT (p_sub > 0 AND p_sub < 1) THEN 'root_scaffold'
              WHEN contrast IS NULL OR contrast >= 0.7 THEN 'precondition' ELSE 'root_scaffold' END AS stage
  FROM scores
)
"""


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measured(spark, sf_dir)
    size = F.col("support_tokens")
    learn = rows.filter(size % 3 != 0).select(
        F.col("id").alias("candidate_id"), ((size % 9) / 8.0).alias("p_sub"), "log_pos"
    )
    return mx.staged_pairs(_source(spark, sf_dir), rows, learn, group_size=8, ready=0.6, contrast_min=0.7)


@query("G5, C14, C15, E8", STAGES + """
SELECT root_id, id AS candidate_id, dimension, subproblem, subproblem_answer, plan AS minimal_plan, stage AS current_stage,
       round(q_help, 9) AS q_help, round(q_no, 9) AS q_no, round(q_random, 9) AS q_random, round(relevance, 9) AS relevance_score,
       round(p_sub, 9) AS p_sub, round(contrast, 9) AS contrast_score, round(final, 9) AS final_score
FROM staged""")
def preconditioning_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mx.selected_pairs(_staged(spark, sf_dir)))


@query("G5", STAGES + """
SELECT count(*) AS selected_roots, count(*) FILTER (stage = 'precondition') AS precondition_roots,
       count(*) FILTER (stage = 'root_scaffold') AS root_scaffold_roots,
       2 * count(*) FILTER (stage = 'precondition') AS precondition_rows
FROM staged""")
def student_aware_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.stage_summary(_staged(spark, sf_dir))


@query("G5", STAGES + """
SELECT root_id, question_key, round(q_no, 9) AS root_success,
       round(1.0::DOUBLE - pow(q_no, 8) - pow(1.0::DOUBLE - q_no, 8), 9) AS informative_probability,
       round(q_help, 9) AS selected_scaffold_success, id AS active_id,
       CASE WHEN stage = 'precondition' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS prerequisite_mastery
FROM staged""")
def stage_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mx.stage_curriculum(_staged(spark, sf_dir))
    return rounded(
        rows.select(
            "root_id",
            "question_key",
            "root_success",
            "informative_probability",
            "selected_scaffold_success",
            F.get("active_subproblem_ids", F.lit(0)).alias("active_id"),
            "prerequisite_mastery",
        )
    )


@query("G5", STAGES + """
SELECT p.id, p.log_pos, sha1(p.question) AS question_digest, p.ground_truth FROM staged s JOIN last_problem p ON s.question_key = p.question_key""")
def stage_root_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root-only training set: the matched roots as they are."""
    rows = mx.stage_roots(_staged(spark, sf_dir))
    return rows.select("id", "log_pos", F.sha1("question").alias("question_digest"), F.col("reward_model.ground_truth").alias("ground_truth"))


@query("G5", STAGES + """
SELECT stage AS student_aware_stage, plan AS minimal_plan, id AS selected_candidate_id, dimension AS selected_dimension,
       round(q_help, 9) AS q_help, round(q_no, 9) AS q_no, round(q_random, 9) AS q_random, round(relevance, 9) AS relevance_score,
       round(p_sub, 9) AS p_sub, round(contrast, 9) AS contrast_score, round(final, 9) AS final_score
FROM staged""")
def stage_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage's manifest says about each decision."""
    return rounded(mx.stage_curriculum(_staged(spark, sf_dir)).select("diagnostics.*"))


@query("G5", STAGES + """
SELECT dimension, stage, count(*) AS rows, count(DISTINCT plan) AS plans, round(avg(final), 9) AS mean_final
FROM staged GROUP BY dimension, stage""")
def stage_scaffold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mx.stage_scaffold_rows(_staged(spark, sf_dir))
    return rounded(
        rows.groupBy(
            F.col("extra_info.selected_dimension").alias("dimension"),
            F.col("extra_info.student_aware_stage").alias("stage"),
        ).agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct(F.get("planning_skeleton_parts", F.lit(0))).alias("plans"),
            F.avg("extra_info.final_score").alias("mean_final"),
        )
    )


@query("G5", STAGES + """
SELECT CAST(slot AS INTEGER) AS slot, count(*) AS rows, count(DISTINCT CASE slot WHEN 0 THEN question ELSE subproblem END) AS questions
FROM staged CROSS JOIN (VALUES (0), (1)) v(slot) WHERE stage = 'precondition' GROUP BY slot""")
def stage_precondition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mx.stage_precondition_rows(_staged(spark, sf_dir))
    return rows.groupBy("slot").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.sha1("question")).alias("questions")
    )


# --- fading and curriculum rollouts --------------------------------------------------
@query("C5, C7", """
SELECT o_orderkey AS step, round(f, 9) AS visible_fraction, CAST(least(8, greatest(0, floor(8 * f + 0.5::DOUBLE))) AS INTEGER) AS guided_rollouts
FROM (SELECT o_orderkey, CASE WHEN o_orderkey <= 100 THEN 1.0::DOUBLE WHEN o_orderkey >= 5100 THEN 0.0::DOUBLE
             ELSE 1.0::DOUBLE + (o_orderkey - 100) / 5000.0::DOUBLE * (0.0::DOUBLE - 1.0::DOUBLE) END AS f FROM orders) s""")
def fade_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = bridge.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"))
    return rounded(cu.fade_schedule(steps, fade_start=100, fade_end=5100, rollouts=8))


def _list(expr: str) -> str:
    return f"list_filter(list_transform({expr}, lambda x: {strip('x')}), lambda x: x <> '')"


FADED = "WITH " + ov.PROBLEMS + f""",
clean AS (SELECT log_pos, {_list('planning_parts')} AS many, {_list('solution_parts')} AS one, (log_pos % 5) / 4.0::DOUBLE AS f FROM problems),
cut AS (
  SELECT log_pos, CASE WHEN len(many) = 0 OR f = 0 THEN '' WHEN len(many) = 1 AND f < 1
           THEN array_to_string(string_split({ov.collapse('many[1]')}, ' ')[1:CAST(greatest(1, ceil(len(string_split({ov.collapse('many[1]')}, ' ')) * f)) AS BIGINT)], ' ')
           ELSE array_to_string(many[1:CAST(greatest(1, ceil(len(many) * f)) AS BIGINT)], '|') END AS many,
         CASE WHEN len(one) = 0 OR f = 0 THEN '' WHEN f < 1
           THEN array_to_string(string_split({ov.collapse('one[1]')}, ' ')[1:CAST(greatest(1, ceil(len(string_split({ov.collapse('one[1]')}, ' ')) * f)) AS BIGINT)], ' ')
           ELSE one[1] END AS one
  FROM clean
)
SELECT log_pos, many, one FROM cut"""


@query("C6", FADED)
def faded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = (F.col("log_pos") % 5) / 4.0
    rows = bridge.problems(spark, sf_dir)
    return rows.select(
        "log_pos",
        F.array_join(sc.fade_parts("planning_skeleton_parts", shown), "|").alias("many"),
        F.array_join(sc.fade_parts("solution_breakdown_parts", shown), "|").alias("one"),
    )


@query("D4, D5, E5, B24, B32", STATES + f"""
, manifest AS (SELECT {ov.question_key('question')} AS question_key, phase, pick FROM decided),
keyed AS (SELECT c_custkey, {ov.question_key("concat('Problem ', CAST(c_custkey AS VARCHAR))")} AS question_key,
                 [c_name, c_mktsegment, 'k3'] AS k, [c_mktsegment, c_name, 'p3', 'p4'] AS p, ['s1', c_name] AS s FROM customer),
asked AS (
  SELECT c_custkey, coalesce(m.phase, 'unguided_root') AS phase, CASE WHEN m.phase = 'guided_root' THEN m.pick END AS name,
         CASE split_part(m.pick, '@', 1) WHEN 'knowledge' THEN k WHEN 'planning' THEN p ELSE s END AS parts
  FROM keyed LEFT JOIN manifest m ON keyed.question_key = m.question_key
),
cut AS (
  SELECT *, parts[1:CAST(greatest(1, ceil(len(parts) * CAST(split_part(name, '@', 2) AS DOUBLE) / 100)) AS BIGINT)] AS kept FROM asked
),
faded AS (
  SELECT *, CASE WHEN name IS NULL THEN '' WHEN len(kept) = 1
      THEN array_to_string(string_split(kept[1], ' ')[1:CAST(greatest(1, ceil(len(string_split(kept[1], ' ')) * 0.75)) AS BIGINT)], ' ')
      ELSE array_to_string(kept[1:CAST(greatest(1, ceil(len(kept) * 0.75)) AS BIGINT)], '|') END AS hints
  FROM cut
)
SELECT c_custkey, CAST(i AS INTEGER) AS rollout_index,
       CASE WHEN name IS NOT NULL AND i < 3 THEN CASE split_part(name, '@', 1) WHEN 'knowledge' THEN 1 WHEN 'planning' THEN 5 ELSE 9 END ELSE 0 END AS hint_level,
       CASE WHEN name IS NOT NULL AND i < 3 THEN phase ELSE 'unguided_dropout' END AS curriculum_phase,
       CASE WHEN name IS NOT NULL AND i < 3 THEN name END AS scaffold_name,
       CASE WHEN name IS NOT NULL AND i < 3 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS visible_fraction,
       CASE WHEN name IS NOT NULL AND i < 3 THEN hints ELSE '' END AS hints
FROM faded CROSS JOIN (VALUES (0), (1), (2), (3)) v(i)""")
def curriculum_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = cu.root_states(bridge.rollouts(spark, sf_dir), on_missing="skip")
    manifest = cu.decide_curriculum(states, RULES)
    problems = bridge.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("Problem "), F.col("c_custkey").cast("string")).alias("question"),
        F.array("c_name", "c_mktsegment", F.lit("k3")).alias("knowledge_components_parts"),
        F.array("c_mktsegment", "c_name", F.lit("p3"), F.lit("p4")).alias("planning_skeleton_parts"),
        F.array(F.lit("s1"), F.col("c_name")).alias("solution_breakdown_parts"),
    )
    requests = cu.regeneration_requests(problems, manifest, step=25, fade_start=0, fade_end=100)
    rows = cu.curriculum_rollouts(requests, rollouts=4)
    return rows.select(
        "c_custkey",
        "rollout_index",
        "hint_level",
        "curriculum_phase",
        "scaffold_name",
        "visible_fraction",
        F.array_join("hint_parts", "|").alias("hints"),
    )


# --- importance weights --------------------------------------------------------------
RATIOS = "WITH " + ov.LOGPROBS + """,
ratios AS (
  SELECT id, any_value(off_context) AS off_context, sum((target - behavior) * mask) AS log_ratio, sum(mask) AS valid
  FROM logprobs GROUP BY id
),
weights AS (
  SELECT id, off_context, CASE WHEN off_context THEN exp(least(ln(5.0::DOUBLE), greatest(ln(0.2::DOUBLE), log_ratio))) ELSE 1.0::DOUBLE END AS weight
  FROM ratios
)
"""


@query("C8, C9, C11", RATIOS + "SELECT id, off_context, round(weight, 9) AS weight FROM weights")
def importance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = we.weight_trajectories(bridge.logprobs(spark, sf_dir))
    return rounded(rows.select("id", "off_context", "weight"))


@query("C10", RATIOS + """
SELECT l.id, CAST(l.pos AS INTEGER) AS pos, round(advantage * weight * mask, 9) + 0.0::DOUBLE AS weighted
FROM logprobs l JOIN weights w ON l.id = w.id""")
def weighted_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = we.weight_trajectories(bridge.logprobs(spark, sf_dir))
    cells = rows.select("id", F.posexplode("weighted_advantages").alias("pos", "weighted"))
    return rounded(cells.withColumn("pos", F.col("pos") + 1)).withColumn("weighted", F.col("weighted") + 0.0)


@query("C11", RATIOS + """
SELECT round(avg(weight), 9) AS is_weight_mean, round(min(weight), 9) AS is_weight_min, round(max(weight), 9) AS is_weight_max,
       count(*) AS off_context_count FROM weights WHERE off_context""")
def weight_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(we.weight_metrics(we.weight_trajectories(bridge.logprobs(spark, sf_dir))))


@query("C12", RATIOS + """
SELECT round(pow(sum(weight), 2) / sum(weight * weight), 6) AS effective_sample_size, count(*) AS weights FROM weights""")
def effective_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = we.weight_trajectories(bridge.logprobs(spark, sf_dir))
    return rounded(we.effective_sample_size(rows), 6)


# --- routing -------------------------------------------------------------------------
# a fixed formula stands in for the model, so the policies can be checked exactly
SCORE = "CAST((hint_tokens * 7 + output_tokens * 3 + arm_order * 11) % 101 AS DOUBLE) / 100"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.col("hint_tokens") * 7 + F.col("output_tokens") * 3 + F.col("arm_order") * 11
    log = ro.with_item_key(bridge.rollouts(spark, sf_dir))
    return log.withColumn("predicted_success", (mixed % 101).cast("double") / 100)


ROUTED = "WITH " + ov.ROLLOUTS + f""",
logged AS (
  SELECT *, concat(id, '::', substr(sha1(question), 1, 12)) AS item_key, {SCORE} AS p, input_tokens + output_tokens AS cost,
         row_number() OVER (PARTITION BY id, sample_index, arm_name ORDER BY log_pos DESC) AS back
  FROM rollouts
),
arms AS (SELECT * FROM logged WHERE back = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_key, sample_index ORDER BY p < 0.7, CASE WHEN p >= 0.7 THEN cost END,
              CASE WHEN p < 0.7 THEN -(p - 0.02::DOUBLE * hint_tokens / 100.0::DOUBLE) END, cost, arm_order) AS pref
  FROM arms
),
direct AS (SELECT * FROM ranked WHERE pref = 1),
others AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.item_key, r.sample_index ORDER BY -(r.p / greatest(r.cost, 1.0::DOUBLE)), r.arm_order) AS turn
  FROM ranked r JOIN direct d ON r.item_key = d.item_key AND r.sample_index = d.sample_index
  WHERE r.pref > 1 AND NOT d.correct
),
walked AS (
  SELECT *, coalesce(max(CASE WHEN correct THEN 1 ELSE 0 END) OVER (PARTITION BY item_key, sample_index ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM others WHERE turn <= 2
),
extra AS (
  SELECT item_key, sample_index, sum(cost) AS cost, count(*) AS calls, max(CASE WHEN correct THEN 1 ELSE 0 END) AS hit,
         string_agg(arm_name, '|' ORDER BY turn) AS names
  FROM walked WHERE done = 0 GROUP BY item_key, sample_index
),
public_walk AS (
  SELECT *, coalesce(max(CASE WHEN correct THEN 1 ELSE 0 END) OVER (PARTITION BY item_key, sample_index ORDER BY arm_order
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM arms WHERE arm_kind <> 'planning'
),
public AS (
  SELECT item_key, sample_index, sum(cost) FILTER (done = 0) AS cost, count(*) FILTER (done = 0) AS calls,
         max(CASE WHEN correct THEN 1 ELSE 0 END) AS hit
  FROM public_walk GROUP BY item_key, sample_index
),
whole AS (
  SELECT item_key, sample_index, count(*) FILTER (correct) > 0 AS oracle_correct,
         coalesce(min(cost) FILTER (correct), min(cost)) AS oracle_cost,
         arg_max(correct, ROW(arm_kind = 'solution', arm_strength, arm_order)) AS strong_correct,
         arg_max(cost, ROW(arm_kind = 'solution', arm_strength, arm_order)) AS strong_cost
  FROM arms GROUP BY item_key, sample_index
),
runs AS (
  SELECT d.item_key, d.sample_index, d.arm_name AS selected_arm, d.p AS predicted_success, d.correct, d.cost AS action_cost,
         concat_ws('|', d.arm_name, e.names) AS fallback_arms, d.correct OR coalesce(e.hit, 0) = 1 AS fallback_correct,
         d.cost + coalesce(e.cost, 0) AS fallback_cost, 1 + coalesce(e.calls, 0) AS fallback_calls,
         coalesce(pu.cost, 0) AS public_cost, coalesce(pu.calls, 0) AS public_calls, coalesce(pu.hit, 0) AS public_hit,
         w.oracle_correct, w.oracle_cost, w.strong_correct, w.strong_cost
  FROM direct d LEFT JOIN extra e ON d.item_key = e.item_key AND d.sample_index = e.sample_index
       LEFT JOIN public pu ON d.item_key = pu.item_key AND d.sample_index = pu.sample_index
       JOIN whole w ON d.item_key = w.item_key AND d.sample_index = w.sample_index
)
"""


@query("F39, H1, H6", ROUTED + """
SELECT item_key, sample_index, selected_arm, round(predicted_success, 9) AS predicted_success, correct, action_cost,
       fallback_arms, fallback_correct FROM runs""")
def routing_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = ro.routing_decisions(ro.routing_runs(_scored(spark, sf_dir), 0.7, 2))
    return rounded(decisions.withColumn("fallback_arms", F.array_join("fallback_arms", "|")))


@query("F39", ROUTED + """
, t AS (SELECT count(DISTINCT item_key) AS items, count(*) AS trajectories FROM runs)
SELECT items, trajectories, v.* FROM t CROSS JOIN (
  SELECT 'direct_router' AS policy, round(count(*) FILTER (correct) / count(*), 9) AS accuracy, round(sum(action_cost) / count(*), 9) AS average_total_tokens, 1.0::DOUBLE AS average_calls FROM runs
  UNION ALL SELECT 'bounded_fallback', round(count(*) FILTER (fallback_correct) / count(*), 9), round(sum(fallback_cost) / count(*), 9), round(sum(fallback_calls) / count(*), 9) FROM runs
  UNION ALL SELECT 'public_progressive', round(sum(public_hit) / count(*), 9), round(sum(public_cost) / count(*), 9), round(sum(public_calls) / count(*), 9) FROM runs
  UNION ALL SELECT 'full_information', round(count(*) FILTER (oracle_correct) / count(*), 9), round(sum(oracle_cost) / count(*), 9), NULL FROM runs
  UNION ALL SELECT 'strongest_solution', round(count(*) FILTER (strong_correct) / count(*), 9), round(sum(strong_cost) / count(*), 9), 1.0::DOUBLE FROM runs) v""")
def routing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ro.routing_metrics(ro.routing_runs(_scored(spark, sf_dir), 0.7, 2)))


SPLIT_KEY = "concat(CAST(c_custkey AS VARCHAR), '::', substr(sha1(concat('Problem ', CAST(c_custkey AS VARCHAR))), 1, 12))"


@query("H7, B3", f"""
SELECT item_key, CASE WHEN rank <= cut1 THEN 'train' WHEN rank <= cut2 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT item_key, row_number() OVER (ORDER BY {ov.seeded(42, 'item_key')}) AS rank,
             greatest(1, floor(count(*) OVER () * 0.6::DOUBLE)) AS cut1,
             least(count(*) OVER () - 1, greatest(greatest(1, floor(count(*) OVER () * 0.6::DOUBLE)) + 1, floor(count(*) OVER () * (0.6::DOUBLE + 0.2::DOUBLE)))) AS cut2
      FROM (SELECT {SPLIT_KEY} AS item_key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)) k) r""")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ro.grouped_split(ro.with_item_key(bridge.rollouts(spark, sf_dir)), seed=42)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return scored.select(F.col("correct").cast("int").alias("label"), F.col("predicted_success").alias("p"))


PROBABILITIES = "WITH " + ov.ROLLOUTS + f""",
scored AS (SELECT CASE WHEN correct THEN 1 ELSE 0 END AS label, {SCORE} AS p FROM rollouts)
"""


@query("F40", PROBABILITIES + """
, bins AS (SELECT i, i / 10.0::DOUBLE AS lo, (i + 1) / 10.0::DOUBLE AS hi FROM (SELECT unnest(range(0, 10)) AS i) r),
filled AS (
  SELECT i, count(*) AS n, abs(sum(p) / count(*) - sum(label) / count(*)) AS gap
  FROM scored JOIN bins ON (p >= lo AND p < hi) OR (i = 9 AND p = 1.0) GROUP BY i
)
SELECT round(sum(n * gap) / sum(n), 9) AS expected_calibration_error, CAST(sum(n) AS BIGINT) AS rows FROM filled""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ro.calibration_error(_labelled(spark, sf_dir), bins=10))


@query("F41", PROBABILITIES + """
, ranked AS (
  SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS mid FROM scored
)
SELECT round(avg(pow(p - label, 2)), 9) AS brier_score,
       round(-avg(label * ln(least(1 - 2.220446049250313e-16::DOUBLE, greatest(2.220446049250313e-16::DOUBLE, p)))
             + (1 - label) * ln(1 - least(1 - 2.220446049250313e-16::DOUBLE, greatest(2.220446049250313e-16::DOUBLE, p)))), 7) AS log_loss,
       round((sum(CASE WHEN label = 1 THEN mid END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
             / (sum(label)::DOUBLE * (count(*) - sum(label))), 9) AS roc_auc,
       round(avg(label), 9) AS positive_rate, count(*) AS rows
FROM ranked""")
def probability_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = rounded(ro.probability_metrics(_labelled(spark, sf_dir)))
    return metrics.withColumn("log_loss", F.round("log_loss", 7))


# --- reports -------------------------------------------------------------------------
NATIONS = tuple(f"NATION_{k}" for k in range(7))


@query("F42", "WITH " + ov.EVAL_SCORES + f""",
listed AS (SELECT * FROM eval_scores WHERE dataset IN {NATIONS} AND NOT (dataset = 'NATION_3' AND method = '1-URGENT')),
whole AS (SELECT method FROM listed GROUP BY method HAVING count(DISTINCT dataset) = 7),
rows AS (
  SELECT dataset, method, score FROM listed SEMI JOIN whole USING (method)
  UNION ALL SELECT NULL, method, avg(score) FROM listed SEMI JOIN whole USING (method) GROUP BY method
),
budgets AS (SELECT o_orderpriority AS method, count(*) * 7 * 8 AS trajectories FROM orders GROUP BY 1)
SELECT r.dataset, r.method, round(r.score, 9) AS score, round(r.score - b.score, 9) AS delta, t.trajectories
FROM rows r LEFT JOIN rows b ON b.method = '5-LOW' AND r.dataset IS NOT DISTINCT FROM b.dataset JOIN budgets t ON t.method = r.method""")
def eval_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One method lacks a score of the fixed seven datasets and is left out."""
    scores = bridge.eval_scores(spark, sf_dir).filter("not (dataset = 'NATION_3' and method = '1-URGENT')")
    budgets = bridge.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(
        F.count(F.lit(1)).alias("steps"), F.lit(7).alias("prompts_per_step"), F.lit(8).alias("rollouts_per_prompt")
    )
    return rounded(rep.eval_comparison(scores, "5-LOW", NATIONS, incomplete="skip", budgets=budgets))


@query("F43", "WITH " + ov.EVAL_SCORES + """,
joined AS (
  SELECT s.dataset, s.score * 100.0::DOUBLE AS reproduced, CAST(10 + n_regionkey * 10 AS DOUBLE) AS published
  FROM eval_scores s JOIN nation ON s.dataset = n_name WHERE method = '1-URGENT'
)
SELECT dataset, round(reproduced, 9) AS reproduced, round(published, 9) AS published, round(reproduced - published, 9) AS gap_pp FROM joined
UNION ALL SELECT NULL, round(avg(reproduced), 9), round(avg(published), 9), round(avg(reproduced) - avg(published), 9) FROM joined""")
def eval_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = bridge.eval_scores(spark, sf_dir).filter(F.col("method") == "1-URGENT").select("dataset", "score")
    nation = bridge.table(spark, sf_dir, "nation")
    reference = nation.select(
        F.col("n_name").alias("dataset"), (F.col("n_regionkey") * 10 + 10).cast("double").alias("published")
    )
    return rounded(rep.eval_gap(scores, reference))


@query("F46", """
SELECT run_id, c.name AS "check", round(c.value, 9) AS value, c.bound, c.ok
FROM (SELECT o_orderpriority AS run_id, count(*) FILTER (l_returnflag = 'R') / count(*) AS valid_rate,
             count(*) FILTER (l_quantity > 40) AS in_band, avg(l_tax) - 0.03::DOUBLE AS gain, count(DISTINCT o_custkey) AS roots
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority) s,
     LATERAL (VALUES ('valid_candidate_rate', valid_rate, 0.5::DOUBLE, valid_rate >= 0.5), ('candidates_in_band', in_band::DOUBLE, 8.0::DOUBLE, in_band >= 8),
                     ('gain_over_random', gain, 0.0::DOUBLE, gain > 0), ('minimum_training_roots', roots::DOUBLE, 64.0::DOUBLE, roots >= 64)) c(name, value, bound, ok)""")
def data_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = bridge.order_lines(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("run_id")).agg(
        (F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias("valid_rate"),
        F.count_if(F.col("l_quantity") > 40).alias("in_band"),
        (F.avg("l_tax") - 0.03).alias("gain"),
        F.count_distinct("o_custkey").alias("training_roots"),
    )
    return rounded(rep.data_gates(runs, minimum_roots=64))


ASSESS = "WITH " + ov.VARIANTS + """,
runs AS (SELECT *, CAST(sample_index % 7 AS VARCHAR) AS run_id FROM variants),
acc AS (
  SELECT run_id, count(DISTINCT id) AS questions,
         count(*) FILTER (variant = 'no_help' AND correct) / count(*) FILTER (variant = 'no_help') AS no_help,
         count(*) FILTER (variant = 'random_bit' AND correct) / count(*) FILTER (variant = 'random_bit') AS random_bit,
         count(*) FILTER (variant = 'self_asked_verification' AND correct) / count(*) FILTER (variant = 'self_asked_verification') AS self_asked,
         greatest(count(*) FILTER (variant = 'knowledge_min' AND correct) / count(*) FILTER (variant = 'knowledge_min'),
                  count(*) FILTER (variant = 'planning_min' AND correct) / count(*) FILTER (variant = 'planning_min')) AS minimal,
         count(*) FILTER (correct AND props_tokens % 2 = 0) / count(*) FILTER (props_tokens % 2 = 0) AS retry,
         avg(total_generated_tokens) / 100.0::DOUBLE AS saving, count(*) FILTER (props_tokens > 50) / count(*) AS valid_rate,
         count(*) FILTER (correct) / count(*) AS rescue, count(*) FILTER (variant = 'no_help') AS n_none,
         count(*) FILTER (props_tokens = 7) AS fallback, count(*) FILTER (correct AND props_tokens % 3 = 0) AS rescues,
         count(*) FILTER (correct AND props_tokens % 3 = 1) AS harms
  FROM runs GROUP BY run_id
),
gates AS (
  SELECT *, rescue >= 0.15 AS scaffold_gate, saving >= 0.30 AS cost_gate,
         self_asked - random_bit >= 0.05 AND rescue - no_help >= 0 AS relevance_gate, valid_rate >= 0.70 AS construction_gate,
         self_asked - greatest(no_help, random_bit) >= 0.05 AND rescues > harms AS self_check_gate,
         retry - no_help >= 0.05 AS feedback_gate, minimal - no_help >= 0.10 AS information_gate
  FROM acc
)
SELECT run_id, CASE WHEN relevance_gate AND scaffold_gate AND construction_gate THEN 'promising'
                    WHEN (scaffold_gate AND cost_gate) OR relevance_gate THEN 'mixed_evidence' ELSE 'not_supported_yet' END AS scheme1_status,
       CASE WHEN self_check_gate AND feedback_gate THEN 'promising'
            WHEN feedback_gate OR information_gate THEN 'mixed_evidence' ELSE 'not_supported_yet' END AS scheme2_status,
       scaffold_gate, cost_gate, relevance_gate, construction_gate, self_check_gate, feedback_gate, information_gate,
       CAST(CASE WHEN questions < 32 THEN 1 ELSE 0 END + CASE WHEN rescue > 0.2 THEN 1 ELSE 0 END + CASE WHEN fallback > 0 THEN 1 ELSE 0 END AS INTEGER) AS warnings
FROM gates"""


@query("E12, F45", ASSESS)
def feasibility_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = bridge.variant_rollouts(spark, sf_dir).withColumn("run_id", (F.col("sample_index") % 7).cast("string"))
    n = F.count(F.lit(1))
    k = F.col("props_tokens")

    def share(condition) -> Column:
        return F.count_if(condition & F.col("correct")) / F.count_if(condition)

    def variant(name: str) -> Column:
        return F.col("variant") == name

    rescue = F.count_if("correct") / n
    capability = log.groupBy("run_id").agg(
        rescue.alias("rescue_rate"),
        (F.avg("total_generated_tokens") / 100.0).alias("token_saving"),
        F.count_distinct("id").alias("examples"),
        rescue.alias("limit_rate"),
    )
    subproblem = log.groupBy("run_id").agg(
        (share(variant("self_asked_verification")) - share(variant("random_bit"))).alias("relevance_gain"),
        (rescue - share(variant("no_help"))).alias("rescue_advantage"),
        (F.count_if(k > 50) / n).alias("valid_rate"),
        rescue.alias("solve_accuracy"),
        F.count_distinct("id").alias("questions"),
        F.lit("").alias("warning"),
    )
    variants = (
        log.groupBy("run_id", "variant")
        .agg((F.count_if("correct") / n).alias("accuracy"))
        .join(log.groupBy("run_id").agg(F.count_distinct("id").alias("questions")), "run_id")
    )
    diagnostics = log.groupBy("run_id").agg(
        F.count_if(F.col("correct") & (k % 3 == 0)).alias("rescues"),
        F.count_if(F.col("correct") & (k % 3 == 1)).alias("harms"),
        F.count_if(k == 7).alias("fallback_questions"),
    )
    controlled = (
        log.groupBy("run_id")
        .agg(share(k % 2 == 0).alias("accuracy"))
        .withColumn("variant", F.lit("answer_verification_retry"))
    )
    judged = rep.assess_runs(capability, subproblem, variants, diagnostics, controlled)
    return judged.select(
        "run_id",
        "scheme1_status",
        "scheme2_status",
        "scaffold_gate",
        "cost_gate",
        "relevance_gate",
        "construction_gate",
        "self_check_gate",
        "feedback_gate",
        "information_gate",
        F.size("warnings").alias("warnings"),
    )
