"""Condition comparisons over the event-derived variant log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.functions import text as tx
from rungwork.operators import variants as va
from rungwork.plans import oracle_views as ov
from rungwork.plans.queries_frontier import rounded
from rungwork.plans.registry import query
from rungwork.sources import bridge

LAST = (
    "WITH "
    + ov.VARIANTS
    + """,
last AS (
  SELECT id, sample_index, variant, arg_max(correct, log_pos) AS correct
  FROM variants GROUP BY id, sample_index, variant
),
pairs AS (
  SELECT l.*, b.correct AS base
  FROM last l LEFT JOIN (SELECT * FROM last WHERE variant = 'no_help') b
       ON l.id = b.id AND l.sample_index = b.sample_index
)
"""
)


@query("F18", "WITH " + ov.VARIANTS + """
SELECT variant, count(*) AS trajectories, round(sum(CASE WHEN correct THEN 1 ELSE 0 END) / count(*), 9) AS accuracy,
       round(sum(external_information_tokens) / count(*), 9) AS avg_external_information_tokens,
       round(sum(total_generated_tokens) / count(*), 9) AS avg_total_generated_tokens
FROM variants GROUP BY variant""")
def variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(va.variant_summary(bridge.variant_rollouts(spark, sf_dir)))


@query("F19, E9", LAST + """
SELECT variant, CAST(coalesce(sum(CASE WHEN NOT base THEN 1 ELSE 0 END), 0) AS BIGINT) AS eligible,
       CAST(coalesce(sum(CASE WHEN NOT base AND correct THEN 1 ELSE 0 END), 0) AS BIGINT) AS rescued,
       round(coalesce(sum(CASE WHEN NOT base AND correct THEN 1 ELSE 0 END)
             / nullif(sum(CASE WHEN NOT base THEN 1 ELSE 0 END), 0), 0.0), 9) AS rescue_rate
FROM pairs WHERE variant <> 'no_help' GROUP BY variant""")
def rescue_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(va.rescue_by_variant(bridge.variant_rollouts(spark, sf_dir)))


@query("F21, E9", LAST + """
SELECT count(*) AS pairs, count(*) FILTER (base AND correct) AS both_correct,
       count(*) FILTER (NOT base AND NOT correct) AS both_wrong, count(*) FILTER (NOT base AND correct) AS rescues,
       count(*) FILTER (base AND NOT correct) AS harms
FROM pairs WHERE variant = 'self_asked_verification' AND base IS NOT NULL""")
def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.paired_outcomes(bridge.variant_rollouts(spark, sf_dir))


ACTIONS = "CASE props_tokens % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'KNOWLEDGE' WHEN 2 THEN 'PLANNING' WHEN 3 THEN 'STEP' END"


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = bridge.variant_rollouts(spark, sf_dir)
    action = F.get(F.array(*[F.lit(a) for a in tx.ACTIONS]), (F.col("props_tokens") % 5).cast("int"))
    return log.withColumns(
        {
            "action": F.coalesce(action, F.lit("NONE")),
            "invalid_action": action.isNull(),
            "hint_tokens": F.col("external_information_tokens"),
        }
    )


@query("F20", LAST + f"""
, per_variant AS (
  SELECT variant, count(*) AS trajectories, sum(CASE WHEN correct THEN 1 ELSE 0 END) / count(*) AS accuracy,
         sum(external_information_tokens) / count(*) AS average_hint_tokens,
         sum(CASE WHEN {ACTIONS} IS NULL THEN 1 ELSE 0 END) / count(*) AS invalid_action_rate
  FROM variants GROUP BY variant
), effects AS (
  SELECT variant, count(*) FILTER (NOT base) AS eligible, count(*) FILTER (NOT base AND correct) AS rescued,
         count(*) FILTER (base AND NOT correct) AS harms
  FROM pairs WHERE base IS NOT NULL GROUP BY variant
)
SELECT p.variant, trajectories, round(accuracy, 9) AS accuracy, round(average_hint_tokens, 9) AS average_hint_tokens,
       round(invalid_action_rate, 9) AS invalid_action_rate,
       CASE WHEN p.variant <> 'no_help' THEN round(coalesce(rescued / nullif(eligible, 0), 0.0), 9) END AS rescue_rate,
       CASE WHEN p.variant <> 'no_help' THEN coalesce(harms, 0) END AS harms
FROM per_variant p LEFT JOIN effects e ON p.variant = e.variant""")
def action_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(va.action_summary(_actions(spark, sf_dir)))


@query("F20", "WITH " + ov.VARIANTS + f"""
SELECT variant, coalesce({ACTIONS}, 'NONE') AS action, count(*) AS rollouts FROM variants GROUP BY 1, 2""")
def action_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.action_histogram(_actions(spark, sf_dir))


CHECKS = "WITH " + ov.VARIANTS + f""",
asked AS (
  SELECT *, CASE WHEN props_tokens % 4 = 0 THEN '{tx.DEFAULT_VERIFICATION}' ELSE concat('Is step ', props_tokens, ' valid?') END AS vq,
         CASE WHEN props_tokens % 3 = 0 THEN ' ' ELSE 'plan' END AS ts,
         CASE props_tokens % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' WHEN 2 THEN 'UNKNOWN' ELSE 'MISSING' END AS oracle_answer
  FROM variants WHERE variant = 'self_asked_verification'
)
"""


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("props_tokens")
    return bridge.variant_rollouts(spark, sf_dir).withColumns(
        {
            "verification_question": F.when(k % 4 == 0, F.lit(tx.DEFAULT_VERIFICATION)).otherwise(
                F.concat(F.lit("Is step "), k.cast("string"), F.lit(" valid?"))
            ),
            "tentative_state": F.when(k % 3 == 0, F.lit(" ")).otherwise(F.lit("plan")),
            "oracle_answer": F.get(F.array(F.lit("YES"), F.lit("NO"), F.lit("UNKNOWN")), (k % 4).cast("int")),
        }
    )


@query("F21", CHECKS + f"""
SELECT count(*) AS trajectories, count(*) FILTER (vq = '{tx.DEFAULT_VERIFICATION}') AS fallback_questions,
       count(*) FILTER (trim(ts) = '') AS empty_states,
       round(sum(len(string_split(vq, ' '))) / count(*), 9) AS average_question_words
FROM asked""")
def self_check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(va.self_check_summary(_checks(spark, sf_dir)))


@query("F21", CHECKS + """
SELECT oracle_answer, count(*) AS trajectories, round(sum(CASE WHEN correct THEN 1 ELSE 0 END) / count(*), 9) AS accuracy
FROM asked GROUP BY oracle_answer""")
def self_check_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(va.self_check_answers(_checks(spark, sf_dir)))


@query("F21, H9", CHECKS + """
SELECT nullif(oracle_answer, 'MISSING') AS oracle_answer, correct, vq AS verification_question, log_pos
FROM asked ORDER BY log_pos LIMIT 8""")
def self_check_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.self_check_examples(_checks(spark, sf_dir))


# the event log read as the relevance comparison: event type -> condition
RELEVANCE = {
    "no_help": "no_help",
    "random_bit": "random_subproblem",
    "self_asked_verification": "relevant_subproblem",
    "knowledge_min": "question_only",
}


@query("F22, E9", LAST + """
, acc AS (
  SELECT sum(CASE WHEN variant = 'no_help' AND correct THEN 1 ELSE 0 END) / count(*) FILTER (variant = 'no_help') AS n,
         sum(CASE WHEN variant = 'knowledge_min' AND correct THEN 1 ELSE 0 END) / count(*) FILTER (variant = 'knowledge_min') AS q,
         sum(CASE WHEN variant = 'self_asked_verification' AND correct THEN 1 ELSE 0 END)
           / count(*) FILTER (variant = 'self_asked_verification') AS r,
         sum(CASE WHEN variant = 'random_bit' AND correct THEN 1 ELSE 0 END) / count(*) FILTER (variant = 'random_bit') AS c
  FROM variants
), rescue AS (
  SELECT count(*) FILTER (variant = 'self_asked_verification' AND correct) / count(*) FILTER (variant = 'self_asked_verification') AS r,
         count(*) FILTER (variant = 'random_bit' AND correct) / count(*) FILTER (variant = 'random_bit') AS c
  FROM pairs WHERE NOT coalesce(base, false)
)
SELECT round(acc.r - acc.n, 9) AS relevant_gain_over_no_help, round(acc.r - acc.c, 9) AS relevant_gain_over_random,
       round(acc.r - acc.q, 9) AS answer_value_beyond_question_only, round(rescue.r, 9) AS relevant_rescue_rate,
       round(rescue.c, 9) AS random_rescue_rate, round(rescue.r - rescue.c, 9) AS rescue_advantage_over_random
FROM acc CROSS JOIN rescue""")
def relevance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in RELEVANCE.items() for x in pair])
    log = bridge.variant_rollouts(spark, sf_dir)
    renamed = log.withColumn("variant", F.coalesce(F.try_element_at(names, F.col("variant")), F.col("variant")))
    return rounded(va.relevance_summary(renamed))


BUCKET = "('0x' || substr({h}, 1, 8))::BIGINT"
KEYS = ("id", "CAST(sample_index AS VARCHAR)")
BIT, ACTION = (BUCKET.format(h=ov.seeded(42, f"'{purpose}'", *KEYS)) for purpose in ("bit", "action"))
DRAWN = ov.VARIANTS + f""",
drawn AS (
  SELECT id, sample_index, CASE {BIT} % 2 WHEN 0 THEN 'YES' ELSE 'NO' END AS random_bit,
         CASE {ACTION} % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'KNOWLEDGE' WHEN 2 THEN 'PLANNING' ELSE 'STEP' END AS random_action
  FROM (SELECT DISTINCT id, sample_index FROM variants) j
)"""


@query("D7", "WITH " + DRAWN + "SELECT random_bit, random_action, count(*) AS jobs FROM drawn GROUP BY ALL")
def random_condition_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight pairs of bit and action occur: the two draws are independent."""
    jobs = bridge.variant_rollouts(spark, sf_dir).select("id", "sample_index").distinct()
    return va.assign_conditions(jobs, seed=42).groupBy("random_bit", "random_action").agg(F.count(F.lit(1)).alias("jobs"))


@query("D7, B23", "WITH " + ov.CONVERSATION_ACTIONS + """
SELECT conv_id AS id, turn AS sample_index, coalesce(action, 'NONE') AS policy_action, action IS NULL AS invalid_action FROM actions""")
def policy_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selector outputs = conversation turns; what names no action is invalid and falls back to none."""
    jobs = bridge.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"), F.col("turn").alias("sample_index"), bridge.as_selector_output("turn", "text").alias("said")
    )
    return va.assign_conditions(jobs, seed=42, selector_text="said").select("id", "sample_index", "policy_action", "invalid_action")


@query("D7, B23", "WITH " + DRAWN + "SELECT * FROM drawn")
def random_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = bridge.variant_rollouts(spark, sf_dir).select("id", "sample_index").distinct()
    return va.assign_conditions(jobs, seed=42)


STAGE = """
stages AS (
  SELECT id, sample_index, variant, max(total_generated_tokens) AS tokens, max(props_tokens) AS k
  FROM variants GROUP BY id, sample_index, variant
)"""


def _stage(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    return (
        bridge.variant_rollouts(spark, sf_dir)
        .filter(F.col("variant") == variant)
        .groupBy("id", "sample_index")
        .agg(F.max("total_generated_tokens").alias("output_tokens"), F.max("props_tokens").alias("k"))
    )


@query("D8", "WITH " + ov.VARIANTS + "," + STAGE + """
SELECT s.id, s.sample_index, q.tokens AS query_output_tokens, o.tokens AS oracle_output_tokens,
       s.tokens + q.tokens + o.tokens AS total_generated_tokens
FROM stages s JOIN stages q ON s.id = q.id AND s.sample_index = q.sample_index
     JOIN stages o ON s.id = o.id AND s.sample_index = o.sample_index
WHERE s.variant = 'self_asked_verification' AND q.variant = 'random_bit' AND o.variant = 'knowledge_min'""")
def stage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    solves = _stage(spark, sf_dir, "self_asked_verification")
    asked = _stage(spark, sf_dir, "random_bit").withColumns(
        {"verification_question": F.lit(tx.DEFAULT_VERIFICATION), "tentative_state": F.lit("")}
    )
    told = _stage(spark, sf_dir, "knowledge_min").withColumn("oracle_answer", F.lit("YES"))
    costs = va.stage_costs(solves, asked, told)
    return costs.select(
        "id", "sample_index", "query_output_tokens", "oracle_output_tokens", "total_generated_tokens"
    )


@query("D6, H12", "WITH " + ov.VARIANTS + "," + STAGE + """,
merged AS (
  SELECT variant, correct, total_generated_tokens AS tokens FROM variants
  UNION ALL
  SELECT 'answer_verification_retry', s.k % 2 = 0, v.total_generated_tokens + 1 + s.tokens
  FROM variants v JOIN stages s ON v.id = s.id AND v.sample_index = s.sample_index AND s.variant = 'planning_min'
  WHERE v.variant = 'no_help'
)
SELECT variant, count(*) AS trajectories, round(sum(CASE WHEN correct THEN 1 ELSE 0 END) / count(*), 9) AS accuracy,
       round(sum(tokens) / count(*), 9) AS avg_total_generated_tokens
FROM merged GROUP BY variant""")
def retry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = bridge.variant_rollouts(spark, sf_dir).withColumn("output_tokens", F.col("total_generated_tokens"))
    second = _stage(spark, sf_dir, "planning_min").withColumn("correct", F.col("k") % 2 == 0)
    merged = va.merge_retries(log, va.retry_rows(log, second))
    return rounded(va.variant_summary(merged).drop("avg_external_information_tokens"))
