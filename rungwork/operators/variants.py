"""Paired comparison of experimental conditions over the same trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwork.functions import text as tx
from rungwork.plans.ranking import seeded_hash

BASELINE = "no_help"


def outcomes(records: DataFrame) -> DataFrame:
    """(id, sample) -> map of variant to outcome; the last logged duplicate counts.

    Duplicates are combined before the shuffle and the map holds one entry per variant.
    """
    last = records.groupBy("id", "sample_index", "variant").agg(
        F.max_by("correct", "log_pos").alias("correct")
    )
    return last.groupBy("id", "sample_index").agg(
        F.map_from_entries(F.collect_list(F.struct("variant", "correct"))).alias("by_variant")
    )


def outcome(variant: str) -> Column:
    return F.try_element_at("by_variant", F.lit(variant))


def variant_summary(records: DataFrame) -> DataFrame:
    """Size, accuracy and mean token costs per variant."""
    spent = F.col("total_generated_tokens")
    if "output_tokens" in records.columns:
        spent = F.coalesce(spent, F.col("output_tokens"))
    n = F.count(F.lit(1))
    return records.groupBy("variant").agg(
        n.alias("trajectories"),
        (F.count_if("correct") / n).alias("accuracy"),
        (F.sum(F.coalesce("external_information_tokens", F.lit(0))) / n).alias(
            "avg_external_information_tokens"
        ),
        (F.sum(F.coalesce(spent, F.lit(0))) / n).alias("avg_total_generated_tokens"),
    )


def rescue_by_variant(records: DataFrame) -> DataFrame:
    """Success share per variant on the trajectories its baseline failed.

    Trajectories without a baseline do not count; a variant never seen next to a
    failed baseline rates zero.
    """
    pairs = outcomes(records).select(
        outcome(BASELINE).alias("base"), F.explode("by_variant").alias("variant", "correct")
    )
    eligible = F.coalesce(~F.col("base"), F.lit(False))
    return (
        pairs.filter(F.col("variant") != BASELINE)
        .groupBy("variant")
        .agg(
            F.count_if(eligible).alias("eligible"),
            F.count_if(eligible & F.col("correct")).alias("rescued"),
        )
        .withColumn(
            "rescue_rate",
            F.when(F.col("eligible") > 0, F.col("rescued") / F.col("eligible")).otherwise(F.lit(0.0)),
        )
    )


def paired_outcomes(records: DataFrame, treatment: str = "self_asked_verification") -> DataFrame:
    """2x2 table of baseline against one treatment where both were measured."""
    base, other = outcome(BASELINE), outcome(treatment)
    both = outcomes(records).select(base.alias("b"), other.alias("t")).filter("b is not null and t is not null")
    b, t = F.col("b"), F.col("t")
    return both.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(b & t).alias("both_correct"),
        F.count_if(~b & ~t).alias("both_wrong"),
        F.count_if(~b & t).alias("rescues"),
        F.count_if(b & ~t).alias("harms"),
    )


def action_summary(records: DataFrame) -> DataFrame:
    """Accuracy, hint cost, invalid share, rescue share and harm count per variant."""
    n = F.count(F.lit(1))
    per_variant = records.groupBy("variant").agg(
        n.alias("trajectories"),
        (F.count_if("correct") / n).alias("accuracy"),
        (F.sum("hint_tokens") / n).alias("average_hint_tokens"),
        (F.count_if("invalid_action") / n).alias("invalid_action_rate"),
    )
    pairs = outcomes(records).select(
        outcome(BASELINE).alias("base"), F.explode("by_variant").alias("v", "now")
    )
    effects = (
        pairs.filter((F.col("v") != BASELINE) & F.col("base").isNotNull())
        .groupBy("v")
        .agg(
            F.count_if(~F.col("base")).alias("eligible"),
            F.count_if(~F.col("base") & F.col("now")).alias("rescued"),
            F.count_if(F.col("base") & ~F.col("now")).alias("harms"),
        )
    )
    joined = per_variant.join(effects, F.col("variant") == F.col("v"), "left")
    rate = F.when(F.col("eligible") > 0, F.col("rescued") / F.col("eligible")).otherwise(F.lit(0.0))
    treated = F.col("variant") != BASELINE
    return joined.select(
        "variant",
        "trajectories",
        "accuracy",
        "average_hint_tokens",
        "invalid_action_rate",
        F.when(treated, rate).alias("rescue_rate"),
        F.when(treated, F.coalesce("harms", F.lit(0))).alias("harms"),
    )


def action_histogram(records: DataFrame) -> DataFrame:
    return records.groupBy("variant", "action").agg(F.count(F.lit(1)).alias("rollouts"))


def _asked(records: DataFrame, variant: str) -> DataFrame:
    return records.filter(F.col("variant") == variant).withColumn(
        "oracle_answer", F.coalesce("oracle_answer", F.lit("MISSING"))
    )


def self_check_summary(records: DataFrame, variant: str = "self_asked_verification") -> DataFrame:
    """How often the self-check fell back, stayed empty, and how long its questions are."""
    n = F.count(F.lit(1))
    question = F.coalesce("verification_question", F.lit(""))
    mean_words = F.sum(F.size(tx.words(question))) / n
    return _asked(records, variant).agg(
        n.alias("trajectories"),
        F.count_if(F.col("verification_question") == tx.DEFAULT_VERIFICATION).alias("fallback_questions"),
        F.count_if(~tx.has_text("tentative_state")).alias("empty_states"),
        F.when(n > 0, mean_words).otherwise(F.lit(0.0)).alias("average_question_words"),
    )


def self_check_answers(records: DataFrame, variant: str = "self_asked_verification") -> DataFrame:
    """Histogram and accuracy per oracle answer."""
    n = F.count(F.lit(1))
    return (
        _asked(records, variant)
        .groupBy("oracle_answer")
        .agg(n.alias("trajectories"), (F.count_if("correct") / n).alias("accuracy"))
    )


def self_check_examples(records: DataFrame, count: int = 8, variant: str = "self_asked_verification") -> DataFrame:
    """First examples in log order (a top-k report)."""
    return (
        records.filter(F.col("variant") == variant)
        .orderBy("log_pos")
        .limit(count)
        .select("oracle_answer", "correct", "verification_question", "log_pos")
    )


# --- fixed values: variant names of the relevance comparison -------------------------
QUESTION_ONLY, RELEVANT, RANDOM = "question_only", "relevant_subproblem", "random_subproblem"
# -------------------------------------------------------------------------------------


def relevance_summary(records: DataFrame) -> DataFrame:
    """Gains and rescue advantage of relevant help over its matched controls.

    Here a trajectory without a baseline counts as a failed baseline.
    """
    accuracy = records.agg(
        *[
            F.coalesce(
                F.count_if((F.col("variant") == v) & F.col("correct"))
                / F.nullif(F.count_if(F.col("variant") == v), F.lit(0)),
                F.lit(0.0),
            ).alias(name)
            for v, name in (
                (BASELINE, "a_none"),
                (QUESTION_ONLY, "a_question"),
                (RELEVANT, "a_relevant"),
                (RANDOM, "a_random"),
            )
        ]
    ).select(F.struct("*").alias("acc"))
    failed = ~F.coalesce(outcome(BASELINE), F.lit(False))

    def rescue(variant: str) -> Column:
        seen = F.count_if(failed & outcome(variant).isNotNull())
        return F.coalesce(
            F.count_if(failed & F.coalesce(outcome(variant), F.lit(False))) / F.nullif(seen, F.lit(0)),
            F.lit(0.0),
        )

    rescues = outcomes(records).agg(rescue(RELEVANT).alias("r"), rescue(RANDOM).alias("c"))
    both = rescues.withColumn("acc", accuracy.scalar())
    return both.select(
        (F.col("acc.a_relevant") - F.col("acc.a_none")).alias("relevant_gain_over_no_help"),
        (F.col("acc.a_relevant") - F.col("acc.a_random")).alias("relevant_gain_over_random"),
        (F.col("acc.a_relevant") - F.col("acc.a_question")).alias("answer_value_beyond_question_only"),
        F.col("r").alias("relevant_rescue_rate"),
        F.col("c").alias("random_rescue_rate"),
        (F.col("r") - F.col("c")).alias("rescue_advantage_over_random"),
    )


def retry_rows(records: DataFrame, retries: DataFrame, variant: str = "answer_verification_retry") -> DataFrame:
    """One retry row per baseline row, its cost the first try, one bit and the retry.

    ``retries``: graded second attempts keyed by ``(id, sample_index)``.
    """
    base = records.filter(F.col("variant") == BASELINE)
    second = retries.select(
        "id",
        "sample_index",
        F.col("correct").alias("__correct"),
        F.col("output_tokens").alias("__tokens"),
    )
    return base.join(second, ["id", "sample_index"], "inner").select(
        "id",
        "sample_index",
        F.lit(variant).alias("variant"),
        F.col("__correct").alias("correct"),
        F.when(F.col("correct"), "YES").otherwise("NO").alias("oracle_answer"),
        F.lit(1).cast("bigint").alias("external_information_tokens"),
        (F.col("output_tokens") + 1 + F.col("__tokens")).alias("total_generated_tokens"),
        F.col("correct").alias("previous_correct"),
        "log_pos",
    )


def merge_retries(records: DataFrame, retry: DataFrame) -> DataFrame:
    return records.unionByName(retry, allowMissingColumns=True)


def stage_costs(solves: DataFrame, queries: DataFrame, oracles: DataFrame) -> DataFrame:
    """Solve rows carrying the tokens of the query and oracle stages before them."""
    keys = ["id", "sample_index"]
    asked = queries.select(*keys, "verification_question", "tentative_state", F.col("output_tokens").alias("query_output_tokens"))
    told = oracles.select(*keys, "oracle_answer", F.col("output_tokens").alias("oracle_output_tokens"))
    spent = F.col("output_tokens") + F.col("query_output_tokens") + F.col("oracle_output_tokens")
    return solves.join(asked, keys).join(told, keys).withColumn("total_generated_tokens", spent)


def random_choice(labels: tuple[str, ...], seed: int, *keys: Column) -> Column:
    """Seeded uniform label per key."""
    bucket = F.conv(F.substring(seeded_hash(seed, *keys), 1, 8), 16, 10).cast("bigint") % len(labels)
    return F.get(F.array(*[F.lit(x) for x in labels]), bucket.cast("int"))


def assign_conditions(jobs: DataFrame, seed: int, selector_text: str | None = None) -> DataFrame:
    """Random bit and action per job; with a selector output also its parsed action."""
    keys = (F.col("id"), F.col("sample_index"))
    out = jobs.withColumn("random_bit", random_choice(("YES", "NO"), seed, F.lit("bit"), *keys)).withColumn(
        "random_action", random_choice(tx.ACTIONS, seed, F.lit("action"), *keys)
    )
    if selector_text is None:
        return out
    parsed = tx.help_action(selector_text)
    return out.withColumn("policy_action", F.coalesce(parsed, F.lit("NONE"))).withColumn(
        "invalid_action", parsed.isNull()
    )
