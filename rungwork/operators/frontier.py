"""Per-item success/cost frontiers over hint kind and strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwork.functions.scoring import check_band, hint_utility

CHOICES = ("utility_choice", "threshold_choice", "band_choice")


def with_truncation_default(rollouts: DataFrame, max_new_tokens: int) -> DataFrame:
    """Fill a missing truncation flag from the output length."""
    reached = F.col("output_tokens") >= max_new_tokens
    if "hit_max_new_tokens" not in rollouts.columns:
        return rollouts.withColumn("hit_max_new_tokens", reached)
    return rollouts.withColumn("hit_max_new_tokens", F.coalesce("hit_max_new_tokens", reached))


def arm_catalog(rollouts: DataFrame) -> DataFrame:
    """Kind, strength and order last logged for each arm name (one row per arm)."""
    meta = F.struct("arm_kind", "arm_strength", "arm_order")
    return (
        rollouts.groupBy("arm_name")
        .agg(F.max_by(meta, "log_pos").alias("m"))
        .select("arm_name", "m.arm_kind", "m.arm_strength", "m.arm_order")
    )


def arm_totals(rollouts: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Integer totals per (item, arm); combines map-side, so a hot item is harmless.

    Pass :func:`arm_catalog` as ``catalog`` where roots number their arms differently
    and the last logged order must hold for all of them.
    """
    flag = F.coalesce(F.col("hit_max_new_tokens"), F.lit(False)).cast("long")
    carried = [F.max(c).alias(c) for c in ("question", "reference") if c in rollouts.columns]
    totals = rollouts.groupBy("id", "arm_name").agg(
        F.max("arm_kind").alias("arm_kind"),
        F.max("arm_strength").alias("arm_strength"),
        F.max("arm_order").alias("arm_order"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("correct").cast("long")).alias("hits"),
        F.sum("hint_tokens").alias("hint_sum"),
        F.sum("input_tokens").alias("input_sum"),
        F.sum("output_tokens").alias("output_sum"),
        F.sum(flag).alias("limit_sum"),
        *carried,
    )
    if catalog is None:
        return totals
    return totals.drop("arm_kind", "arm_strength", "arm_order").join(catalog, "arm_name")


def _pick(arms: Column, keys: list) -> Column:
    """Name of the arm with the smallest keys; the earlier arm wins a full tie."""
    ranked = F.transform(
        arms,
        lambda a: F.struct(
            *[k(a).alias(f"k{i}") for i, k in enumerate(keys)],
            a["arm_order"].alias("arm_order"),
            a["arm_name"].alias("arm_name"),
        ),
    )
    return F.array_min(ranked)["arm_name"]


def item_frontiers(
    rollouts: DataFrame,
    target_success: float = 0.5,
    band_low: float = 0.25,
    band_high: float = 0.75,
    lambda_cost: float = 0.02,
    mu_dependence: float = 0.05,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """One row per item: its arms in order and the three cheapest-sufficient choices.

    The second grouping collects at most one struct per arm name and item.
    """
    check_band(band_low, band_high)
    totals = arm_totals(rollouts, catalog)
    carried = [F.max(c).alias(c) for c in ("question", "reference") if c in totals.columns]
    raw = F.struct(
        F.col("arm_order"),
        F.col("arm_name"),
        F.col("arm_kind").alias("kind"),
        F.col("arm_strength").alias("strength"),
        (F.col("hits") / F.col("n")).alias("p"),
        (F.col("hits") > 0).alias("any_hit"),
        (F.col("hint_sum") / F.col("n")).alias("hint"),
        ((F.col("input_sum") + F.col("output_sum")) / F.col("n")).alias("total"),
    )
    items = (
        totals.groupBy("id")
        .agg(F.array_sort(F.collect_list(raw)).alias("raw"), *carried)
        .withColumn(
            "no_hint_p",
            F.coalesce(F.get(F.filter("raw", lambda a: a["arm_name"] == "none"), F.lit(0))["p"], F.lit(0.0)),
        )
    )
    arms = F.transform(
        "raw",
        lambda a: F.struct(
            a["arm_order"].alias("arm_order"),
            a["arm_name"].alias("arm_name"),
            a["kind"].alias("kind"),
            a["strength"].alias("strength"),
            a["p"].alias("p_correct"),
            a["any_hit"].alias("pass_at_k"),
            a["hint"].alias("hint_tokens"),
            a["total"].alias("total_tokens"),
            hint_utility(a["p"], a["hint"], F.col("no_hint_p"), lambda_cost, mu_dependence).alias("utility"),
        ),
    )
    items = items.withColumn("arms", arms).drop("raw")
    enough = F.filter("arms", lambda a: a["p_correct"] >= target_success)
    inside = F.filter("arms", lambda a: a["p_correct"].between(band_low, band_high))
    middle = (band_low + band_high) / 2.0
    cheapest = [lambda a: a["hint_tokens"]]
    return items.select(
        "id",
        *[c for c in ("question", "reference") if c in items.columns],
        "no_hint_p",
        _pick(F.col("arms"), [lambda a: -a["utility"], lambda a: a["hint_tokens"]]).alias("utility_choice"),
        F.coalesce(_pick(enough, cheapest), _pick(F.col("arms"), [lambda a: -a["p_correct"]])).alias(
            "threshold_choice"
        ),
        F.coalesce(
            _pick(inside, cheapest),
            _pick(
                F.col("arms"),
                [lambda a: F.abs(a["p_correct"] - middle), lambda a: a["hint_tokens"]],
            ),
        ).alias("band_choice"),
        "arms",
    )


def item_arm_stats(frontiers: DataFrame) -> DataFrame:
    """Frontiers back in long form: one row per item and arm."""
    return frontiers.select("id", "no_hint_p", F.inline("arms"))


def choice_histograms(frontiers: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("choice"), F.col(c).alias("arm_name")) for c in CHOICES])
    return (
        frontiers.select(F.inline(pairs))
        .groupBy("choice", "arm_name")
        .agg(F.count(F.lit(1)).alias("items"))
    )


def rescue_summary(frontiers: DataFrame) -> DataFrame:
    """Items that fail without a hint and succeed at least once with one."""
    helped = F.exists("arms", lambda a: (a["kind"] != "none") & (a["p_correct"] > 0))
    rescued = F.count_if((F.col("no_hint_p") == 0) & helped)
    items = F.count(F.lit(1))
    return frontiers.agg(
        items.alias("items"),
        rescued.alias("rescued_items"),
        F.when(items > 0, rescued / items).otherwise(F.lit(0.0)).alias("rescue_rate"),
    )


def arm_summary(rollouts: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Accuracy, pass@k, mean tokens and truncation per arm, from item totals."""
    n = F.sum("n")
    return (
        arm_totals(rollouts, catalog)
        .groupBy("arm_name")
        .agg(
            F.max("arm_kind").alias("arm_kind"),
            F.max("arm_strength").alias("arm_strength"),
            F.max("arm_order").alias("arm_order"),
            (F.sum("hits") / n).alias("rollout_accuracy"),
            (F.count_if(F.col("hits") > 0) / F.count(F.lit(1))).alias("pass_at_k"),
            (F.sum("hint_sum") / n).alias("average_hint_tokens"),
            (F.sum("input_sum") / n).alias("average_input_tokens"),
            (F.sum("output_sum") / n).alias("average_output_tokens"),
            (F.sum("limit_sum") / n).alias("generation_limit_rate"),
        )
    )


def _chosen_hint(choice_key: str) -> Column:
    hit = F.filter("arms", lambda a: a["arm_name"] == F.col(choice_key))
    return F.get(hit, F.lit(0))["hint_tokens"]


def frontier_pairs(weaker: DataFrame, stronger: DataFrame, choice_key: str = "threshold_choice") -> DataFrame:
    """Items measured at both capability levels with the chosen arm of each."""
    if choice_key not in CHOICES:
        raise ValueError(f"choice_key must be one of {CHOICES}")

    def side(frontier: DataFrame, name: str) -> DataFrame:
        return frontier.select(
            "id",
            F.col(choice_key).alias(f"{name}_arm"),
            _chosen_hint(choice_key).alias(f"{name}_hint"),
            F.col("no_hint_p").alias(f"{name}_no_hint"),
        )

    return side(weaker, "weak").join(side(stronger, "strong"), "id", "inner")


def frontier_shift(pairs: DataFrame) -> DataFrame:
    """One report row over :func:`frontier_pairs`; no common item is an error."""
    n = F.count(F.lit(1))
    weak, strong = F.col("weak_hint"), F.col("strong_hint")
    report = pairs.agg(
        n.alias("common_examples"),
        (F.count_if(F.col("weak_arm") != F.col("strong_arm")) / n).alias("choice_changed_fraction"),
        (F.count_if(strong < weak) / n).alias("fewer_hint_fraction"),
        (F.count_if(strong > weak) / n).alias("more_hint_fraction"),
        (F.count_if(strong == weak) / n).alias("equal_hint_fraction"),
        F.avg(weak).alias("weak_hint_tokens"),
        F.avg(strong).alias("strong_hint_tokens"),
        F.avg("weak_no_hint").alias("weak_no_hint_accuracy"),
        F.avg("strong_no_hint").alias("strong_no_hint_accuracy"),
    )
    empty = F.raise_error(F.lit("the two runs have no common items")).cast("bigint")
    return report.withColumn(
        "common_examples",
        F.when(F.col("common_examples") > 0, F.col("common_examples")).otherwise(empty),
    )


def frontier_transitions(pairs: DataFrame) -> DataFrame:
    """Counts of ``weak arm -> strong arm``; order by ``items`` descending to report."""
    return (
        pairs.groupBy(F.concat_ws(" -> ", "weak_arm", "strong_arm").alias("transition"))
        .agg(F.count(F.lit(1)).alias("items"))
    )
