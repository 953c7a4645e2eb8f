"""Curriculum decisions from measured success, and the rollouts they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwork.functions import scoring as sc
from rungwork.functions import text as tx
from rungwork.functions.scoring import CurriculumRules

# --- fixed values: phases with the reason logged for each ----------------------------
REASONS = {
    "graduated": "Repeated unguided evaluation exceeds the graduation threshold.",
    "unguided_root": "The original problem already produces informative mixed rewards.",
    "unguided_probe": "The root is above the learning band but has not passed repeated graduation checks.",
    "guided_root": "Prerequisites are ready and the selected scaffold restores a trainable root group.",
    "subproblem_curriculum": "Trainable prerequisite subproblems exist while the root remains below the band.",
    "decompose_or_defer": "Neither the root, an available scaffold, nor a subproblem is currently trainable.",
}
# -------------------------------------------------------------------------------------

SUBPROBLEM_STATES = "array<struct<id:string,success:double>>"


def root_states(rollouts: DataFrame, on_missing: str = "error") -> DataFrame:
    """Roots (grouped by question text) with the measured success of each hint arm.

    Rewards are kept as counts, not as lists, so one much-sampled root stays small.
    A root without unhinted rollouts is an error, or left out with ``on_missing="skip"``.
    """
    if on_missing not in ("error", "skip"):
        raise ValueError("on_missing must be 'error' or 'skip'")
    per_arm = rollouts.groupBy("question", "arm_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("correct").cast("bigint")).alias("hits"),
        F.sum("hint_tokens").alias("hint_sum"),
        F.min_by(F.struct("arm_strength", "arm_kind"), "log_pos").alias("meta"),
        F.min_by(F.struct("id", "reference"), "log_pos").alias("origin"),
        F.min("log_pos").alias("log_pos"),
    )
    is_base = F.col("arm_name") == "none"
    hint = F.struct(
        F.col("arm_name").alias("name"),
        F.rint(F.col("hint_sum") / F.col("n")).cast("bigint").alias("hint_tokens"),
        F.col("meta.arm_strength").alias("strength"),
        F.col("meta.arm_kind").alias("kind"),
        F.col("n").alias("samples"),
        (F.col("hits") / F.col("n")).alias("success"),
    )
    roots = per_arm.groupBy("question").agg(
        F.min_by("origin", "log_pos").alias("origin"),
        F.max(F.when(is_base, F.col("n"))).alias("root_samples"),
        F.max(F.when(is_base, F.col("hits") / F.col("n"))).alias("root_success"),
        F.array_sort(F.collect_list(F.when(~is_base, hint))).alias("scaffolds"),
    )
    states = roots.select(
        F.col("origin.id").alias("id"),
        "question",
        F.col("origin.reference").alias("answer"),
        "root_samples",
        "root_success",
        F.array().cast(SUBPROBLEM_STATES).alias("subproblems"),
        "scaffolds",
        F.lit(0).alias("consecutive_unguided_mastery"),
    )
    if on_missing == "skip":
        return states.filter(F.col("root_success").isNotNull())
    missing = F.raise_error(F.concat(F.lit("root without unhinted rollouts: "), F.col("question")))
    return states.withColumn("root_success", F.coalesce("root_success", missing.cast("double")))


def states_from_rewards(states: DataFrame) -> DataFrame:
    """Root states given as reward lists, reduced to success shares."""
    return states.select(
        "id",
        "question",
        "answer",
        F.size("root_rewards").cast("bigint").alias("root_samples"),
        sc.empirical_success("root_rewards").alias("root_success"),
        F.transform(
            F.coalesce("subproblems", F.array()),
            lambda s: F.struct(s["id"].alias("id"), sc.empirical_success(s["rewards"]).alias("success")),
        ).alias("subproblems"),
        F.transform(
            F.coalesce("scaffolds", F.array()),
            lambda s: F.struct(
                s["name"].alias("name"),
                F.coalesce(s["hint_tokens"], F.lit(0)).cast("bigint").alias("hint_tokens"),
                F.coalesce(s["strength"], F.lit(0.0)).alias("strength"),
                F.coalesce(s["kind"], F.lit("none")).alias("kind"),
                F.size(s["rewards"]).cast("bigint").alias("samples"),
                sc.empirical_success(s["rewards"]).alias("success"),
            ),
        ).alias("scaffolds"),
        F.coalesce("consecutive_unguided_mastery", F.lit(0)).alias("consecutive_unguided_mastery"),
    )


def select_scaffold(scaffolds: Column | str, rules: CurriculumRules) -> Column:
    """Cheapest in-band hint, else cheapest above the floor, else the most successful."""
    usable = F.filter(
        tx.col(scaffolds),
        lambda s: (s["kind"] != "none") & (s["hint_tokens"] <= rules.max_hint_tokens),
    )

    def smallest(rows: Column, *keys) -> Column:
        ordered = F.transform(
            rows, lambda s: F.struct(*[k(s).alias(f"k{i}") for i, k in enumerate(keys)], s.alias("s"))
        )
        return F.array_min(ordered)["s"]

    inside = F.filter(usable, lambda s: sc.in_band(s["success"], rules.band_low, rules.band_high))
    above = F.filter(usable, lambda s: s["success"] >= rules.band_low)
    best = F.array_max(
        F.transform(
            usable,
            lambda s: F.struct(
                s["success"].alias("k0"),
                (-s["hint_tokens"]).alias("k1"),
                (-s["strength"]).alias("k2"),
                s["name"].alias("k3"),
                s.alias("s"),
            ),
        )
    )["s"]
    return F.coalesce(
        smallest(
            inside,
            lambda s: s["hint_tokens"],
            lambda s: s["strength"],
            lambda s: -sc.informative(s["success"], rules.group_size),
            lambda s: s["name"],
        ),
        smallest(
            above,
            lambda s: s["hint_tokens"],
            lambda s: s["strength"],
            lambda s: s["success"],
            lambda s: s["name"],
        ),
        best,
    )


def decide_curriculum(states: DataFrame, rules: CurriculumRules = CurriculumRules()) -> DataFrame:
    """One decision per root state; row-local, so it needs no shuffle at all."""
    p = F.col("root_success")
    subs = F.col("subproblems")
    base = states.withColumn("pick", select_scaffold("scaffolds", rules)).withColumn(
        "mastery",
        F.when(
            F.size(subs) > 0,
            F.size(F.filter(subs, lambda s: s["success"] >= rules.mastery_threshold)) / F.size(subs),
        ).otherwise(F.lit(0.0)),
    )
    active = F.transform(
        F.filter(subs, lambda s: sc.in_band(s["success"], rules.band_low, rules.band_high)),
        lambda s: s["id"],
    )
    stuck = F.transform(F.filter(subs, lambda s: s["success"] < rules.band_low), lambda s: s["id"])
    trainable = F.coalesce(F.col("pick.success") >= rules.band_low, F.lit(False))
    ready = (F.col("mastery") >= rules.prerequisite_coverage) | (F.size(subs) == 0)
    phase = (
        F.when(
            (p >= rules.graduation_threshold)
            & (F.col("consecutive_unguided_mastery") >= rules.graduation_patience),
            "graduated",
        )
        .when(sc.in_band(p, rules.band_low, rules.band_high), "unguided_root")
        .when(p > rules.band_high, "unguided_probe")
        .when(trainable & ready, "guided_root")
        .when(F.size(active) > 0, "subproblem_curriculum")
        .otherwise("decompose_or_defer")
    )
    below = ~F.col("phase").isin("graduated", "unguided_root", "unguided_probe")
    none = F.array().cast("array<string>")
    reasons = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return base.withColumn("phase", phase).select(
        F.col("id").alias("root_id"),
        tx.question_key("question").alias("question_key"),
        "phase",
        F.element_at(reasons, F.col("phase")).alias("reason"),
        "root_success",
        sc.informative(p, rules.group_size).alias("informative_probability"),
        F.when(below, F.col("pick.name")).alias("selected_scaffold"),
        F.when(below, F.col("pick.success")).alias("selected_scaffold_success"),
        F.when(F.col("phase").isin("guided_root", "subproblem_curriculum"), active)
        .otherwise(none)
        .alias("active_subproblem_ids"),
        F.when(below, stuck).otherwise(none).alias("unresolved_subproblem_ids"),
        F.when(below, F.col("mastery")).otherwise(F.lit(1.0)).alias("prerequisite_mastery"),
        F.when(
            F.col("phase") == "guided_root",
            sc.informative(F.col("pick.success"), rules.group_size),
        ).alias("scaffold_informative_probability"),
    )


def phase_histogram(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("phase").agg(F.count(F.lit(1)).alias("roots"))


def manifest_summary(decisions: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return decisions.agg(
        n.alias("num_roots"),
        F.when(n > 0, F.sum("root_success") / n).otherwise(F.lit(0.0)).alias("mean_root_success"),
    )


def fade_schedule(steps: DataFrame, fade_start: int, fade_end: int, rollouts: int) -> DataFrame:
    """Visible share and guided rollouts for each row of ``step``."""
    shown = sc.visible_fraction(F.col("step"), fade_start, fade_end)
    return steps.select(
        "*",
        shown.alias("visible_fraction"),
        sc.guided_count(rollouts, shown).alias("guided_rollouts"),
    )


def regeneration_requests(
    problems: DataFrame, manifest: DataFrame, step: int, fade_start: int, fade_end: int
) -> DataFrame:
    """Problems joined to their decision, with the hint still visible at ``step``.

    ``manifest`` holds one row per ``question_key`` (see ``load_manifest``). The join
    side is left to Spark's size estimate: a small manifest is broadcast, a large one
    is shuffled.
    """
    decisions = manifest.select(
        F.col("question_key").alias("__key"),
        F.coalesce("phase", F.lit("decompose_or_defer")).alias("__phase"),
        F.nullif("selected_scaffold", F.lit("")).alias("__scaffold"),
    )
    keyed = problems.withColumn("question_key", tx.question_key("question"))
    joined = keyed.join(decisions, F.col("question_key") == F.col("__key"), "left")
    name = F.when(F.col("__phase") == "guided_root", F.col("__scaffold"))
    named = (
        joined.withColumn("phase", F.coalesce("__phase", F.lit("unguided_root")))
        .withColumn("scaffold_name", name)
        .withColumn("scaffold_kind", F.when(name.isNotNull(), tx.scaffold_kind(name)))
        .withColumn("scaffold_strength", tx.scaffold_strength(F.col("scaffold_name")))
        .withColumn(
            "visible_fraction",
            F.when(F.col("scaffold_name").isNotNull(), sc.visible_fraction(step, fade_start, fade_end)),
        )
    )
    by_kind = F.lit(None).cast("array<string>")
    for kind, column in tx.HINT_COLUMNS.items():
        by_kind = F.when(F.col("scaffold_kind") == kind, tx.clean_parts(column)).otherwise(by_kind)
    parts = F.coalesce(by_kind, F.array().cast("array<string>"))
    kept = F.slice(parts, F.lit(1), sc.shown_count(F.size(parts), F.col("scaffold_strength")))
    none = F.array().cast("array<string>")
    return named.withColumn(
        "hint_parts",
        F.when(F.col("scaffold_name").isNull(), none).otherwise(sc.fade_parts(kept, F.col("visible_fraction"))),
    ).drop("__key", "__phase", "__scaffold")


def curriculum_rollouts(requests: DataFrame, rollouts: int) -> DataFrame:
    """Each request ``rollouts`` times: guided rows first, the rest without a hint."""
    guided = F.when(
        F.col("scaffold_name").isNotNull() & (F.size("hint_parts") > 0),
        sc.guided_count(rollouts, F.coalesce("visible_fraction", F.lit(0.0))),
    ).otherwise(F.lit(0))
    rows = requests.withColumn("__guided", guided).withColumn(
        "rollout_index", F.explode(F.sequence(F.lit(0), F.lit(rollouts - 1)))
    )
    on = F.col("rollout_index") < F.col("__guided")
    return (
        rows.withColumn("hint_level", F.when(on, tx.hint_level("scaffold_kind")).otherwise(F.lit(0)))
        .withColumn("curriculum_phase", F.when(on, F.col("phase")).otherwise(F.lit("unguided_dropout")))
        .withColumn("hint_parts", F.when(on, F.col("hint_parts")).otherwise(F.array().cast("array<string>")))
        .withColumn("visible_fraction", F.when(on, F.col("visible_fraction")).otherwise(F.lit(0.0)))
        .withColumn("scaffold_name", F.when(on, F.col("scaffold_name")))
        .withColumn("scaffold_kind", F.when(on, F.col("scaffold_kind")))
        .drop("__guided")
    )
