"""Calibrating candidates: measured success, causal choice, and what to sample next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwork.functions import text as tx
from rungwork.functions.scoring import check_band, in_band, informative
from rungwork.plans.ranking import hash_rank, last_by

NO_HELP, RELEVANT, RANDOM = "no_help", "relevant_plan", "random_plan"


def dimension_rank(column: str = "dimension") -> Column:
    """Position among the known dimensions; unknown ones come last."""
    at = F.array_position(F.array(*[F.lit(d) for d in tx.DIMENSIONS]), F.col(column))
    return F.when(at > 0, at - 1).otherwise(F.lit(len(tx.DIMENSIONS))).cast("int")


def complete_roots(candidates: DataFrame, root_limit: int = 0, seed: int = 42) -> DataFrame:
    """Candidates of roots that have every dimension, in seeded root order.

    ``root_rank`` and ``dimension_rank`` give the output order; a limit keeps the first
    roots of that order.
    """
    known = candidates.filter(
        (F.coalesce("root_id", F.lit("")) != "") & F.col("dimension").isin(*tx.DIMENSIONS)
    )
    rows = last_by(known, ["root_id", "dimension"], "log_pos")
    roots = (
        known.groupBy("root_id")
        .agg(F.count_distinct("dimension").alias("dims"))
        .filter(F.col("dims") == len(tx.DIMENSIONS))
        .select("root_id")
    )
    ranked = hash_rank(roots, ["root_id"], seed, "root_rank")
    if root_limit > 0:
        ranked = ranked.filter(F.col("root_rank") <= root_limit)
    return rows.join(ranked, "root_id").withColumn("dimension_rank", dimension_rank())


def candidate_q(
    candidates: DataFrame, results: DataFrame, q_low: float, q_high: float, min_samples: int = 1
) -> DataFrame:
    """Every candidate with its measured success, null below ``min_samples`` rows.

    Results of other candidates are ignored.
    """
    check_band(q_low, q_high)
    measured = (
        results.groupBy("candidate_id")
        .agg(F.count(F.lit(1)).alias("samples"), F.count_if("correct").alias("hits"))
        .filter(F.col("samples") >= min_samples)
        .select("candidate_id", (F.col("hits") / F.col("samples")).alias("success_probability"))
    )
    joined = candidates.join(measured, F.col("id") == F.col("candidate_id"), "left").drop("candidate_id")
    banded = F.coalesce(in_band("success_probability", q_low, q_high), F.lit(False))
    return joined.withColumn("in_q_band", banded)


def q_summary(calibrated: DataFrame) -> DataFrame:
    """Measured candidates, how many are in the band, and their mean success."""
    n = F.count("success_probability")
    inside = F.count_if("in_q_band")
    return calibrated.agg(
        n.alias("candidate_count"),
        inside.alias("trainable_candidate_count"),
        F.when(n > 0, inside / n).otherwise(F.lit(0.0)).alias("trainable_candidate_rate"),
        F.when(n > 0, F.sum("success_probability") / n).otherwise(F.lit(0.0)).alias("mean_q"),
    )


def q_histogram(calibrated: DataFrame) -> DataFrame:
    known = calibrated.filter(F.col("success_probability").isNotNull())
    return known.groupBy("success_probability").agg(F.count(F.lit(1)).alias("candidates"))


def dimension_report(calibrated: DataFrame) -> DataFrame:
    n = F.count("success_probability")
    return calibrated.groupBy("dimension").agg(
        n.alias("candidates"),
        F.when(n > 0, F.sum("success_probability") / n).otherwise(F.lit(0.0)).alias("mean_q"),
        F.count_if("in_q_band").alias("in_band"),
    )


def _pick_per_root(rows: DataFrame, order: list[Column]) -> DataFrame:
    kept = F.struct(*rows.columns)
    return rows.groupBy("root_id").agg(F.min_by(kept, F.struct(*order)).alias("c")).select("c.*")


def best_candidate_per_root(calibrated: DataFrame) -> DataFrame:
    """One in-band candidate per root: success nearest one half, then the shortest."""
    order = [
        F.abs(F.col("success_probability") - 0.5),
        F.length("subproblem"),
        dimension_rank(),
        F.col("id"),
    ]
    return _pick_per_root(calibrated.filter("in_q_band"), order).withColumn("trainable", F.lit(True))


def _variant_share(variant: str, cell: str) -> Column:
    return F.max(F.when(F.col("variant") == variant, F.col(cell)))


def causal_candidates(
    candidates: DataFrame,
    results: DataFrame,
    q_low: float,
    q_high: float,
    min_gain: float = 0.0,
    min_samples: int = 1,
) -> DataFrame:
    """One candidate per root whose plan helps more than no plan and a random plan.

    Everything follows from one count table per (root, candidate, variant), which
    combines map-side; the root's baseline is folded from that same table.
    """
    check_band(q_low, q_high)
    cells = results.groupBy("root_id", "candidate_id", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("hits")
    )
    enough = cells.filter(F.col("n") >= min_samples).withColumn("q", F.col("hits") / F.col("n"))
    base = (
        cells.filter(F.col("variant") == NO_HELP)
        .groupBy("root_id")
        .agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
        .filter(F.col("n") >= min_samples)
        .select("root_id", (F.col("hits") / F.col("n")).alias("no_help_probability"))
    )
    helped = (
        enough.filter(F.col("variant").isin(RELEVANT, RANDOM))
        .groupBy("root_id", F.col("candidate_id").alias("id"))
        .agg(
            _variant_share(RELEVANT, "q").alias("success_probability"),
            _variant_share(RANDOM, "q").alias("random_plan_probability"),
        )
    )
    scored = candidates.join(helped, ["root_id", "id"]).join(base, "root_id")
    q, none, rand = (
        F.col("success_probability"),
        F.col("no_help_probability"),
        F.col("random_plan_probability"),
    )
    useful = scored.filter(
        in_band(q, q_low, q_high) & (q > none + min_gain) & (q > rand + min_gain)
    ).withColumn("gain_over_no_help", q - none).withColumn("gain_over_random", q - rand)
    order = [
        F.size(tx.words("minimal_plan")),
        F.abs(q - (q_low + q_high) / 2),
        dimension_rank(),
        F.col("id"),
    ]
    return _pick_per_root(useful, order).withColumn("trainable", F.lit(True))


def calibration_summary(roots: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected roots, roots with a training candidate, and the rate."""
    chosen = selected.agg(F.count(F.lit(1)).alias("n"))
    n = F.col("selected_roots")
    return (
        roots.agg(F.count_distinct("root_id").alias("selected_roots"))
        .withColumn("training_roots", chosen.scalar())
        .withColumn(
            "training_candidate_rate",
            F.when(n > 0, F.col("training_roots") / n).otherwise(F.lit(0.0)),
        )
    )


WORD_BITS = 62  # samples in one mask


def expected_keys(candidates: DataFrame) -> DataFrame:
    """Keys each root must have: one baseline and two per candidate, whatever the sample."""
    base = candidates.select("root_id", F.lit("").alias("candidate_id"), F.lit(NO_HELP).alias("variant")).distinct()
    variants = F.explode(F.array(F.lit(RELEVANT), F.lit(RANDOM))).alias("variant")
    helped = candidates.select("root_id", F.col("id").alias("candidate_id")).distinct().select("root_id", "candidate_id", variants)
    return base.unionByName(helped)


def sample_masks(results: DataFrame, max_samples: int) -> DataFrame:
    """Logged samples of each (root, candidate, variant) as bits of the numbers ``mask0``, ``mask1``, ...

    One scan of the log; equal keys meet before the shuffle.
    """
    at = F.col("sample_index")
    bit = F.expr(f"shiftleft(1L, cast(sample_index % {WORD_BITS} as int))")
    words = range(-(-max_samples // WORD_BITS))
    return (
        results.filter((at >= 0) & (at < max_samples))
        .select("root_id", F.coalesce("candidate_id", F.lit("")).alias("candidate_id"), "variant", "sample_index", bit.alias("__bit"))
        .groupBy("root_id", "candidate_id", "variant")
        .agg(*[F.bit_or(F.when(F.floor(at / WORD_BITS) == w, F.col("__bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"mask{w}") for w in words])
    )


def expected_masks(candidates: DataFrame, results: DataFrame, max_samples: int) -> tuple[DataFrame, list[str]]:
    """Every expected key with its mask, zero where nothing is logged; keys of unknown candidates fall out."""
    masks = sample_masks(results, max_samples)
    words = [c for c in masks.columns if c.startswith("mask")]
    joined = expected_keys(candidates).join(masks, ["root_id", "candidate_id", "variant"], "left")
    return joined.fillna(0, words), words


def _first_gap(words: list[Column], max_samples: int) -> Column:
    """Lowest bit that is not set in the words, ``max_samples`` at most."""
    gap = F.lit(max_samples)
    for w in reversed(range(len(words))):
        full = F.lit((1 << WORD_BITS) - 1)
        ones = F.bit_count(words[w].bitwiseAND(F.bitwise_not(words[w] + 1)))
        gap = F.when(words[w] == full, gap).otherwise(F.lit(w * WORD_BITS) + ones)
    return F.least(gap, F.lit(max_samples)).cast("int")


def completed_prefix(candidates: DataFrame, results: DataFrame, max_samples: int) -> DataFrame:
    """First sample index of each root whose expected keys are not all logged.

    A sample is complete where the masks of all expected keys have its bit: their conjunction.
    """
    keys, words = expected_masks(candidates, results, max_samples)
    whole = keys.groupBy("root_id").agg(*[F.bit_and(w).alias(w) for w in words])
    return whole.select("root_id", _first_gap([F.col(w) for w in words], max_samples).alias("prefix"))


def pending_jobs(
    candidates: DataFrame,
    results: DataFrame,
    min_samples: int,
    max_samples: int,
    sample_batch: int,
) -> DataFrame:
    """Missing keys of each root's next wave of samples: bits of the wave that a key's mask lacks."""
    if min_samples < 1 or max_samples < min_samples or sample_batch < 1:
        raise ValueError("need 1 <= min_samples <= max_samples and sample_batch >= 1")
    keys, words = expected_masks(candidates, results, max_samples)
    root = Window.partitionBy("root_id")
    whole = [F.bit_and(w).over(root) for w in words]
    start = F.col("prefix")
    end = F.least(F.lit(max_samples), F.greatest(F.lit(min_samples), start + sample_batch))
    masks = F.array(*words)
    lacking = F.filter(
        F.sequence(start, end - 1),
        lambda i: F.getbit(F.get(masks, F.floor(i / WORD_BITS).cast("int")), i % WORD_BITS) == 0,
    )
    return (
        keys.withColumn("prefix", _first_gap(whole, max_samples))
        .filter(start < max_samples)
        .select("root_id", "candidate_id", "variant", F.explode(lacking).alias("sample_index"))
    )


def learnability(candidates: DataFrame, results: DataFrame, group_size: int) -> DataFrame:
    """Success of each candidate on its own and the contrast of its reward groups."""
    measured = results.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("hits")
    )
    joined = candidates.join(measured, F.col("id") == F.col("candidate_id"), "left")
    p = F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0))
    return joined.select(
        "root_id",
        F.col("id").alias("candidate_id"),
        F.coalesce("dimension", F.lit("")).alias("dimension"),
        p.alias("p_sub"),
        informative(p, group_size).alias("contrast_score"),
        F.coalesce("n", F.lit(0)).alias("num_samples"),
        F.coalesce("hits", F.lit(0)).alias("correct_samples"),
    )


def learnability_summary(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("candidates"),
        F.coalesce(F.sum("num_samples"), F.lit(0)).alias("rollouts"),
        F.count_if((F.col("p_sub") > 0) & (F.col("p_sub") < 1)).alias("informative_candidates"),
        F.when(n > 0, F.sum("p_sub") / n).otherwise(F.lit(0.0)).alias("mean_p_sub"),
    )
