"""Evaluation comparisons, feasibility gates and data checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: datasets, published scores in percent, gate bounds ----------------
DATASETS = ("AIME24", "AIME25", "AMC23", "MinervaMath", "MATH-500", "OlympiadBench", "GaoKao2023en")
PUBLISHED = {
    ("1.5b", "base"): (7.2, 3.3, 32.5, 14.7, 32.8, 20.6, 20.0),
    ("1.5b", "vanilla"): (13.3, 10.0, 47.5, 28.3, 72.2, 34.8, 57.4),
    ("1.5b", "scaffolded"): (20.0, 13.3, 60.0, 29.1, 73.4, 36.6, 57.9),
    ("7b", "base"): (13.3, 13.3, 42.5, 16.5, 53.6, 18.2, 35.1),
    ("7b", "vanilla"): (30.0, 13.3, 60.0, 33.4, 75.8, 41.3, 62.6),
    ("7b", "scaffolded"): (43.3, 20.0, 70.0, 36.4, 80.0, 43.3, 63.4),
}
GATES = {
    "rescue_rate": 0.15,
    "token_saving": 0.30,
    "relevance_gain": 0.05,
    "valid_rate": 0.70,
    "self_check_gain": 0.05,
    "feedback_gain": 0.05,
    "information_gain": 0.10,
    "examples": 32,
    "limit_rate": 0.20,
}
DATA_GATES = {"valid_rate": 0.5, "in_band": 8, "gain": 0.0}
# -------------------------------------------------------------------------------------


def published_scores(df: DataFrame, model_size: str, method: str) -> DataFrame:
    """The fixed reference table as a DataFrame (seven rows)."""
    rows = list(zip(DATASETS, PUBLISHED[(model_size, method)]))
    return df.sparkSession.createDataFrame(rows, "dataset string, published double")


def complete_methods(scores: DataFrame, datasets: Sequence[str] = DATASETS) -> DataFrame:
    """Scores of the methods that were evaluated on every dataset."""
    full = (
        scores.filter(F.col("dataset").isin(*datasets))
        .groupBy("method")
        .agg(F.count_distinct("dataset").alias("n"))
        .filter(F.col("n") == len(datasets))
        .select("method")
    )
    return scores.join(full, "method", "left_semi")


def eval_comparison(
    scores: DataFrame,
    baseline: str,
    datasets: Sequence[str] = DATASETS,
    incomplete: str = "error",
    budgets: DataFrame | None = None,
) -> DataFrame:
    """Score, macro row and delta against the baseline, per dataset and method.

    The macro row (``dataset`` null) is the mean over the fixed ``datasets``; other datasets do
    not count. Both levels come from one aggregate with grouping sets. A method without a single
    score for each of them is an error, or left out with ``incomplete="skip"``. ``budgets``
    (method, steps, prompts_per_step, rollouts_per_prompt) adds the trajectories of each method.
    """
    if incomplete not in ("error", "skip"):
        raise ValueError("incomplete must be 'error' or 'skip'")
    listed = scores.filter(F.col("dataset").isin(*datasets)).select("dataset", "method", "score")
    by_set = [[F.col("dataset"), F.col("method")], [F.col("method")]]
    rows = listed.groupingSets(by_set, "dataset", "method").agg(
        F.avg("score").alias("score"),
        F.count("score").alias("__n"),
        F.count_if(F.col("score").isNull()).alias("__null"),
        F.grouping_id().alias("__level"),
    )
    # a method has one dataset row each and one macro row
    method = Window.partitionBy("method")
    present = F.count_if(F.col("__level") == 0).over(method)
    counted = F.max(F.when(F.col("__level") != 0, F.col("__n") - F.col("__null"))).over(method)
    whole = (present == len(datasets)) & (counted == len(datasets))
    rows = rows.withColumn("__whole", whole)
    if incomplete == "skip":
        rows = rows.filter("__whole")
    else:
        message = F.concat(F.col("method"), F.lit(f" is not scored once on each of the {len(datasets)} datasets"))
        rows = rows.withColumn("score", F.when(F.col("__whole"), F.col("score")).otherwise(F.raise_error(message).cast("double")))
    dataset = Window.partitionBy("dataset")  # one row a method
    base = F.max(F.when(F.col("method") == baseline, F.col("score"))).over(dataset)
    out = rows.select("dataset", "method", "score", (F.col("score") - base).alias("delta"))
    if budgets is None:
        return out
    trajectories = F.col("steps").cast("bigint") * F.col("prompts_per_step") * F.col("rollouts_per_prompt")
    known = budgets.select(F.col("method").alias("__m"), trajectories.alias("trajectories"))
    return out.join(known, F.col("method") == F.col("__m"), "left").drop("__m")


def trajectory_budget(steps: int, prompts_per_step: int, rollouts: int) -> int:
    return steps * prompts_per_step * rollouts


def eval_gap(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """Reproduced minus published, in percent points, with a macro row (``dataset`` null).

    ``scores``: ``dataset, score`` in [0, 1]; ``reference``: ``dataset, published``.
    """
    both = scores.join(reference, "dataset").select(
        "dataset", (F.col("score") * 100.0).alias("reproduced"), "published"
    )
    macro = both.agg(F.avg("reproduced").alias("reproduced"), F.avg("published").alias("published")).select(
        F.lit(None).cast("string").alias("dataset"), "reproduced", "published"
    )
    return both.unionByName(macro).withColumn("gap_pp", F.col("reproduced") - F.col("published"))


def _status(promising: Column, mixed: Column) -> Column:
    return F.when(promising, "promising").when(mixed, "mixed_evidence").otherwise("not_supported_yet")


def assess_runs(
    capability: DataFrame,
    subproblem: DataFrame,
    variants: DataFrame,
    diagnostics: DataFrame,
    controlled: DataFrame,
) -> DataFrame:
    """Both schemes judged for every ``run_id`` from the five summary tables.

    capability: ``run_id, rescue_rate, token_saving, examples, limit_rate``;
    subproblem: ``run_id, relevance_gain, rescue_advantage, valid_rate, solve_accuracy,
    questions, warning``; variants and controlled: ``run_id, variant, accuracy,
    questions``; diagnostics: ``run_id, rescues, harms, fallback_questions``.
    """

    def accuracy(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("variant") == name, F.col("accuracy"))), F.lit(0.0))

    own = variants.groupBy("run_id").agg(
        accuracy("no_help").alias("no_help"),
        accuracy("random_bit").alias("random_bit"),
        accuracy("self_asked_verification").alias("self_asked"),
        F.greatest(accuracy("knowledge_min"), accuracy("planning_min"), accuracy("solution_min")).alias("minimal"),
        F.max("questions").alias("variant_questions"),
    )
    retry = controlled.groupBy("run_id").agg(accuracy("answer_verification_retry").alias("retry"))
    joined = (
        capability.join(subproblem, "run_id")
        .join(own, "run_id")
        .join(diagnostics, "run_id")
        .join(retry, "run_id")
    )
    zero = {
        c: F.coalesce(c, F.lit(0.0))
        for c in (
            "rescue_rate",
            "token_saving",
            "limit_rate",
            "relevance_gain",
            "rescue_advantage",
            "valid_rate",
            "solve_accuracy",
        )
    }
    joined = joined.withColumns(zero).withColumns(
        {
            "self_check_gain": F.col("self_asked") - F.greatest("no_help", "random_bit"),
            "feedback_gain": F.col("retry") - F.col("no_help"),
            "information_gain": F.col("minimal") - F.col("no_help"),
            "shared_examples": F.least(
                F.coalesce("examples", F.lit(0)),
                F.coalesce("questions", F.lit(0)),
                F.coalesce("variant_questions", F.lit(0)),
            ),
        }
    )
    gated = joined.withColumns(
        {
            "scaffold_gate": F.col("rescue_rate") >= GATES["rescue_rate"],
            "cost_gate": F.col("token_saving") >= GATES["token_saving"],
            "relevance_gate": (F.col("relevance_gain") >= GATES["relevance_gain"])
            & (F.col("rescue_advantage") >= 0.0),
            "construction_gate": F.col("valid_rate") >= GATES["valid_rate"],
            "self_check_gate": (F.col("self_check_gain") >= GATES["self_check_gain"])
            & (F.coalesce("rescues", F.lit(0)) > F.coalesce("harms", F.lit(0))),
            "feedback_gate": F.col("feedback_gain") >= GATES["feedback_gain"],
            "information_gate": F.col("information_gain") >= GATES["information_gain"],
        }
    )

    def note(name: str, sign: str, bound) -> Column:  # the value, and the bound it breaks
        return F.concat(F.lit(f"{name}="), F.col(name).cast("string"), F.lit(f" {sign} {bound}"))

    notes = F.array(
        F.when(F.col("shared_examples") < GATES["examples"], note("shared_examples", "<", GATES["examples"])),
        F.when(F.col("limit_rate") > GATES["limit_rate"], note("limit_rate", ">", GATES["limit_rate"])),
        F.when(F.coalesce("fallback_questions", F.lit(0)) > 0, note("fallback_questions", ">", 0)),
        F.nullif("warning", F.lit("")),
    )
    return gated.withColumns(
        {
            "scheme1_status": _status(
                F.col("relevance_gate") & F.col("scaffold_gate") & F.col("construction_gate"),
                (F.col("scaffold_gate") & F.col("cost_gate")) | F.col("relevance_gate"),
            ),
            "scheme2_status": _status(
                F.col("self_check_gate") & F.col("feedback_gate"),
                F.col("feedback_gate") | F.col("information_gate"),
            ),
            "warnings": F.filter(notes, lambda w: w.isNotNull()),
        }
    )


def _checks(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column, Column, Column]]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                value.cast("double").alias("value"),
                bound.cast("double").alias("bound"),
                ok.alias("ok"),
            )
            for name, value, bound, ok in rules
        ]
    )
    return df.select(*keys, F.inline(rows))


def mix_checks(mix: DataFrame, minimum_roots: int = 1) -> DataFrame:
    """Row-count contract of a 1:1 mix: (check, value, bound, ok)."""
    counts = mix.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("slot") == 0).alias("roots"),
        F.count_if(F.coalesce(F.col("extra_info.is_subproblem"), F.lit(False))).alias("subs"),
    )
    rows, roots, subs = F.col("rows"), F.col("roots"), F.col("subs")
    return _checks(
        counts,
        [],
        [
            ("mixed_is_twice_root", rows, roots * 2, (roots > 0) & (rows == roots * 2)),
            ("subproblems_equal_roots", subs, roots, subs == roots),
            ("minimum_training_roots", roots, F.lit(minimum_roots), roots >= minimum_roots),
        ],
    )


def data_gates(summaries: DataFrame, minimum_roots: int = 1) -> DataFrame:
    """Go/no-go checks per run: ``run_id, valid_rate, in_band, gain, training_roots``."""
    valid, band, gain, roots = (F.col(c) for c in ("valid_rate", "in_band", "gain", "training_roots"))
    return _checks(
        summaries,
        ["run_id"],
        [
            ("valid_candidate_rate", valid, F.lit(DATA_GATES["valid_rate"]), valid >= DATA_GATES["valid_rate"]),
            ("candidates_in_band", band, F.lit(DATA_GATES["in_band"]), band >= DATA_GATES["in_band"]),
            ("gain_over_random", gain, F.lit(DATA_GATES["gain"]), gain > DATA_GATES["gain"]),
            ("minimum_training_roots", roots, F.lit(minimum_roots), roots >= minimum_roots),
        ],
    )


def contract_check(table: DataFrame, required: Sequence[str], expected_rows: int | None = None) -> DataFrame:
    """Required columns and row count as (check, expected, actual, ok) rows."""
    rows = []
    for name in sorted(required):
        present = name in table.columns
        rows.append((f"column {name}", "present", "present" if present else "missing", present))
    fixed = [
        F.struct(
            F.lit(c).alias("check"), F.lit(e).alias("expected"), F.lit(a).alias("actual"), F.lit(ok).alias("ok")
        )
        for c, e, a, ok in rows
    ]
    n = F.count(F.lit(1))
    want = F.lit(str(expected_rows)) if expected_rows is not None else F.lit("any")
    counted = F.struct(
        F.lit("rows").alias("check"),
        want.alias("expected"),
        n.cast("string").alias("actual"),
        (n == expected_rows if expected_rows is not None else n >= 0).alias("ok"),
    )
    return table.agg(F.array(*fixed, counted).alias("r")).select(F.inline("r"))
