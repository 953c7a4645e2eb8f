"""Training tables: matched 1:1 mixes, plan-decorated roots and the three-stage build."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rungwork.functions import scoring as sc
from rungwork.functions import text as tx
from rungwork.operators.admission import usable_plans
from rungwork.plans.ranking import last_by, position_rank, seeded_hash
from rungwork.schemas import EXTRA_INFO
from rungwork.session import cut_lineage

# --- fixed values: manifest texts ----------------------------------------------------
PLAN_REASON = "Answer-free minimal plan places root success in the learning band and beats controls."
STAGE_REASON = (
    "Student-aware minimal plan is root-relevant; independent preconditioning "
    "is used only when scaffold usability is below the configured threshold."
)
PLAN_SCAFFOLD = "planning@100"
STAGE_PRECONDITION, STAGE_SCAFFOLD = "precondition", "root_scaffold"
# -------------------------------------------------------------------------------------

HOT_SHARE = 64  # a key with more than this part of all rows is split
NO_PARTS = "array<string>"


def _no_parts() -> Column:
    return F.array().cast(NO_PARTS)


def _extra(base: Column, **changes: Column) -> Column:
    """``extra_info`` in its widest declared form, with some fields replaced."""
    fields = F.lit(None).cast(EXTRA_INFO) if base is None else base
    out = F.coalesce(fields, F.from_json(F.lit("{}"), EXTRA_INFO))
    for name, value in changes.items():
        out = out.withField(name, value)
    return out


def _wide_problems(problems: DataFrame) -> DataFrame:
    """Problems with the columns that training rows have anyway."""
    wide = problems
    if "extra_info" not in problems.columns:
        wide = wide.withColumn("extra_info", F.lit(None).cast(EXTRA_INFO))
    if "solution" not in problems.columns:
        wide = wide.withColumn("solution", F.lit(None).cast("string"))
    return wide


def last_positions(problems: DataFrame) -> DataFrame:
    """(question_key, root_at): the last position of each question; no text leaves the scan."""
    keyed = problems.select(tx.question_key("question").alias("question_key"), F.col("log_pos").alias("root_at"))
    return keyed.groupBy("question_key").agg(F.max("root_at").alias("root_at"))


def salted_join(many: DataFrame, unique: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join on ``key``, of which ``unique`` has one row each, with the hot keys of ``many`` split.

    Keys are counted. One with more than a ``HOT_SHARE``-th of all rows, of which there are fewer than
    ``HOT_SHARE``, is dealt over as many salts as its rows fill such shares, by a hash of ``spread``;
    its row of ``unique`` is repeated for each salt. ``many`` is read twice, so it should be a table.
    """
    counts = many.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n"))
    total = many.agg(F.count(F.lit(1)).alias("n"))
    salts = F.ceil(F.col("__n") * HOT_SHARE / F.greatest(total.scalar(), F.lit(1))).cast("int")
    hot = cut_lineage(counts.select("__hot", salts.alias("__salts")).filter(F.col("__salts") > 1))  # HOT_SHARE rows at most
    if hot.isEmpty():
        return many.join(unique, key)
    same = F.col(key) == F.col("__hot")
    salt = F.when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("__salts"))).otherwise(0).cast("int")
    left = many.join(F.broadcast(hot), same, "left").withColumn("__salt", salt).drop("__hot", "__salts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    right = unique.join(F.broadcast(hot), same, "left").withColumn("__salt", every).drop("__hot", "__salts")
    return left.join(right, [key, "__salt"]).drop("__salt")


@dataclass(frozen=True)
class Pairs:
    """Candidates matched with their problem as a narrow table, and the tables that hold the texts.

    ``rows`` has question_key, cand_at and root_at (positions in the logs, which are unique there)
    and short values of the candidate. Texts are joined by position, and only where a result shows
    them: no wide row goes through the join on the question.
    """

    rows: DataFrame
    problems: DataFrame
    candidates: DataFrame

    def with_roots(self, rows: DataFrame | None = None, fields: Sequence[str] | None = None) -> DataFrame:
        """``rows`` with their problem's ``fields`` as the struct ``root``; much used problems are split."""
        wide = _wide_problems(self.problems)
        root = F.struct(*[f"`{c}`" for c in (fields or wide.columns)])
        roots = wide.select(F.col("log_pos").alias("root_at"), root.alias("root"))
        return salted_join(self.rows if rows is None else rows, roots, "root_at", "cand_at")

    def with_candidates(self, rows: DataFrame, fields: Sequence[str]) -> DataFrame:
        """``rows`` with their candidate's ``fields`` as the struct ``cand``."""
        known = [c for c in fields if c in self.candidates.columns]
        wide = self.candidates.select(F.col("log_pos").alias("__at"), F.struct(*known).alias("cand"))
        return rows.join(wide, F.col("cand_at") == F.col("__at")).drop("__at")

    def filter(self, condition: Column) -> Pairs:
        return Pairs(self.rows.filter(condition), self.problems, self.candidates)


SHORT = ("id", "root_id", "dimension", "minimal_plan", "success_probability", "no_help_probability", "random_plan_probability", "trainable")


def _short(candidates: DataFrame) -> DataFrame:
    """Keys, positions and short values of candidates as a written table."""
    known = [c for c in SHORT if c in candidates.columns]
    return cut_lineage(candidates.select(tx.question_key("question").alias("question_key"), F.col("log_pos").alias("cand_at"), *known))


def match_candidates(problems: DataFrame, candidates: DataFrame, rows: DataFrame | None = None) -> Pairs:
    """Candidates next to the last problem with their question (see :class:`Pairs`).

    ``rows`` may hold the candidates' short values, where they are there already.
    """
    short = _short(candidates) if rows is None else rows
    return Pairs(cut_lineage(salted_join(short, last_positions(problems), "question_key", "cand_at")), problems, candidates)


def unmatched_candidates(problems: DataFrame, candidates: DataFrame) -> DataFrame:
    keys = problems.select(tx.question_key("question").alias("__key")).distinct()
    return candidates.join(keys, tx.question_key("question") == F.col("__key"), "left_anti")


TEXTS = ("id", "subproblem", "subproblem_answer", "source_id", "question", "success_probability")  # of a candidate in a subproblem row
REPLACED = ("question", "prompt", "solution", "model_think", "model_answer", "parsed_output", "accuracy", *tx.HINT_COLUMNS.values())


def subproblem_row(schema: StructType) -> Column:
    """The row of ``root`` rewritten to ask the subproblem of ``cand`` instead; replaced texts of the root are not read."""
    r, c = F.col("root"), F.col("cand")
    reward = (
        r["reward_model"]
        .withField("ground_truth", tx.unboxed(c["subproblem_answer"]))
        .withField("style", F.coalesce(r["reward_model"]["style"], F.lit("rule")))
    )
    extra = _extra(
        r["extra_info"],
        is_subproblem=F.lit(True),
        parent_source_id=F.coalesce(c["source_id"], F.lit("")),
        parent_question=c["question"],
        subproblem_q=c["success_probability"],
        subproblem_key=tx.question_key(c["subproblem"]),
    )
    message = F.struct(F.lit("user").alias("role"), c["subproblem"].alias("content"))
    changed = {
        "question": c["subproblem"],
        "prompt": F.array(message),
        "reward_model": reward,
        "data_source": F.coalesce(r["data_source"], F.lit("math")),
        "extra_info": extra,
        **{column: _no_parts() for column in tx.HINT_COLUMNS.values()},
        "accuracy": F.lit(0.0),
    }
    fields = []
    for f in schema.fields:
        kept = F.lit(None).cast(f.dataType) if f.name in REPLACED else r[f.name]
        fields.append(changed.get(f.name, kept).alias(f.name))
    return F.struct(*fields)


def _root_row(schema: StructType) -> Column:
    """The row of ``root`` as it is, with its extra fields in their declared form."""
    extra = _extra(F.col("root.extra_info"))
    return F.struct(*[(extra if f == "extra_info" else F.col(f"root.`{f}`")).alias(f) for f in schema.names])


def _both_rows(pairs: Pairs, kept: Sequence[str]) -> DataFrame:
    """Root rows (slot 0) and subproblem rows (slot 1) of the pairs, each from the texts it shows."""
    schema = _wide_problems(pairs.problems).schema
    roots = pairs.with_roots().select(*kept, F.lit(0).alias("slot"), _root_row(schema).alias("row"))
    short = [f for f in schema.names if f not in REPLACED]
    asked = pairs.with_candidates(pairs.with_roots(fields=short), TEXTS)
    return roots.unionByName(asked.select(*kept, F.lit(1).alias("slot"), subproblem_row(schema).alias("row")))


def first_in_log(rows: DataFrame, count: int) -> DataFrame:
    """The first ``count`` rows of the log; only positions are ranked, not whole rows."""
    places = position_rank(rows.select("log_pos"), "log_pos", "nth").filter(F.col("nth") <= count)
    last = places.agg(F.max("log_pos"))
    return rows.withColumn("__last", last.scalar()).filter(F.col("log_pos") <= F.col("__last")).drop("__last")


def training_mix(
    problems: DataFrame, candidates: DataFrame, seed: int = 42, max_pairs: int | None = None
) -> DataFrame:
    """Root and subproblem rows 1:1, pairs in seeded order.

    Output is the problem schema plus ``pair`` (the seeded order key), ``slot`` (0 root,
    1 subproblem) and the candidate id; sorting by (pair, slot) gives the interleaved
    order. A hash orders the pairs as well as a row number would, without moving the
    wide rows once more.
    """
    rows = candidates
    if "trainable" in rows.columns:
        rows = rows.filter(F.coalesce("trainable", F.lit(True)))
    if max_pairs is not None:
        rows = first_in_log(rows, max_pairs)
    pairs = match_candidates(problems, rows)
    ranked = Pairs(pairs.rows.withColumns({"candidate_id": F.col("id"), "pair": seeded_hash(seed, F.col("id"))}), problems, rows)
    return _both_rows(ranked, ["pair", "candidate_id"]).select("pair", "slot", "candidate_id", "row.*")


def matched_roots(mix: DataFrame) -> DataFrame:
    """The root half of a mix."""
    return mix.filter(F.col("slot") == 0)


def mix_summary(mix: DataFrame, missing: DataFrame) -> DataFrame:
    return mix.agg(
        F.count_if(F.col("slot") == 0).alias("root_rows"),
        F.count_if(F.col("slot") == 1).alias("subproblem_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    ).withColumn("candidate_rows_not_matched", missing.agg(F.count(F.lit(1))).scalar())


def _with_plan(fields: list[str], plan: Column, extra: Column) -> Column:
    """Root row whose only hint is the plan."""
    changed = {
        "planning_skeleton_parts": F.array(plan),
        "knowledge_components_parts": _no_parts(),
        "solution_breakdown_parts": _no_parts(),
        "extra_info": extra,
    }
    return F.struct(*[changed.get(f, F.col(f"root.{f}")).alias(f) for f in fields])


def plan_decorated_roots(problems: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each matched root with its candidate's plan as only hint, plus its decision.

    Only trainable candidates make pairs. A question with several candidates is decorated,
    for each of its pairs, with the last one of the log, trainable or not.
    """
    short = _short(candidates)
    paired = short.filter(F.coalesce("trainable", F.lit(True))) if "trainable" in short.columns else short
    matched = match_candidates(problems, candidates, paired)
    last = short.groupBy(F.col("question_key").alias("__key")).agg(F.max("cand_at").alias("__last"))
    pick = F.struct(*[c for c in short.columns if c not in ("question_key", "cand_at")]).alias("pick")
    picks = short.join(last, (F.col("question_key") == F.col("__key")) & (F.col("cand_at") == F.col("__last"))).select("question_key", pick)
    rows = matched.with_roots(cut_lineage(salted_join(matched.rows, picks, "question_key", "cand_at")))
    fields = rows.schema["root"].dataType.names
    pick = F.col("pick")
    extra = _extra(
        F.col("root.extra_info"),
        minimal_plan=pick["minimal_plan"],
        q_help=pick["success_probability"],
        no_help_probability=pick["no_help_probability"],
        random_plan_probability=pick["random_plan_probability"],
    )
    return rows.select(
        F.col("id").alias("candidate_id"),
        "question_key",
        _with_plan(fields, pick["minimal_plan"], extra).alias("row"),
        F.struct(
            pick["root_id"].alias("root_id"),
            F.col("question_key"),
            F.lit("guided_root").alias("phase"),
            F.lit(PLAN_REASON).alias("reason"),
            pick["no_help_probability"].alias("root_success"),
            F.lit(0.0).alias("informative_probability"),
            F.lit(PLAN_SCAFFOLD).alias("selected_scaffold"),
            pick["success_probability"].alias("selected_scaffold_success"),
            F.array(pick["id"]).alias("active_subproblem_ids"),
            _no_parts().alias("unresolved_subproblem_ids"),
            F.lit(1.0).alias("prerequisite_mastery"),
            (pick["success_probability"] - pick["no_help_probability"]).alias("gain_over_no_help"),
            (pick["success_probability"] - pick["random_plan_probability"]).alias("gain_over_random"),
            pick["minimal_plan"].alias("minimal_plan"),
        ).alias("decision"),
    )


def staged_pairs(
    problems: DataFrame,
    candidates: DataFrame,
    learnability: DataFrame | None,
    group_size: int = 8,
    ready: float = 0.5,
    contrast_min: float = 0.0,
    max_plan_words: int = 12,
) -> Pairs:
    """Matched candidates with diagnostics and stage: the narrow table that the others extend.

    Candidates without a usable plan are left out, as are those without a source row.
    """
    if not (0.0 <= ready <= 1.0 and 0.0 <= contrast_min <= 1.0):
        raise ValueError("thresholds must be in [0, 1]")
    planned = usable_plans(candidates, max_plan_words)
    pairs = match_candidates(problems, planned)
    matched = pairs.rows
    if learnability is None:
        matched = matched.withColumn("p_sub", F.lit(None).cast("double"))
    else:
        known = last_by(learnability.select("candidate_id", "p_sub", "log_pos"), ["candidate_id"], "log_pos")
        known = known.select(F.col("candidate_id").alias("__cid"), "p_sub")
        matched = matched.join(known, F.col("id") == F.col("__cid"), "left").drop("__cid")
    scored = matched.withColumnsRenamed(
        {"id": "candidate_id", "success_probability": "q_help", "no_help_probability": "q_no", "random_plan_probability": "q_random"}
    ).withColumns(
        {
            "relevance_score": sc.relevance_gain(F.col("q_help"), F.col("q_no"), F.col("q_random")),
            "contrast_score": sc.informative("p_sub", group_size),
        }
    )
    first = sc.needs_preconditioning(
        F.col("q_help"), F.col("p_sub"), F.col("contrast_score"), ready, contrast_min
    )
    staged = scored.withColumns(
        {
            "final_score": F.greatest("relevance_score", F.lit(0.0)) * F.coalesce("contrast_score", F.lit(1.0)),
            "current_stage": F.when(first, STAGE_PRECONDITION).otherwise(STAGE_SCAFFOLD),
            "group_size": F.lit(group_size),
        }
    )
    return Pairs(staged, problems, candidates)  # rows that are left out have no pair


DIAGNOSTICS = ("q_help", "q_no", "q_random", "relevance_score", "p_sub", "contrast_score", "final_score")


def selected_pairs(pairs: Pairs) -> DataFrame:
    return pairs.with_candidates(pairs.rows, ("subproblem", "subproblem_answer")).select(
        "root_id",
        "candidate_id",
        "dimension",
        "cand.subproblem",
        "cand.subproblem_answer",
        "minimal_plan",
        "current_stage",
        *DIAGNOSTICS,
    )


def stage_roots(pairs: Pairs) -> DataFrame:
    """Matched roots as they are (the root-only training set)."""
    return pairs.with_roots().select("root.*")


def stage_scaffold_rows(pairs: Pairs) -> DataFrame:
    """Matched roots whose only hint is the plan, diagnostics in ``extra_info``."""
    rows = pairs.with_roots()
    fields = rows.schema["root"].dataType.names
    extra = _extra(
        F.col("root.extra_info"),
        student_aware_stage=F.col("current_stage"),
        minimal_plan=F.col("minimal_plan"),
        selected_candidate_id=F.col("candidate_id"),
        selected_dimension=F.coalesce("dimension", F.lit("")),
        **{d: F.col(d) for d in DIAGNOSTICS},
    )
    return rows.select(_with_plan(fields, F.col("minimal_plan"), extra).alias("r")).select("r.*")


def stage_precondition_rows(pairs: Pairs) -> DataFrame:
    """Root and subproblem rows of the pairs that need preconditioning."""
    needed = pairs.filter(F.col("current_stage") == STAGE_PRECONDITION)
    return _both_rows(needed, ["candidate_id"]).select("candidate_id", "slot", "row.*")


def stage_curriculum(pairs: Pairs) -> DataFrame:
    """Decisions of the pairs; ``diagnostics`` are the scores behind each."""
    waits = F.col("current_stage") == STAGE_PRECONDITION
    size = F.col("group_size").cast("double")
    spread = F.lit(1.0) - F.pow(F.col("q_no"), size) - F.pow(1.0 - F.col("q_no"), size)
    return pairs.rows.select(
        "root_id",
        "question_key",
        F.lit("guided_root").alias("phase"),
        F.lit(STAGE_REASON).alias("reason"),
        F.col("q_no").alias("root_success"),
        spread.alias("informative_probability"),
        F.lit(PLAN_SCAFFOLD).alias("selected_scaffold"),
        F.col("q_help").alias("selected_scaffold_success"),
        F.array("candidate_id").alias("active_subproblem_ids"),
        F.when(waits, F.array("candidate_id")).otherwise(_no_parts()).alias("unresolved_subproblem_ids"),
        F.when(waits, 0.0).otherwise(1.0).alias("prerequisite_mastery"),
        F.struct(
            F.col("current_stage").alias("student_aware_stage"),
            "minimal_plan",
            F.col("candidate_id").alias("selected_candidate_id"),
            F.coalesce("dimension", F.lit("")).alias("selected_dimension"),
            *DIAGNOSTICS,
        ).alias("diagnostics"),
    )


def stage_summary(pairs: Pairs) -> DataFrame:
    waits = F.col("current_stage") == STAGE_PRECONDITION
    return pairs.rows.agg(
        F.count(F.lit(1)).alias("selected_roots"),
        F.count_if(waits).alias("precondition_roots"),
        F.count_if(~waits).alias("root_scaffold_roots"),
        (F.count_if(waits) * 2).alias("precondition_rows"),
    )
