"""Turning raw generations into typed candidates, with every rejection explained."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwork.functions import text as tx
from rungwork.plans.ranking import hash_rank



def key_problems(problems: DataFrame) -> DataFrame:
    """Problems with their keys, cleaned hint lists, reference solution and data source."""
    reference = tx.ground_truth("reward_model")
    present = [c for c in ("solution", "model_think", "model_answer") if c in problems.columns]
    hints = {c: tx.clean_parts(c) for c in tx.HINT_COLUMNS.values()}
    return problems.withColumns(
        {
            **hints,
            "question_key": tx.question_key("question"),
            "item_id": tx.item_id("id", "question"),
            "reference": reference,
            "reference_solution": tx.reference_solution(reference, *present, stripped=True),
            "source_accuracy": tx.source_accuracy("accuracy"),
            "data_source": tx.normal_data_source("data_source"),
        }
    )


def data_source_report(problems: DataFrame) -> DataFrame:
    """Rows, rewritten rows and rows still carrying the legacy suffix."""
    after = tx.normal_data_source("data_source")
    return problems.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("data_source") != after).alias("normalized_rows"),
        F.count_if(F.endswith(after, F.lit(tx.LEGACY_SOURCE_SUFFIX))).alias("remaining_rows"),
    )


def data_sources(problems: DataFrame) -> DataFrame:
    return problems.groupBy(tx.normal_data_source("data_source").alias("data_source")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def eligible_problems(problems: DataFrame, max_source_accuracy: float, check_text: bool = True) -> DataFrame:
    """Rows hard enough to probe: question and truth present, accuracy not above the bound."""
    kept = problems.filter(tx.source_accuracy("accuracy") <= max_source_accuracy)
    if check_text:
        kept = kept.filter(tx.has_text("question") & (tx.ground_truth("reward_model") != ""))
    return kept


def seeded_sample(rows: DataFrame, keys: Sequence[str], limit: int, seed: int) -> DataFrame:
    """First ``limit`` rows of the seeded order (all of them for 0), ranked by ``draw``."""
    ranked = hash_rank(rows, list(keys), seed, "draw")
    return ranked.filter(F.col("draw") <= limit) if limit > 0 else ranked


def probe_rows(
    problems: DataFrame, limit: int, seed: int = 42, max_source_accuracy: float | None = None
) -> tuple[DataFrame, int]:
    """Seeded sample of hard-enough problems and how many were eligible; none is an error.

    The accuracy bound applies only where the column exists. Sort the sample by id to report.
    """
    rows = problems
    if max_source_accuracy is not None and "accuracy" in problems.columns:
        rows = problems.filter(F.col("accuracy") <= max_source_accuracy)
    eligible = rows.count()
    if eligible == 0:
        raise ValueError("no rows remain after filtering by source accuracy")
    drawn = seeded_sample(rows.select("log_pos"), ["log_pos"], limit, seed)
    return rows.join(drawn, "log_pos"), eligible


def _plan(max_words: int) -> Column:
    return tx.minimal_plan(
        "source_step", "relation", "subproblem", "subproblem_answer", "reference", max_words
    )


def plan_candidates(candidates: DataFrame, max_words: int = 12) -> DataFrame:
    """Candidates with their answer-free minimal plan ('' where it would leak)."""
    return candidates.withColumn("minimal_plan", _plan(max_words))


def usable_plans(candidates: DataFrame, max_words: int = 12) -> DataFrame:
    """Candidates with a non-empty minimal plan.

    A given ``minimal_plan`` is kept. Exploding a filtered one-element array drops the
    others without computing the plan a second time for the filter.
    """
    plan, rest = _plan(max_words), candidates.columns
    if "minimal_plan" in rest:
        rest = [c for c in rest if c != "minimal_plan"]
        plan = F.coalesce(F.nullif("minimal_plan", F.lit("")), plan)
    return candidates.select(
        *rest, F.explode(F.filter(F.array(plan), lambda p: p != "")).alias("minimal_plan")
    )


def parsed_subproblem(text: Column | str) -> Column:
    """Question and answer out of free text: tags, else a JSON object, else labelled lines."""
    text = tx.col(text)
    tagged = F.struct(
        tx.tagged(text, "subproblem").alias("subproblem"), tx.tagged(text, "answer").alias("answer")
    )
    blob = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    fields = F.from_json(blob, "map<string,string>")
    is_object = (blob != "") & fields.isNotNull() & F.try_parse_json(blob).isNotNull()

    def pick(*names: str) -> Column:
        return tx.collapse(F.coalesce(*[F.try_element_at(fields, F.lit(n)) for n in names], F.lit("")))

    as_json = F.struct(
        pick("subproblem", "question").alias("subproblem"), pick("answer", "target").alias("answer")
    )
    asks = r"(?is)(?:subproblem|question)\s*:\s*(.+?)(?=\n\s*(?:answer|target)\s*:|$)"
    tells = r"(?i)(?:answer|target)\s*:\s*([^\n]+)"
    lines = F.struct(
        tx.collapse(F.regexp_extract(text, asks, 1)).alias("subproblem"),
        tx.collapse(F.regexp_extract(text, tells, 1)).alias("answer"),
    )
    chosen = (
        F.when(tx.has_tag(text, "subproblem") & tx.has_tag(text, "answer"), tagged)
        .when(is_object, as_json)
        .otherwise(lines)
    )
    return F.when((chosen["subproblem"] != "") & (chosen["answer"] != ""), chosen)


def parse_generations(raw: DataFrame, text: str = "text") -> DataFrame:
    """One raw text column into every typed reading of it."""
    check = tx.verification_parts(text)
    found = parsed_subproblem(text)
    return raw.withColumn("__found", found).select(
        "*",
        F.col("__found.subproblem").alias("subproblem"),
        F.col("__found.answer").alias("subproblem_answer"),
        check["state"].alias("tentative_state"),
        check["question"].alias("verification_question"),
        tx.oracle_answer(text).alias("oracle_answer"),
        tx.help_action(text).alias("action"),
        F.when(F.col("__found").isNull(), F.lit("parse_failure")).alias("reject_reason"),
    ).drop("__found")


def screen_parsed(parsed: DataFrame, reference: str = "reference") -> DataFrame:
    """Adds the leak verdict (greedy unwrap) to parsed rows; unparsed rows keep their reason."""
    leaks = tx.answer_key_greedy("subproblem_answer") == tx.answer_key_greedy(reference)
    return parsed.withColumn("answer_leaks_root", F.coalesce(leaks, F.lit(False))).withColumn(
        "reject_reason",
        F.coalesce(
            "reject_reason",
            F.when(F.col("answer_leaks_root"), F.lit("subproblem_answer_equals_root_answer")),
        ),
    )


def admit_candidates(
    responses: DataFrame, dimensions: Sequence[str] = tx.DIMENSIONS, content: str = "content"
) -> DataFrame:
    """Structured generator responses, one output row per requested dimension.

    ``reject_reason`` names the first broken rule; since a response is taken or refused
    as a whole, every dimension of a refused response carries a reason.
    """
    unknown = set(dimensions) - set(tx.DIMENSIONS)
    if unknown or not dimensions:
        raise ValueError(f"dimensions must be a non-empty subset of {tx.DIMENSIONS}")
    # Inside a list the parser also refuses text behind the object; white space around it is JSON's own.
    whole = F.try_parse_json(F.concat(F.lit("["), F.col(content), F.lit("]")))
    ends = F.rtrim(F.col(content), F.lit(tx.JSON_SPACE)).endswith("}")
    alone = F.try_variant_get("__all", "$[1]", "variant").isNull() & ends
    parsed = responses.withColumn("__all", whole).withColumn("__json", F.when(alone, F.col("__all")))
    parsed = parsed.withColumn("__set", F.try_variant_get("__json", "$[0].candidates", "map<string,variant>"))
    wanted = F.array(*[F.lit(d) for d in dimensions])
    absent = F.array_except(wanted, F.map_keys("__set"))
    names = ("subproblem", "answer", "relation", "source_step", "verification")
    fields = f"struct<{', '.join(f'{f}: variant' for f in names)}>"

    def clean(dimension: str) -> Column:
        def as_text(field: Column) -> Column:  # the items of a list become lines
            items = F.try_variant_get(field, "$", "array<string>")
            lines = F.array_join(F.filter(items, lambda x: tx.strip(x) != ""), "\n")
            return tx.strip(F.coalesce(lines, F.try_variant_get(field, "$", "string"), F.lit("")))

        def entry(found: Column) -> Column:  # one walk to the object, bound for its five fields
            return F.struct(
                F.lit(dimension).alias("dimension"),
                found.isNotNull().alias("is_object"),
                *[as_text(found[f]).alias(f) for f in names],
            )

        found = F.try_variant_get(F.element_at("__set", dimension), "$", fields)
        return F.get(F.transform(F.array(found), entry), F.lit(0))

    secret = tx.answer_key("reference")

    def broken(e: Column) -> Column:
        return (
            F.when(~e["is_object"], "response is not a JSON object")
            .when((e["subproblem"] == "") | (e["answer"] == ""), "empty subproblem or answer")
            .when(F.length(e["subproblem"]) > tx.MAX_SUBPROBLEM_CHARS, "subproblem is too long")
            .when(F.length(e["answer"]) > tx.MAX_ANSWER_CHARS, "answer is too long")
            .when(F.length(e["verification"]) > tx.MAX_VERIFICATION_CHARS, "verification is too long")
        )

    def leak(e: Column) -> Column:
        return F.when(tx.answer_key(e["answer"]) == secret, tx.LEAK_BY_ANSWER).when(
            tx.answer_key(e["subproblem"]) == secret, tx.LEAK_BY_TEXT
        )

    def first(entries: Column, rule) -> Column:
        return F.get(F.filter(F.transform(entries, rule), lambda m: m.isNotNull()), F.lit(0))

    def judged(entries: Column) -> Column:
        return F.struct(F.coalesce(first(entries, broken), first(entries, leak)).alias("reason"), entries.alias("entries"))

    # the one-element array binds the cleaned entries, so they are built once
    entries = F.array(*[clean(d) for d in dimensions])
    checked = parsed.withColumn("__j", F.get(F.transform(F.array(entries), judged), F.lit(0)))
    missing = F.concat(F.lit("response is missing candidate dimensions: "), F.array_join(absent, ", "))
    reason = (
        F.when(F.col("__json").isNull(), F.lit("response is not valid JSON"))
        .when(F.col("__set").isNull(), F.lit("response does not contain a candidates JSON object"))
        .when(F.size(absent) > 0, missing)
        .otherwise(F.col("__j.reason"))
    )
    kept = [c for c in responses.columns if c != content]
    return (
        checked.select(*kept, reason.alias("reject_reason"), F.explode("__j.entries").alias("__e"))
        .select(
            *kept,
            "__e.dimension",
            "__e.subproblem",
            F.col("__e.answer").alias("subproblem_answer"),
            "__e.relation",
            "__e.source_step",
            "__e.verification",
            "reject_reason",
            tx.is_leak_error("reject_reason").alias("terminal"),
        )
    )


def answer_leaks(candidates: DataFrame) -> DataFrame:
    """Leak verdict for candidates already in table form."""
    secret = tx.answer_key("reference")
    reason = F.when(tx.answer_key("subproblem_answer") == secret, F.lit(tx.LEAK_BY_ANSWER)).when(
        tx.answer_key("subproblem") == secret, F.lit(tx.LEAK_BY_TEXT)
    )
    return candidates.withColumn("reject_reason", reason)


def terminal_roots(errors: DataFrame) -> DataFrame:
    """Roots whose failure cannot be cured by another try."""
    final = F.coalesce("terminal", F.lit(False)) | tx.is_leak_error("error")
    return errors.filter(final).select("id").distinct()


def open_requests(
    roots: DataFrame, done: DataFrame, errors: DataFrame, dimensions: Sequence[str] = tx.DIMENSIONS
) -> DataFrame:
    """(root, dimension) pairs still to request: not yet admitted, root not terminal."""
    wanted = roots.select(
        "root_id", F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension")
    ).withColumn("id", tx.candidate_id("root_id", "dimension"))
    left = wanted.join(done.select("id"), "id", "left_anti")
    stopped = terminal_roots(errors).withColumnRenamed("id", "root_id")
    return left.join(stopped, "root_id", "left_anti")


def failure_reasons(errors: DataFrame) -> DataFrame:
    return errors.groupBy(tx.error_class("error").alias("reason")).agg(F.count(F.lit(1)).alias("roots"))


def usage_totals(admitted: DataFrame) -> DataFrame:
    """Summed integer usage fields; one response's usage is counted once per root."""
    once = admitted.groupBy("root_id").agg(F.max_by("usage", "log_pos").alias("usage"))
    return (
        once.select(F.explode("usage").alias("field", "amount"))
        .groupBy("field")
        .agg(F.sum("amount").cast("bigint").alias("total"))
    )


def generation_summary(
    roots: DataFrame, admitted: DataFrame, errors: DataFrame, dimensions: Sequence[str] = tx.DIMENSIONS
) -> DataFrame:
    """Counts of one generation run.

    ``roots``: one row per eligible root (``root_id``, ``selected``); ``admitted``: candidate ids with
    ``this_run``; ``errors``: failed roots (``id``, ``error``, ``terminal``) with ``this_run``. A root
    whose dimensions are all there is skipped with all of them, one that failed for good in an
    earlier run with those that are missing. Every table becomes rows of counts, and one aggregate
    adds them up.
    """
    before = ~F.col("this_run")
    chosen = roots.filter("selected").select("root_id")
    wanted = chosen.select("root_id", F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension"))
    wanted = wanted.select("root_id", tx.candidate_id("root_id", "dimension").alias("id"))
    done = admitted.filter(before).select(F.col("id").alias("__id")).distinct()
    stopped = terminal_roots(errors.filter(before)).select(F.col("id").alias("__root"), F.lit(True).alias("__stopped"))
    per_root = (
        wanted.join(done, F.col("id") == F.col("__id"), "left")
        .groupBy("root_id")
        .agg(F.count_if(F.col("__id").isNull()).alias("missing"))
        .join(stopped, F.col("root_id") == F.col("__root"), "left")
    )
    all_there = F.when(F.col("missing") == 0, len(dimensions))
    skipped = F.coalesce(all_there, F.when(F.col("__stopped"), F.col("missing")), F.lit(0))
    names = (
        "eligible_rows", "selected_rows", "requested_candidates", "completed_before_run", "success_this_run",
        "skipped_this_run", "total_output_rows", "failed_roots_this_run", "terminal_roots",
    )

    def counted(rows: DataFrame, **values: Column) -> DataFrame:
        return rows.select(*[values.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])

    one, now = F.lit(1), F.col("this_run").cast("int")
    selected = F.col("selected").cast("int")
    parts = [
        counted(roots, eligible_rows=one, selected_rows=selected, requested_candidates=selected * len(dimensions)),
        counted(per_root, skipped_this_run=skipped),
        counted(admitted, completed_before_run=1 - now, success_this_run=now, total_output_rows=one),
        counted(errors, failed_roots_this_run=now),
        counted(terminal_roots(errors), terminal_roots=one),
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def valid_rate(screened: DataFrame) -> DataFrame:
    """Selected questions, valid candidates among their parsed replies, and the share."""
    n = F.count(F.lit(1))
    valid = F.count_if(F.col("reject_reason").isNull())
    return screened.agg(
        n.alias("selected_questions"),
        valid.alias("valid_candidates"),
        F.when(n > 0, valid / n).otherwise(F.lit(0.0)).alias("valid_candidate_rate"),
    )
