"""Hint arms of each problem and the table of generations still to run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwork.functions import prompts
from rungwork.functions import text as tx
from rungwork.functions.scoring import shown_count
from rungwork.plans.ranking import seeded_hash

ARM = "struct<arm_name:string,arm_kind:string,arm_strength:double,selected_parts:int,total_parts:int,hint:string>"


def numbered_hint(parts: Column, count: Column) -> Column:
    """The first ``count`` parts, one numbered line each."""
    shown = F.slice(parts, F.lit(1), F.greatest(count, F.lit(0)))
    return F.array_join(F.transform(shown, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\n")


def arm_lattice(problems: DataFrame, strengths: Sequence[float], hints: bool = True) -> DataFrame:
    """Unhinted arm plus every (hint kind with parts) x strength, numbered per row.

    Built as one array per problem and exploded, so it needs no shuffle. Without ``hints`` the
    hint texts stay empty; the number of selected parts says what they are.
    """
    if not strengths or any(not 0.0 < s <= 1.0 for s in strengths):
        raise ValueError("strengths must lie in (0, 1]")
    none = F.struct(
        F.lit("none"), F.lit("none"), F.lit(0.0), F.lit(0), F.lit(0), F.lit("")
    ).cast(ARM)
    groups = [F.array(none)]
    for kind, column in tx.HINT_COLUMNS.items():
        parts = tx.clean_parts(column)
        arms = []
        for strength in strengths:
            count = F.least(F.size(parts), shown_count(F.size(parts), F.lit(float(strength))))
            hint = numbered_hint(parts, count) if hints else F.lit("")
            arms.append(
                F.struct(
                    F.concat(F.lit(f"{kind}@"), tx.strength_label(F.lit(float(strength)))),
                    F.lit(kind),
                    F.lit(float(strength)),
                    count,
                    F.size(parts),
                    hint,
                ).cast(ARM)
            )
        groups.append(F.when(F.size(parts) > 0, F.array(*arms)).otherwise(F.array().cast(f"array<{ARM}>")))
    return problems.select(
        "*", F.posexplode(F.concat(*groups)).alias("arm_order", "__arm")
    ).select(*problems.columns, "arm_order", "__arm.*")


def build_job_table(
    keyed: DataFrame, strengths: Sequence[float], samples_per_arm: int, seed: int = 42, done: DataFrame | None = None
) -> DataFrame:
    """Root x arm x sample with prompt; ``job_order`` is the seeded execution order.

    ``keyed``: output of ``key_problems``. Jobs in ``done`` (id, arm_name, sample_index) are left
    out; they are looked up by keys alone, and only what is left gets its texts, by log position.
    """
    samples = F.explode(F.sequence(F.lit(0), F.lit(samples_per_arm - 1)))
    columns = list(tx.HINT_COLUMNS.values())
    if done is None:
        jobs = arm_lattice(keyed, strengths).withColumn("sample_index", samples)
        rows = jobs.select(F.col("item_id").alias("id"), F.col("id").alias("source_id"), *[c for c in jobs.columns if c not in ("id", "item_id")])
    else:
        arms = arm_lattice(keyed.select("item_id", "log_pos", *columns), strengths, hints=False).drop("hint", *columns)
        keys = arms.withColumnRenamed("item_id", "id").withColumn("sample_index", samples)
        left = remaining_jobs(keys, done, ["id", "arm_name", "sample_index"])
        texts = keyed.select(F.col("log_pos").alias("__at"), F.col("id").alias("source_id"), "reference", "question", *columns)
        rows = left.join(texts, F.col("log_pos") == F.col("__at"))
        hint = F.lit("")
        for kind, column in tx.HINT_COLUMNS.items():
            hint = F.when(F.col("arm_kind") == kind, numbered_hint(tx.clean_parts(column), F.col("selected_parts"))).otherwise(hint)
        rows = rows.withColumn("hint", hint)
    return rows.select(
        "id",
        "source_id",
        "reference",
        "arm_name",
        "arm_kind",
        "arm_strength",
        "arm_order",
        "selected_parts",
        "total_parts",
        "hint",
        prompts.arm_prompt("arm_kind", "arm_strength", "hint").alias("prompt_text"),
        "sample_index",
    ).withColumn("job_order", seeded_hash(seed, F.col("id"), F.col("arm_name"), F.col("sample_index")))


def remaining_jobs(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs whose key is not in the log yet."""
    return jobs.join(done.select(*keys), list(keys), "left_anti")


def sample_jobs(rows: DataFrame, samples: int) -> DataFrame:
    """Every row once per sample index."""
    return rows.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
