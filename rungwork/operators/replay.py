"""What hint policies would have cost, replayed from logged trajectories.

A trajectory is grouped once, by hash and without sorting: each arm of the order has a slot that
keeps the code of its last logged record, a 64-bit number that holds cost, success and whether the
arm is public. Replays are sums and minima over the slots of one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUBLIC_KINDS = ("none", "knowledge", "solution")
LEVELS = ("none", "knowledge", "planning", "solution")
ARMS = 16  # places of the arm order
CORRECT, PUBLIC, COST = 1, 2, 2  # bits of a code, and how far its cost is shifted


def arm_code() -> Column:
    """Cost, success and public kind of a record as one number; costs of 2^60 and more are an error."""
    cost = F.coalesce(F.col("input_tokens") + F.col("output_tokens"), F.lit(0)).cast("bigint")
    fits = F.when((cost >= 0) & (cost < F.lit(1 << 60)), cost).otherwise(F.raise_error(F.lit("cost out of range")).cast("bigint"))
    flags = F.when(F.coalesce(F.col("correct"), F.lit(False)), CORRECT).otherwise(0) + F.when(F.col("arm_kind").isin(*PUBLIC_KINDS), PUBLIC).otherwise(0)
    return F.shiftleft(fits, COST).bitwiseOR(flags.cast("bigint"))


def arm_slots(rollouts: DataFrame, keys: Sequence[str], values: dict[str, Column], arms: int = ARMS) -> DataFrame:
    """One row a trajectory: of each value one column a place of the arm order, from the arm's last record.

    Values are numbers, so the grouping keeps them in place. A place outside the order is an error.
    """
    place = F.col("arm_order")
    known = F.when((place >= 0) & (place < arms), place).otherwise(F.raise_error(F.concat(F.lit("arm order outside 0.."), F.lit(str(arms - 1)))).cast("int"))
    rows = rollouts.select(*keys, known.alias("__place"), "log_pos", *[v.alias(f"__{n}") for n, v in values.items()])
    at = [F.when(F.col("__place") == k, F.col("log_pos")) for k in range(arms)]
    return rows.groupBy(*keys).agg(*[F.max_by(f"__{n}", at[k]).alias(f"{n}{k}") for k in range(arms) for n in values])


class Slots:
    """Replays over the code columns of one row; absent arms have null codes."""

    def __init__(self, arms: int = ARMS, public: bool = False):
        self.codes = [F.col(f"code{k}") for k in range(arms)]
        if public:
            self.codes = [F.when(c.bitwiseAND(PUBLIC) != 0, c) for c in self.codes]
        self.costs = [F.shiftright(c, COST) for c in self.codes]
        self.right = [F.coalesce(c.bitwiseAND(CORRECT) != 0, F.lit(False)) for c in self.codes]

    def progressive(self) -> Column:
        """Arms tried in order up to and including the first correct one."""
        first = F.least(*[F.when(r, F.lit(k)) for k, r in enumerate(self.right)])
        tried = [c.isNotNull() & (first.isNull() | (F.lit(k) <= first)) for k, c in enumerate(self.codes)]
        zero = F.lit(0).cast("bigint")
        return F.struct(
            reduce(add, [F.when(t, c).otherwise(zero) for t, c in zip(tried, self.costs)]).alias("cost"),
            reduce(add, [t.cast("bigint") for t in tried]).alias("calls"),
            first.isNotNull().alias("success"),
        )

    def hindsight(self) -> Column:
        """Cheapest correct arm, else the cheapest arm; null cost without any arm."""
        right = F.least(*[F.when(r, c) for r, c in zip(self.right, self.costs)])
        return F.struct(F.coalesce(right, F.least(*self.costs)).alias("cost"), right.alias("success_cost"))


def policy_replays(rollouts: DataFrame, arms: int = ARMS) -> DataFrame:
    """Every policy's outcome per trajectory, from a single grouping of the log."""
    runs = arm_slots(rollouts, ("id", "sample_index"), {"code": arm_code()}, arms)
    every, public = Slots(arms), Slots(arms, public=True)
    return runs.select(
        "id",
        "sample_index",
        every.progressive().alias("full_progressive"),
        public.progressive().alias("public_progressive"),
        every.hindsight().alias("full_hindsight"),
        public.hindsight().alias("public_hindsight"),
    )


def _progressive_means(replays: DataFrame, name: str) -> DataFrame:
    n = F.count(F.lit(1))
    return replays.agg(
        n.alias("trajectories"),
        (F.count_if(F.col(f"{name}.success")) / n).alias("accuracy"),
        (F.sum(f"{name}.cost") / n).alias("average_total_tokens"),
        (F.sum(f"{name}.calls") / n).alias("average_calls"),
    )


def _hindsight_means(replays: DataFrame, name: str) -> DataFrame:
    n, right = F.count(F.lit(1)), F.count(f"{name}.success_cost")
    return replays.agg(
        n.alias("trajectories"),
        (right / n).alias("accuracy"),
        (F.sum(f"{name}.cost") / F.count(f"{name}.cost")).alias("average_total_tokens"),
        F.when(right > 0, F.sum(f"{name}.success_cost") / right)
        .otherwise(F.lit(0.0))
        .alias("average_total_tokens_on_success"),
    )


def progressive_replay(replays: DataFrame, public: bool = False) -> DataFrame:
    """Mean accuracy, tokens and calls of trying arms in order until one is right."""
    return _progressive_means(replays, "public_progressive" if public else "full_progressive")


def min_cost_hindsight(replays: DataFrame, public: bool = False) -> DataFrame:
    """The cheapest choice known only afterwards.

    A trajectory without any arm of the chosen order has no cost and is left out of
    the mean cost.
    """
    return _hindsight_means(replays, "public_hindsight" if public else "full_hindsight")


def strongest_solution(rollouts: DataFrame) -> DataFrame:
    """Always using the strongest solution hint (else the last arm of the order).

    An arm's name stands for its kind and strength; its place may differ from item to item.
    """
    arm = ("arm_name", "arm_kind", "arm_strength")
    last = rollouts.withColumn("__code", arm_code()).groupBy("id", "sample_index", *arm).agg(
        F.max_by("__code", "log_pos").alias("code"), F.max("arm_order").alias("arm_order")
    )
    per_arm = last.groupBy(*arm).agg(
        F.max("arm_order").alias("arm_order"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("code").bitwiseAND(CORRECT) != 0).alias("hits"),
        F.sum(F.shiftright("code", COST)).alias("cost"),
    )
    is_solution = F.col("arm_kind") == "solution"
    strength = F.when(is_solution, F.col("arm_strength")).otherwise(F.lit(0.0))
    place = F.when(is_solution, -F.col("arm_order")).otherwise(F.col("arm_order"))
    best = per_arm.orderBy(is_solution.desc(), strength.desc(), place.desc()).limit(1)  # one row an arm
    return best.select(
        "arm_name",
        F.col("n").alias("trajectories"),
        (F.col("hits") / F.col("n")).alias("accuracy"),
        (F.col("cost") / F.col("n")).alias("average_total_tokens"),
    )


def token_saving(replays: DataFrame) -> DataFrame:
    """Hindsight saving against the public order, and what planning arms add."""
    n = F.count(F.lit(1))
    paid = F.sum("public_progressive.cost") / n
    least = F.sum("public_hindsight.cost") / F.count("public_hindsight.cost")
    return replays.agg(
        F.when(paid > 0, 1.0 - least / paid).otherwise(F.lit(0.0)).alias("token_saving_fraction"),
        (F.count("full_hindsight.success_cost") / n - F.count("public_hindsight.success_cost") / n).alias(
            "planning_accuracy_gain"
        ),
    )


def level_replay(attempts: DataFrame) -> DataFrame:
    """Hint levels tried in order with several samples each, one row per item.

    ``attempts``: ``id, level (0..3), correct, output_tokens, latency_seconds`` rows.
    """
    top = len(LEVELS) - 1

    def at(k: int, value: Column | str) -> Column:
        return F.when(F.col("level") == k, value if isinstance(value, Column) else F.col(value))

    sums = {"calls": F.lit(1).cast("bigint"), "tokens": F.col("output_tokens"), "latency": F.col("latency_seconds")}
    items = attempts.groupBy("id").agg(
        *[F.max(at(k, "correct")).alias(f"correct{k}") for k in range(top + 1)],
        *[F.sum(at(k, v)).alias(f"{n}{k}") for n, v in sums.items() for k in range(top + 1)],
    )
    solved = F.least(*[F.when(F.col(f"correct{k}"), F.lit(k)) for k in range(top + 1)])
    items = items.withColumn("selected_level", solved)
    tried = [F.col("selected_level").isNull() | (F.lit(k) <= F.col("selected_level")) for k in range(top + 1)]

    def total(name: str, zero: Column) -> Column:
        return reduce(add, [F.when(t, F.coalesce(F.col(f"{name}{k}"), zero)).otherwise(zero) for k, t in enumerate(tried)])

    none, whole = F.lit(0.0), F.lit(0).cast("bigint")
    names = F.array(*[F.lit(x) for x in LEVELS])
    bare = F.coalesce(F.col("correct0"), F.lit(False))
    return items.select(
        "id",
        bare.alias("no_hint_correct"),
        F.coalesce(F.col(f"correct{top}"), F.lit(False)).alias("full_hint_correct"),
        F.col("selected_level").isNotNull().alias("progressive_correct"),
        "selected_level",
        F.coalesce(F.get(names, "selected_level"), F.lit("failed")).alias("selected_level_name"),
        (~bare & F.col("selected_level").isNotNull()).alias("scaffold_recovered"),
        total("calls", whole).alias("progressive_calls"),
        total("tokens", whole).alias("progressive_output_tokens"),
        total("latency", none).alias("progressive_latency_seconds"),
        F.coalesce(F.col(f"tokens{top}"), whole).alias("full_hint_output_tokens"),
        F.coalesce(F.col(f"latency{top}"), none).alias("full_hint_latency_seconds"),
    )


def level_summary(items: DataFrame) -> DataFrame:
    """One report row over :func:`level_replay`."""
    n = F.count(F.lit(1))
    return items.agg(
        n.alias("num_examples"),
        (F.count_if("no_hint_correct") / n).alias("no_hint_accuracy"),
        (F.count_if("full_hint_correct") / n).alias("full_hint_accuracy"),
        (F.count_if("progressive_correct") / n).alias("progressive_accuracy"),
        F.count_if("scaffold_recovered").alias("scaffold_recovery_count"),
        (F.sum("selected_level") / F.count("selected_level")).alias("average_selected_level_on_success"),
        F.sum("progressive_calls").alias("progressive_calls"),
        F.sum("progressive_output_tokens").alias("progressive_output_tokens"),
        F.sum("full_hint_output_tokens").alias("full_hint_output_tokens"),
        F.sum("progressive_latency_seconds").alias("progressive_latency_seconds"),
        F.sum("full_hint_latency_seconds").alias("full_hint_latency_seconds"),
    )


def level_histogram(items: DataFrame) -> DataFrame:
    """Items per selected level, with zero rows for levels nobody needed."""
    names = (*LEVELS, "failed")
    counts = F.array(
        *[
            F.struct(F.lit(name).alias("level"), F.count_if(F.col("selected_level_name") == name).alias("items"))
            for name in names
        ]
    )
    return items.agg(counts.alias("h")).select(F.inline("h"))
