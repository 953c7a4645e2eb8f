"""Merging calibration shards and recovering which shard owns which root."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwork.functions import text as tx
from rungwork.operators.admission import usable_plans
from rungwork.plans.ranking import hash_rank, position_rank


def overlapping_roots(shards: DataFrame) -> DataFrame:
    """Roots found more than once over all shard outputs (``shard, root_id`` rows)."""
    return (
        shards.groupBy("root_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("shard").alias("shards"))
        .filter(F.col("rows") > 1)
    )


def merge_shards(shards: DataFrame) -> DataFrame:
    """Union of shard outputs; a root present twice is an error. Sort by root to report."""
    clash = overlapping_roots(shards).limit(1)
    first = clash.agg(F.max("root_id")).scalar()
    message = F.concat(F.lit("calibration shards overlap at root "), F.col("__clash"))
    return (
        shards.withColumn("__clash", first)
        .withColumn("root_id", F.when(F.col("__clash").isNull(), F.col("root_id")).otherwise(F.raise_error(message)))
        .drop("__clash")
    )


def merge_summary(shards: DataFrame, summaries: DataFrame) -> DataFrame:
    """Totals over shards: selected roots from the summaries, training roots from the rows."""
    trained = shards.agg(F.count(F.lit(1)))
    n = F.col("selected_roots")
    return (
        summaries.agg(
            F.sum("selected_roots").cast("bigint").alias("selected_roots"),
            F.count(F.lit(1)).alias("num_shards"),
        )
        .withColumn("training_roots", trained.scalar())
        .withColumn(
            "training_candidate_rate",
            F.when(n > 0, F.col("training_roots") / n).otherwise(F.lit(0.0)),
        )
    )


def shard_quotas(root_limit: int, num_shards: int) -> list[int]:
    """Sizes of a round-robin split of ``root_limit`` roots."""
    if num_shards < 1 or root_limit < num_shards:
        raise ValueError("need root_limit >= num_shards >= 1")
    return [(root_limit - i + num_shards - 1) // num_shards for i in range(num_shards)]


def round_robin(roots: DataFrame, num_shards: int, seed: int = 42, root_limit: int = 0) -> DataFrame:
    """Seeded root order dealt out to the shards in turn."""
    ranked = hash_rank(roots.select("root_id").distinct(), ["root_id"], seed, "rank")
    if root_limit > 0:
        ranked = ranked.filter(F.col("rank") <= root_limit)
    return ranked.select(
        "root_id",
        ((F.col("rank") - 1) % num_shards).cast("int").alias("shard_index"),
        F.floor((F.col("rank") - 1) / F.lit(num_shards)).alias("position"),
    )


def root_history(logs: DataFrame) -> DataFrame:
    """First position and row count of each root in each shard's log.

    ``logs``: ``shard, root_id, log_pos`` rows.
    """
    return logs.groupBy("shard", "root_id").agg(
        F.count(F.lit(1)).alias("records"), F.min("log_pos").alias("first_pos")
    )


def eligible_roots(candidates: DataFrame, problems: DataFrame, max_plan_words: int = 12) -> DataFrame:
    """Roots with a usable plan whose question exists in the source table.

    ``first_pos`` is the first log position at which the root qualifies.
    """
    keys = problems.select(tx.question_key("question").alias("question_key")).distinct()
    usable = usable_plans(candidates, max_plan_words).select(
        "root_id", "log_pos", tx.question_key("question").alias("question_key")
    )
    return (
        usable.join(keys, "question_key", "left_semi")
        .groupBy("root_id")
        .agg(F.min("log_pos").alias("first_pos"))
    )


def recover_manifests(
    eligible: DataFrame, history: DataFrame, quotas: Sequence[int], seed: int = 42
) -> DataFrame:
    """Frozen shard manifests: earlier assignments first, then seeded fill.

    A root logged by several shards stays with the one holding more rows, then the
    earlier first position, then the smaller shard. Every shard is ranked in slices, so
    no shard is sorted in one task. Fewer eligible roots than the quotas ask for are an error
    when the manifests are read.
    """
    eligible = eligible.select("root_id").distinct()
    quota = F.array(*[F.lit(int(q)).cast("bigint") for q in quotas])
    owner = F.struct("records", -F.col("first_pos"), -F.col("shard"))
    owned = history.groupBy("root_id").agg(
        F.max_by(F.struct("shard", "first_pos"), owner).alias("o")
    )
    kept = owned.join(eligible.select("root_id"), "root_id", "left_semi").select(
        "root_id", F.col("o.shard").cast("int").alias("shard_index"), F.col("o.first_pos").alias("first_pos")
    )
    ranked = position_rank(kept, "first_pos", "place", by=["shard_index"])
    recovered = ranked.filter(F.col("place") <= F.get(quota, F.col("shard_index"))).select(
        "root_id", "shard_index", (F.col("place") - 1).alias("position"), F.lit(True).alias("recovered")
    )
    have = recovered.groupBy("shard_index").agg(F.count(F.lit(1)).alias("n"))
    # one entry per shard: how many pool roots the shards up to it still need
    filled = have.agg(F.map_from_entries(F.collect_list(F.struct("shard_index", "n"))).alias("m"))
    pool = hash_rank(
        eligible.select("root_id").join(recovered, "root_id", "left_anti"), ["root_id"], seed, "draw"
    ).withColumn("__have", filled.scalar())
    taken = [F.coalesce(F.try_element_at("__have", F.lit(i)), F.lit(0)) for i in range(len(quotas))]
    needs = [F.lit(int(q)).cast("bigint") - t for q, t in zip(quotas, taken)]
    upper = needs[0]
    shard, position = F.when(F.col("draw") <= upper, F.lit(0)), F.when(
        F.col("draw") <= upper, taken[0] + F.col("draw") - 1
    )
    for i in range(1, len(quotas)):
        before, upper = upper, upper + needs[i]
        shard = shard.when(F.col("draw") <= upper, F.lit(i))
        position = position.when(F.col("draw") <= upper, taken[i] + F.col("draw") - before - 1)
    drawn = pool.select(
        "root_id",
        shard.alias("shard_index"),
        position.cast("bigint").alias("position"),
        F.lit(False).alias("recovered"),
    ).filter(F.col("shard_index").isNotNull())
    asked = sum(int(q) for q in quotas)
    size = eligible.agg(F.count(F.lit(1)).alias("n"))
    short = F.raise_error(F.concat(F.lit("not enough eligible roots: "), F.col("__n").cast("string"), F.lit(f" < {asked}")))
    both = recovered.unionByName(drawn).withColumn("__n", size.scalar())
    whole = F.when(F.col("__n") >= asked, F.col("position")).otherwise(short.cast("bigint"))
    return both.withColumn("position", whole).drop("__n")


def manifest_check(manifests: DataFrame, quotas: Sequence[int]) -> DataFrame:
    """Per shard: roots held against its quota, recovered roots and a verdict."""
    counts = [
        F.struct(
            F.lit(i).alias("shard_index"),
            F.count_if(F.col("shard_index") == i).alias("manifest_roots"),
            F.lit(int(q)).cast("bigint").alias("quota"),
            F.count_if((F.col("shard_index") == i) & F.col("recovered")).alias("recovered_roots"),
        )
        for i, q in enumerate(quotas)
    ]
    rows = manifests.agg(F.array(*counts).alias("s")).select(F.inline("s"))
    return rows.withColumn("ok", F.col("manifest_roots") == F.col("quota"))


def reuse_manifests(frozen: DataFrame, eligible: DataFrame, quotas: Sequence[int]) -> DataFrame:
    """Frozen manifests of an earlier run, with their size and unavailable roots checked."""
    missing = (
        frozen.join(eligible.select("root_id"), "root_id", "left_anti")
        .groupBy("shard_index")
        .agg(F.count(F.lit(1)).alias("missing_roots"))
        .withColumnRenamed("shard_index", "__shard")
    )
    sized = manifest_check(frozen.withColumn("recovered", F.lit(True)), quotas).drop("recovered_roots", "ok")
    joined = sized.join(missing, F.col("shard_index") == F.col("__shard"), "left").drop("__shard")
    return joined.withColumn("missing_roots", F.coalesce("missing_roots", F.lit(0))).withColumn(
        "ok", (F.col("manifest_roots") == F.col("quota")) & (F.col("missing_roots") == 0)
    )
