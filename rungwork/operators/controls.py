"""Matched control help for each candidate, taken from another root."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwork.functions import text as tx
from rungwork.plans.ranking import hash_rank
from rungwork.session import cut_lineage

VALUE_SLICE = 1024
SLOTS = 4096  # of the ring in one part
PROBED = 64  # slots behind a root that are looked at before its secret is indexed
PROBES = 4  # rounds of looking at slots
LISTED = 1 << 20  # different secrets that go to the plan keys; the pieces of the keys go to more of them


def nearest_size_controls(
    candidates: DataFrame, size: str = "support_tokens", order: str = "log_pos"
) -> DataFrame:
    """For each candidate the other candidate of nearest ``size`` (earliest on a tie).

    Only the two earliest ids of each distinct size can ever be chosen, so rows are
    first cut to those (Spark limits each group before the shuffle); neighbours are
    then looked up among distinct sizes, sliced so no task sees them all.
    """
    first_of_id = candidates.groupBy(size, "id").agg(F.min(order).alias("__pos"))
    rank = F.row_number().over(Window.partitionBy(size).orderBy("__pos", "id"))
    top = first_of_id.withColumn("__rank", rank).filter(F.col("__rank") <= 2)
    sizes = top.groupBy(size).agg(
        F.min(F.when(F.col("__rank") == 1, F.struct("__pos", "id"))).alias("first"),
        F.min(F.when(F.col("__rank") == 2, F.struct("__pos", "id"))).alias("second"),
    )
    entry = F.struct(F.col(size).alias("size"), F.col("first"))
    sliced = sizes.withColumn("__slice", F.floor(F.col(size) / F.lit(VALUE_SLICE)))
    edges = sliced.groupBy("__slice").agg(
        F.min(entry).alias("low"), F.max(entry).alias("high")
    )
    along = Window.orderBy("__slice")  # one row per slice of 1024 sizes
    edges = edges.select(
        "__slice", F.lag("high").over(along).alias("edge_below"), F.lead("low").over(along).alias("edge_above")
    )
    within = Window.partitionBy("__slice").orderBy(size)
    around = (
        sliced.withColumn("below", F.lag(entry).over(within))
        .withColumn("above", F.lead(entry).over(within))
        .join(edges, "__slice")
        .select(
            F.col(size).alias("__size"),
            "first",
            "second",
            F.coalesce("below", "edge_below").alias("below"),
            F.coalesce("above", "edge_above").alias("above"),
        )
    )
    joined = candidates.join(around, F.col(size) == F.col("__size"))
    same = F.when(F.col("first.id") != F.col("id"), F.col("first")).otherwise(F.col("second"))

    def option(gap, pick):
        return F.when(pick.isNotNull(), F.struct(gap.alias("gap"), pick["__pos"].alias("pos"), pick["id"].alias("id")))

    options = F.array(
        option(F.lit(0).cast("bigint"), same),
        option((F.col(size) - F.col("below.size")).cast("bigint"), F.col("below.first")),
        option((F.col("above.size") - F.col(size)).cast("bigint"), F.col("above.first")),
    )
    best = F.array_min(F.filter(options, lambda o: o.isNotNull()))
    return joined.select(
        F.col("id"), F.col(size), best["id"].alias("control_id"), best["gap"].alias("size_gap")
    )


def shown_secrets(keys: DataFrame, secrets: DataFrame) -> DataFrame:
    """Distinct (plan_key, secret) where the key holds the secret: substrings of the secrets' lengths, joined as strings."""
    secrets = secrets.select("secret").where("secret <> ''").distinct()
    sizes = secrets.groupBy(F.length("secret").alias("n")).agg(F.count(F.lit(1)).alias("secrets")).collect()  # one entry a length
    lengths = [r["n"] for r in sizes]
    if sum(r["secrets"] for r in sizes) <= LISTED:
        secrets = F.broadcast(secrets)
    if not lengths:
        return keys.select("plan_key", F.col("plan_key").alias("secret")).limit(0)
    # few bytes, but thousands of pieces a key: a fixed number of tasks, which are not merged by size
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fitting = keys.select("plan_key").repartition(tasks, "plan_key").distinct().withColumn("n", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)])))
    starts = F.sequence(F.lit(1), F.length("plan_key") - F.col("n") + 1)
    pieces = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("plan_key"), i, F.col("n"))))
    cut = fitting.where(F.col("n") <= F.length("plan_key")).select("plan_key", F.explode(pieces).alias("secret"))
    return cut.join(secrets, "secret").select("plan_key", "secret")


def next_free(blocked: DataFrame, size: int, width: int = SLOTS) -> DataFrame:
    """Add ``free`` to distinct (secret, at): the first slot behind ``at`` that the secret does not block, null behind ``size``.

    Slots are cut into parts of ``width``. Inside a part a run of blocked slots has one difference of
    slot and row number; a run up to a part's end goes on in the parts behind it, of which a secret
    has one row each.
    """
    part, behind = F.floor(F.col("at") / width), (F.col("part") + 1) * width
    inside = Window.partitionBy("secret", "part").orderBy("at")
    runs = blocked.withColumn("part", part).withColumn("run", F.col("at") - F.row_number().over(inside))
    runs = runs.withColumn("last", F.max("at").over(Window.partitionBy("secret", "part", "run")))
    heads = runs.groupBy("secret", "part").agg(F.max(F.when(F.col("at") == F.col("part") * width, F.col("last"))).alias("head"))
    along = Window.partitionBy("secret").orderBy("part")
    rest = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    opening = F.when(F.col("head").isNull(), F.col("part") * width).when(F.col("head") + 1 < behind, F.col("head") + 1)
    chain = heads.withColumn("follows", F.coalesce(F.lead("part").over(along) == F.col("part") + 1, F.lit(False)))
    chain = chain.withColumn("stop", F.coalesce(opening, F.when(~F.col("follows"), behind)))
    chain = chain.withColumn("after", F.first("stop", ignorenulls=True).over(rest))
    chain = chain.withColumn("going_on", F.when(F.col("follows"), F.lead("after").over(along)).otherwise(behind))
    chain = chain.select(F.col("secret").alias("s"), F.col("part").alias("p"), "going_on")
    found = runs.join(chain, (F.col("secret") == F.col("s")) & (F.col("part") == F.col("p")))
    free = F.when(F.col("last") + 1 < behind, F.col("last") + 1).otherwise(F.col("going_on"))
    return found.select("secret", "at", F.when(free <= size, free).alias("free"))


def _behind_runs(waiting: DataFrame, options: DataFrame, size: int) -> DataFrame:
    """(root_id, secret, ring, at): the next slot of each root that its secret does not block, by an index of these secrets."""
    shown = shown_secrets(options, waiting).join(options.select("plan_key", "at"), "plan_key")
    slots = options.groupBy(F.col("at").alias("slot")).agg(F.count(F.lit(1)).alias("plans"))
    refused = shown.groupBy("secret", "at").agg(F.count(F.lit(1)).alias("n"))
    blocked = cut_lineage(refused.join(slots, F.col("at") == F.col("slot")).where("n = plans").select("secret", "at"))
    free = cut_lineage(next_free(blocked, size))

    def looked_up(targets: DataFrame, slot: Column, name: str) -> DataFrame:
        """``name``: ``slot`` where it is free for the secret, else the slot behind its run."""
        seen = free.select(F.col("secret").alias("s"), "at", F.col("free").alias("behind"))
        joined = targets.withColumn("slot", slot).join(seen, (F.col("secret") == F.col("s")) & (F.col("slot") == F.col("at")), "left")
        return joined.withColumn(name, F.when(F.col("at").isNull(), F.col("slot")).otherwise(F.col("behind"))).drop("slot", "s", "at", "behind")

    targets = looked_up(looked_up(waiting, F.col("ring") + 1, "ahead"), F.lit(1).cast("long"), "again")
    chosen = F.when(F.col("ahead") <= size, F.col("ahead")).when(F.col("again") < F.col("ring"), F.col("again"))
    return cut_lineage(targets.select("root_id", "secret", "ring", chosen.alias("at")).where("at is not null"))


def ring_controls(plans: DataFrame, seed: int = 42, require_all: bool = True) -> DataFrame:
    """Plan of the next root on a seeded ring that does not show the root's reference.

    ``plans``: ``root_id, id, dimension, reference, minimal_plan, log_pos`` with non-empty
    plans. Inside the next root the same dimension is preferred, then the smaller id.

    The slots behind a root are looked at first, ``PROBED`` of them in ``PROBES`` rounds at most;
    a round looks at some four slots a root of the ring in all. Roots that are open then have secrets
    that nearly all plans show. For those secrets an index to the slots whose plans all show them
    gives each one's runs of blocked slots: a root looks its next slot up, and behind the ring's
    end the first one; a blocked slot names the slot behind its run. So work grows with plans and
    the hits of such secrets, however far the nearest usable root is.
    """
    plans = cut_lineage(
        plans.select("root_id", "id", "dimension", "reference", "minimal_plan", "log_pos")
    )
    roots = plans.groupBy("root_id").agg(
        tx.alnum_key(F.coalesce(F.min_by("reference", "log_pos"), F.lit(""))).alias("secret")
    )
    ring = cut_lineage(hash_rank(roots, ["root_id"], seed, "ring"))
    size = ring.count()
    if size < 2:
        raise ValueError("at least two roots with plans are needed")
    # equal plans of one root and dimension are refused together, so the smallest id stands for all of them
    options = cut_lineage(
        plans.join(ring.select("root_id", F.col("ring").alias("at")), "root_id")
        .groupBy(
            "at",
            F.col("dimension").alias("other_dimension"),
            tx.alnum_key("minimal_plan").alias("plan_key"),
        )
        .agg(F.min(F.struct(F.col("id").alias("control_id"), F.col("minimal_plan").alias("control_plan"))).alias("o"))
        .select("at", "other_dimension", "plan_key", "o.*")
    )
    free_of_secret = (F.col("secret") == "") | ~F.contains("plan_key", F.col("secret"))
    waiting, left, seen, found = ring, size, 0, []  # seen: slots looked at behind each
    for _ in range(PROBES):
        more = min(max(3 * seen, 1), PROBED - seen, size - 1 - seen, max(1, 4 * size // max(left, 1)))
        if left == 0 or more < 1:
            break
        steps = F.sequence(F.lit(seen + 1).cast("long"), F.lit(seen + more).cast("long"))
        tried = waiting.select("root_id", "secret", "ring", F.explode(steps).alias("step"))
        tried = tried.withColumn("at", F.pmod(F.col("ring") + F.col("step") - 1, F.lit(size)) + 1)
        first = tried.join(options.select("at", "plan_key"), "at").where(free_of_secret).groupBy("root_id").agg(F.min("step").alias("step"))
        looked = cut_lineage(waiting.join(first, "root_id", "left").select("root_id", "secret", "ring", "step"))
        at = (F.pmod(F.col("ring") + F.col("step") - 1, F.lit(size)) + 1).alias("at")
        found.append(looked.where("step is not null").select("root_id", "secret", "ring", at))
        waiting, seen = looked.where("step is null").drop("step"), seen + more
        left = waiting.count()
    if left and seen < size - 1:
        found.append(_behind_runs(waiting, options, size))
    targets = reduce(DataFrame.unionByName, found)
    wanted = targets.select("secret", "at").distinct().join(options, "at")
    usable = wanted.where(free_of_secret)
    firsts = usable.groupBy("secret", "at", "other_dimension").agg(F.min(F.struct("control_id", "control_plan")).alias("c"))
    kinds = plans.select("root_id", "dimension").distinct().join(targets, "root_id")
    nearest = F.struct((F.col("other_dimension") != F.col("dimension")).alias("differs"), "c.control_id")
    step = F.pmod(F.col("at") - F.col("ring"), F.lit(size))
    found = (
        kinds.join(firsts, ["secret", "at"])
        .groupBy("root_id", "dimension", step.alias("step"))
        .agg(F.min_by("c", nearest).alias("c"))
        .select("root_id", "dimension", "c.*", "step")
    )
    out = plans.select("root_id", "id", "dimension").join(found, ["root_id", "dimension"], "left")
    if require_all:
        out = cut_lineage(out)
        if not out.where("step is null").isEmpty():
            raise ValueError("some roots have no control plan free of their reference answer")
    return out
