"""Engine tables derived from the driver's star-schema parquet files.

Used by the registered queries, tests and benchmark. A trajectory is an order of a
customer (``sample_index`` = order key), so no row numbering over a large group is
needed to build any of these tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, as the scan splits it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner")


def line_position() -> Column:
    """Log position inside one (order, line number): part, then whole price."""
    return F.col("l_partkey") * F.lit(100_000_000) + F.floor("l_extendedprice")


ARM_NAMES = (
    "none",
    "knowledge@25",
    "knowledge@100",
    "planning@25",
    "planning@100",
    "solution@25",
    "solution@100",
)


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item = customer, arm = line number, trajectory = order."""
    number = F.col("l_linenumber")
    names = F.array(*[F.lit(n) for n in ARM_NAMES])
    hint = F.when(number == 1, F.lit(0)).otherwise(F.floor("l_quantity")).cast("long")
    return order_lines(spark, sf_dir).select(
        F.col("o_custkey").cast("string").alias("id"),
        F.concat(F.lit("Problem "), F.col("o_custkey").cast("string")).alias("question"),
        (F.col("o_custkey") % 10).cast("string").alias("reference"),
        F.col("o_orderpriority").alias("priority"),
        F.get(names, number - 1).alias("arm_name"),
        F.substring_index(F.get(names, number - 1), "@", 1).alias("arm_kind"),
        F.when(number == 1, F.lit(0.0))
        .when(number.isin(2, 4, 6), F.lit(0.25))
        .otherwise(F.lit(1.0))
        .alias("arm_strength"),
        (number - 1).cast("int").alias("arm_order"),
        F.col("l_orderkey").alias("sample_index"),
        (F.col("l_returnflag") == "R").alias("correct"),
        (F.floor("l_quantity") + 20).cast("long").alias("input_tokens"),
        hint.alias("hint_tokens"),
        F.floor(F.col("l_extendedprice") / 100).cast("long").alias("output_tokens"),
        (F.col("l_tax") > 0.06).alias("hit_max_new_tokens"),
        F.col("l_discount").alias("latency_seconds"),
        line_position().alias("log_pos"),
    )


def help_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root = customer, candidate = dimension, sample = line number modulo three."""
    return as_help_results(order_lines(spark, sf_dir))


def as_help_results(lines: DataFrame) -> DataFrame:
    dimension = (
        F.when(F.col("l_orderkey") % 3 == 0, "knowledge")
        .when(F.col("l_orderkey") % 3 == 1, "planning")
        .otherwise("calculation")
    )
    variant = (
        F.when(F.col("l_returnflag") == "N", "no_help")
        .when(F.col("l_returnflag") == "R", "relevant_plan")
        .otherwise("random_plan")
    )
    root = F.col("o_custkey").cast("string")
    return lines.select(
        root.alias("root_id"),
        F.when(variant == "no_help", F.lit(""))
        .otherwise(F.concat_ws("::", root, dimension))
        .alias("candidate_id"),
        dimension.alias("dimension"),
        variant.alias("variant"),
        ((F.col("l_linenumber") - 1) % 3).cast("int").alias("sample_index"),
        (F.col("l_linestatus") == "O").alias("correct"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("log_pos"),
    )


def root_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candidates per customer, for the calibration jobs."""
    root = F.col("c_custkey").cast("string")
    return (
        table(spark, sf_dir, "customer")
        .select(
            root.alias("root_id"),
            F.col("c_name"),
            F.col("c_mktsegment"),
            F.explode(F.array(*[F.lit(d) for d in tx.DIMENSIONS])).alias("dimension"),
        )
        .select(
            F.concat_ws("::", "root_id", "dimension").alias("id"),
            "root_id",
            "dimension",
            F.concat(F.lit("Problem "), F.col("root_id")).alias("question"),
            F.concat_ws(" ", "dimension", "c_mktsegment", "c_name").alias("subproblem"),
            F.concat_ws(" ", F.lit("use"), "c_mktsegment", "dimension").alias("minimal_plan"),
        )
    )


def variant_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item = user, variant = event type, sample = calendar day."""
    variants = F.create_map(
        *[
            F.lit(x)
            for pair in (
                ("view", "no_help"),
                ("click", "random_bit"),
                ("error", "self_asked_verification"),
                ("purchase", "knowledge_min"),
                ("signup", "planning_min"),
            )
            for x in pair
        ]
    )
    tokens = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    day = F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"),
        F.try_element_at(variants, F.col("event_type")).alias("variant"),
        day.cast("long").alias("sample_index"),
        (F.col("value") > 40).alias("correct"),
        F.when(F.col("event_type") == "view", F.lit(0).cast("long"))
        .otherwise(tokens)
        .alias("external_information_tokens"),
        F.floor("value").cast("long").alias("total_generated_tokens"),
        tokens.alias("props_tokens"),
        F.col("event_id").alias("log_pos"),
    )


def field(text: Column | str, delimiter: str, position: Column | int) -> Column:
    position = F.lit(position) if isinstance(position, int) else position
    return F.split_part(tx.col(text), F.lit(delimiter), position)


def dealt(text: Column | str, turn: Column | int) -> Column:
    """Every third sentence of the whole text, from ``turn`` (0 to 2) on."""
    sentences = F.split(tx.col(text), r"\.")
    return F.array_join(F.filter(sentences, lambda x, i: i % 3 == turn), ".")


def last_word(text: Column | str) -> Column:
    return F.substring_index(tx.col(text), " ", -1)  # searched from the end


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root = document, one candidate per dimension; all sentences are dealt to the three."""
    slots = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.lit(i + 1).alias("pos")) for i, d in enumerate(tx.DIMENSIONS)]
    )
    cut = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "text", F.inline(slots).alias("dimension", "pos")
    )
    root = F.col("doc_id").cast("string")
    return (
        cut.withColumn("subproblem", dealt("text", F.col("pos") - 1))
        .select(
            F.concat_ws("::", root, "dimension").alias("id"),
            root.alias("root_id"),
            "dimension",
            F.col("source").alias("source_id"),
            F.col("text").alias("question"),
            last_word("text").alias("reference"),
            "subproblem",
            # some answers come wrapped, as a generator may write them
            F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("\\boxed{"), last_word("subproblem"), F.lit("}")))
            .otherwise(last_word("subproblem"))
            .alias("subproblem_answer"),
            F.lit("").alias("relation"),
            dealt("text", F.col("pos") % 3).alias("source_step"),
            F.length("subproblem").cast("long").alias("support_tokens"),
            (F.col("doc_id") * 3 + F.col("pos")).alias("log_pos"),
        )
    )


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; ``id`` = source, reused across rows; all sentences are dealt to the hint lists."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("label_doc"), (1 - F.col("quality")).cast("double").alias("accuracy")
    )
    docs = table(spark, sf_dir, "documents")
    joined = docs.join(labels, F.col("doc_id") == F.col("label_doc"), "left")
    message = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))

    def parts(turn: int) -> Column:
        return F.filter(F.split("text", r"\."), lambda x, i: i % 3 == turn)

    return joined.select(
        F.col("source").alias("id"),
        F.col("text").alias("question"),
        F.array(message).alias("prompt"),
        F.struct(last_word("text").alias("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"),
        F.when(F.col("lang") == "en", F.concat("source", F.lit(tx.LEGACY_SOURCE_SUFFIX)))
        .otherwise(F.col("source"))
        .alias("data_source"),
        parts(0).alias("knowledge_components_parts"),
        parts(1).alias("planning_skeleton_parts"),
        F.array(dealt("text", 2)).alias("solution_breakdown_parts"),
        F.col("text").alias("solution"),
        "accuracy",
        F.col("doc_id").alias("log_pos"),
    )


def as_selector_output(turn: Column | str, text: Column | str) -> Column:
    """A third of the turns end with an action word; the others are whole texts as they are."""
    return F.when(tx.col(turn) % 3 == 0, F.concat(tx.col(text), F.lit(" -> planning"))).otherwise(tx.col(text))


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset = nation, method = order priority, score = share of returned lines."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    per_customer = (
        order_lines(spark, sf_dir)
        .groupBy("o_custkey", "o_orderpriority")
        .agg(
            F.sum((F.col("l_returnflag") == "R").cast("long")).alias("hits"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("dataset"), F.col("o_orderpriority").alias("method"))
        .agg((F.sum("hits") / F.sum("n")).alias("score"))
    )


def logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target = embedding, behaviour = embedding shifted by a constant per label."""
    shift = (F.col("label") - 5) * F.lit(0.03125)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("target"),
        F.transform("embedding", lambda x: x.cast("double") + shift).alias("behavior"),
        F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)).alias("response_mask"),
        F.transform("embedding", lambda x: x.cast("double") * 2).alias("advantages"),
        (F.col("label") % 2 == 1).alias("off_context"),
    )

